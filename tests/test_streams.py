import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tensorloom.operators import mailboxes as om
from tensorloom.operators import user_functions as uf
from tensorloom.sources import artifacts as sa
from tensorloom.streaming import streams as st
from tensorloom.streaming import timers as tm
from tensorloom.streaming import transfers as tr

SCHEMA = (
    "transfer string, ms long, seq long, kind string, idx long, data string, hash string, expected_chunks long, "
    "expected_len long, expected_hash string, aggregate_hash string, deadline_ms long"
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(t, ms, seq, kind, idx=None, text=None, n=None, total=None, digest=None, deadline=9_000):
    return (t, ms, seq, kind, idx, text, None if text is None else sha(text), n, total, digest, digest, deadline)


def stream_of(spark, tmp_path, batches, delay="0 seconds"):
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        df = tr.frames_from(spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_millis("ms")))
        df.coalesce(1).write.mode("append").parquet(folder)
    return st.read_windowed(spark, df.schema, folder, 1, latestFirst="false").withWatermark("at", delay)


def outcomes(stream, **how):
    rows = st.drain(tr.transfer_outcomes(stream, **how), typed_state=True).collect()
    return {(r.transfer, r.seq, r.kind): r.outcome for r in rows}


def all_outcomes(stream, **how):
    rows = st.drain(tr.transfer_outcomes(stream, **how), typed_state=True).collect()
    return sorted((r.transfer, -1 if r.seq is None else r.seq, r.kind, r.outcome) for r in rows)


def test_frames_may_arrive_out_of_order_across_windows(spark, tmp_path):
    d = sha("abcd")
    first = [frame("t", 1, 2, "chunk", 1, "cd"), frame("t", 1, 3, "commit", digest=d)]
    second = [frame("t", 2, 1, "chunk", 0, "ab"), frame("t", 2, 0, "begin", n=2, total=4, digest=d)]
    got = outcomes(stream_of(spark, tmp_path, [first, second], "1 second"))
    assert got == {("t", 0, "begin"): "begun", ("t", 1, "chunk"): "accepted", ("t", 2, "chunk"): "accepted", ("t", 3, "commit"): "closed"}


def test_lease_timer_comes_from_the_deadline(spark, tmp_path):
    begin = [frame("t", 1_000, 0, "begin", n=1, total=1, digest="d"), frame("u", 1_000, 0, "begin", n=1, total=1, digest="d", deadline=50_000)]
    later = [frame("u", 20_000, 1, "abort")]
    last = [frame("v", 30_000, 0, "abort")]
    got = outcomes(stream_of(spark, tmp_path, [begin, later, last]))
    assert got["t", 1, "lease"] == "failed: expired"
    assert got["u", 1, "abort"] == "failed: aborted"
    assert ("u", 1, "lease") not in got


def test_unordered_chunks_and_whole_artifact(spark, tmp_path):
    d = sha("abcd")
    rows = [frame("t", 1, 0, "begin", n=2, total=4, digest=d), frame("t", 1, 1, "chunk", 1, "cd"), frame("t", 1, 2, "chunk", 0, "ab"), frame("t", 1, 3, "commit", digest=d),
            frame("u", 1, 0, "begin", n=2, total=4, digest=d), frame("u", 1, 1, "chunk", 1, "cd"), frame("u", 1, 2, "chunk", 1, "cd")]
    got = outcomes(stream_of(spark, tmp_path, [rows]), order="unordered", finalise="whole artifact")
    assert got["t", 1, "chunk"] == "accepted" and got["t", 3, "commit"] == "closed"
    assert got["u", 1, "chunk"] == tr.DROPPED and got["u", 2, "chunk"].startswith("failed: index repeated")
    with pytest.raises(ValueError):
        tr.transfer_outcomes(spark.range(1), order="reversed")


def test_every_frame_has_an_outcome(spark, tmp_path):
    """Repeats at every stage, waiting frames of a failed stream, frames of a stream that never begins."""
    d = sha("abcd")
    windows = [
        [frame("t", 1_000, 0, "begin", n=2, total=4, digest=d), frame("t", 1_000, 2, "chunk", 1, "cd"), frame("t", 1_000, 2, "chunk", 1, "cd"),
         frame("f", 1_000, 0, "begin", n=3, total=4, digest=d), frame("f", 1_000, 3, "chunk", 2, "x"), frame("n", 1_000, 4, "chunk", 0, "x")],
        [frame("t", 2_000, 1, "chunk", 0, "ab"), frame("t", 2_000, 0, "begin", n=2, total=4, digest=d), frame("f", 2_000, 1, "abort")],
        [frame("t", 3_000, 3, "commit", digest=d), frame("t", 3_000, 2, "chunk", 1, "cd"), frame("f", 3_000, 2, "chunk", 0, "y")],
        [frame("z", 2_000_000, 0, "abort")],
    ]
    got = [r for r in all_outcomes(stream_of(spark, tmp_path, windows, "10 seconds")) if r[0] != "z"]
    assert got == sorted([
        ("t", 0, "begin", "begun"), ("t", 0, "begin", tr.REPEATED), ("t", 1, "chunk", "accepted"), ("t", 2, "chunk", "accepted"),
        ("t", 2, "chunk", tr.REPEATED), ("t", 2, "chunk", tr.REPEATED), ("t", 3, "commit", "closed"),
        ("f", 0, "begin", "begun"), ("f", 1, "abort", "failed: aborted"), ("f", 2, "chunk", tr.OVER), ("f", 3, "chunk", tr.OVER),
        ("n", 4, "chunk", tr.UNBEGUN),
    ])


@pytest.mark.parametrize("finalise", ["end of axis", "whole artifact"])
def test_transfers_share_the_state_of_their_bundle(spark, tmp_path, monkeypatch, finalise):
    """Few calls of the state store: rows of it by bundle and part, not by frame. Parts so small that one call fills several."""
    monkeypatch.setattr(tm, "BUNDLES", 2, raising=False)
    monkeypatch.setattr(tr, "PART", 3_000, raising=False)
    monkeypatch.setattr(tr, "KEEP", 3_000, raising=False)
    rng, windows, want = random.Random(3), [[], [], []], {}
    for i in range(24):
        pieces = ["".join(rng.choices("abc", k=40)) for _ in range(12)]
        text, t, fault = "".join(pieces), str(i), i % 4
        frames = [frame(t, 1_000, 0, "begin", n=12, total=480, digest=sha(text)), *(frame(t, 1_000, j + 1, "chunk", j, p) for j, p in enumerate(pieces))]
        frames.append(frame(t, 1_000, 13, "commit", digest=sha(text)))
        if fault == 1:  # the seventh chunk has another one's hash
            frames[7] = (*frames[7][:6], sha("other"), *frames[7][7:])
        elif fault == 2:  # never committed
            frames.pop()
        elif fault == 3:  # the fifth and the sixth come twice
            frames += frames[5:7]
        for f in frames:
            windows[rng.randrange(3)].append(f)
        accepted = "accepted" if fault in (0, 3) or finalise == "end of axis" else tr.DROPPED
        kept = range(1, 7) if fault == 1 else range(1, 13)
        want[t] = [(0, "begin", "begun"), *((j, "chunk", accepted) for j in kept)]
        want[t] += {1: [(7, "chunk", "failed: hash mismatch"), *((j, "chunk", tr.OVER) for j in range(8, 13)), (13, "commit", tr.OVER)],
                    2: [(13, "lease", "failed: expired")]}.get(fault, [(13, "commit", "closed")])
        want[t] += [(5, "chunk", tr.REPEATED), (6, "chunk", tr.REPEATED)] * (fault == 3)
    for i in (4, 5):
        windows.append([frame("z", 2_000_000 + i, 0, "abort")])
    rows, held = run(spark, tr.transfer_outcomes(stream_of(spark, tmp_path, windows, "10 seconds"), finalise=finalise), str(tmp_path / "out"))
    got = {t: sorted((r.seq, r.kind, r.outcome) for r in rows if r.transfer == t) for t in want}
    assert got == {t: sorted(w) for t, w in want.items()}
    assert max(held) < 24 * 12 / 4


def test_hashes_are_computed_in_the_stream(spark, tmp_path):
    """A wrong chunk hash and right chunks under a wrong total, over windows that part a transfer."""
    d = sha("abcd")
    bad = list(frame("b", 1_000, 1, "chunk", 0, "ab"))
    bad[6] = sha("other")
    first = [frame("a", 1_000, 0, "begin", n=2, total=4, digest=sha("abce")), frame("a", 1_000, 1, "chunk", 0, "ab"),
             frame("b", 1_000, 0, "begin", n=1, total=2, digest=d), tuple(bad),
             frame("c", 1_000, 0, "begin", n=2, total=4, digest=d), frame("c", 1_000, 1, "chunk", 0, "ab")]
    second = [frame("a", 1_100, 2, "chunk", 1, "cd"), frame("c", 1_100, 2, "chunk", 1, "cd")]
    third = [frame("a", 1_200, 3, "commit", digest=sha("abce")), frame("c", 1_200, 3, "commit", digest=d)]
    got = outcomes(stream_of(spark, tmp_path, [first, second, third], "10 seconds"))
    assert got["a", 3, "commit"] == "failed: commit check" and got["b", 1, "chunk"] == "failed: hash mismatch"
    assert got["c", 3, "commit"] == "closed" and got["a", 2, "chunk"] == "accepted"


def test_stream_agrees_with_batch_commit(spark, tmp_path):
    rng = random.Random(2)
    rows, transfers, chunks, commits = [], [], [], []
    for i in range(30):
        text = "x" * rng.randrange(1, 30) + str(i)
        parts = [text[k : k + 8] for k in range(0, len(text), 8)]
        fault = rng.randrange(4)
        total = len(text) + (1 if fault == 1 else 0)
        sent = parts[:-1] if fault == 2 else parts
        t = str(i)
        rows.append(frame(t, 1, 0, "begin", n=len(parts), total=total, digest=sha(text)))
        rows += [frame(t, 1, j + 1, "chunk", j, p) for j, p in enumerate(sent)]
        rows.append(frame(t, 1, len(sent) + 1, "commit", digest=sha(text)))
        transfers.append((t, "in progress", len(parts), total, sha(text), 9_000))
        chunks += [(t, j, len(p), p, sha(p)) for j, p in enumerate(sent)]
        commits.append((t, 2, sha(text)))
    rng.shuffle(rows)
    got = outcomes(stream_of(spark, tmp_path, [rows[:60], rows[60:]]))
    closed = {t for (t, _, _), outcome in got.items() if outcome == "closed"}
    batch = sa.commit_transfers(
        spark.createDataFrame(transfers, "transfer string, status string, expected_chunks long, expected_len long, expected_hash string, deadline_ms long"),
        spark.createDataFrame(chunks, "transfer string, idx long, len long, data string, hash string"),
        spark.createDataFrame(commits, "transfer string, at_ms long, aggregate_hash string"),
    )
    assert closed == {r.transfer for r in batch.filter("status = 'committed'").collect()}


def test_wait_limits(spark):
    requests = spark.createDataFrame([(1, 7, 1_000, 500), (2, 7, 1_000, 0), (3, 7, 1_000, 30_001), (4, 8, 1_000, 10), (5, 7, 1_000, 499)], "request long, id long, ms long, timeout_ms long")
    stored = spark.createDataFrame([(7, 1_500), (7, 9_000)], "id long, ms long")
    out = st.wait_for_objects_batch(
        requests.withColumn("at", F.timestamp_millis("ms")), stored.withColumn("stored_at", F.timestamp_millis("ms"))
    )
    assert {r.request: r.outcome for r in out.collect()} == {
        1: "found", 2: "timeout out of range", 3: "timeout out of range", 4: "timed out", 5: "timed out",
    }


def test_inbox_chain_is_found_from_links(spark):
    rows = [(c, f"{c}-{i}", f"{c}-{i + 1}" if i + 1 < n else None, n - 1 - i) for c, n in ((0, 17), (1, 1), (2, 64)) for i in range(n)]
    rows += [(9, "r0", "r1", None), (9, "r1", "r0", None)]
    df = spark.createDataFrame(rows, "chain long, inbox string, next_inbox string, want long").repartition(5)
    for r in om.follow_inboxes(df).collect():
        assert r.to_end == r.want


def test_monoid_order_does_not_depend_on_partitions(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i, chr(97 + i % 26)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, s string").repartition(9)
    got = {r.k: r.s for r in uf.Monoid("", lambda a, b: a + b).fold(df, "k", "i", "s").collect()}
    want = {}
    for k, _, s in rows:
        want[k] = want.get(k, "") + s
    assert got == want


def test_operation_checks_both_sides(spark):
    def shrink(frames):
        for frame in frames:
            yield frame.assign(v=[v[: len(v) // 2] for v in frame["v"]])

    df = spark.createDataFrame([(1, "f32", [1.0, 2.0]), (2, "u8", [1.0, 2.0]), (3, "f32", [1.0])], "id long, dtype string, v array<double>")
    op = uf.Operation(uf.Port("f32", 2), uf.Port("f32", 1), shrink)
    assert {r.id: r.error for r in op.run(df, ["id"]).collect()} == {1: None, 2: "input: dtype mismatch", 3: "input: dimension mismatch"}
    bad = uf.Operation(uf.Port("f32"), uf.Port("f32", 5), shrink)
    assert {r.error for r in bad.run(df.filter("id = 1"), ["id"]).collect()} == {"output: dimension mismatch"}
    with pytest.raises(NotImplementedError, match="backward"):
        op.call("backward")


def test_policy_must_give_its_columns(spark):
    with pytest.raises(ValueError, match="mean_loss"):
        uf.apply_policy(spark.range(1), lambda df: df, ["mean_loss"])


def windows_of(spark, folder, batches, schema, time):
    """A stream with one window per batch."""
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.withColumn(time, F.timestamp_millis(time)).coalesce(1).write.mode("append").parquet(folder)
    shape = spark.read.parquet(folder).schema
    return st.read_windowed(spark, shape, folder, 1, latestFirst="false")


def run(spark, outputs, folder):
    """Rows of a stream, and how many rows its state held after each window."""
    query = st.serve(outputs, lambda df: df, folder, typed_state=True)
    query.awaitTermination()
    held = [sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    return spark.read.parquet(folder).collect(), held


def test_leases_end_by_their_own_deadline(spark, tmp_path):
    begins = [
        [(1, 1_000, 600_000), (2, 1_000, 600_000), (3, 1_000, 60_000)],
        [(4, 100_000, 200_000), (5, 100_000, 900_000)],
        [(6, 650_000, 660_000)],
        [(99, 5_000_000, 6_000_000)], [(98, 5_000_000, 6_000_000)],
    ]
    closes = [
        [(3, 30_000, "aborted"), (5, 150_000, "committed")],  # one before its beginning is read
        [(1, 400_000, "committed"), (4, 200_000, "committed")],  # a close at the deadline is too late
        [(2, 601_000, "committed"), (1, 300_000, "aborted")],
        [(99, 5_000_000, "committed")], [(97, 5_000_000, "committed")],
    ]
    opened = windows_of(spark, str(tmp_path / "b"), begins, "transfer long, at long, deadline_ms long", "at")
    closed = windows_of(spark, str(tmp_path / "c"), closes, "transfer long, closed_at long, how string", "closed_at")
    rows, held = run(spark, tm.lease_outcomes(opened, closed, "1000 seconds"), str(tmp_path / "out"))
    got = {r.transfer: r.outcome for r in rows if r.transfer < 90}
    assert got == {1: "committed", 2: tm.EXPIRED, 3: "aborted", 4: tm.EXPIRED, 5: "committed", 6: tm.EXPIRED}
    assert len([r for r in rows if r.transfer < 90]) == 6 and max(held) > held[-1]


def test_leases_share_the_state_of_their_bundle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tm, "BUNDLES", 4, raising=False)
    n = 600
    opened, closed = {}, {}
    begins, closes = [[], [], [], []], [[], [], [], []]
    for t in range(n):
        opened[t] = 1_000 + t * 7 % 900 * 1_000
        begins[t % 3].append((t, 1_000, opened[t]))
        if t % 2:
            closed[t] = 1_000 + t * 11 % 800 * 1_000
            closes[t * 5 % 3].append((t, closed[t], "aborted" if t % 3 else "committed"))
            closes[t * 5 % 3].append((t, closed[t] + 1_000, "again"))
    for rows in (begins, closes):
        rows[3].append((-1, 9_000_000, 9_000_000) if rows is begins else (-1, 9_000_000, "committed"))
    begins.append([(-2, 9_000_000, 9_900_000)])
    closes.append([(-2, 9_000_000, "committed")])
    opens = windows_of(spark, str(tmp_path / "b"), begins, "transfer long, at long, deadline_ms long", "at")
    ends = windows_of(spark, str(tmp_path / "c"), closes, "transfer long, closed_at long, how string", "closed_at")
    rows, held = run(spark, tm.lease_outcomes(opens, ends, "3000 seconds"), str(tmp_path / "out"))
    got = sorted((r.transfer, r.outcome) for r in rows if r.transfer >= 0)
    want = {t: ("aborted" if t % 3 else "committed") if t in closed and closed[t] < opened[t] else tm.EXPIRED for t in opened}
    assert got == sorted(want.items())
    # State and timers by bundle, not by transfer.
    assert max(held) <= 4 * 5


def test_waits_end_by_their_own_timeout(spark, tmp_path):
    stored = spark.createDataFrame([(7, 500), (8, 2_000)], "id long, ms long").select("id", F.timestamp_millis("ms").alias("stored_at"))
    requests = [
        [(1, 7, 1_000, 10), (2, 8, 1_000, 5_000), (3, 8, 1_000, 100), (4, 9, 1_000, 0), (5, 9, 1_000, 30_001), (6, 9, 1_000, 30_000)],
        [(7, 8, 1_500, 500), (8, 8, 4_000, 30_000), (9, 7, 400, 50), (10, 7, 400, 100)],
        [(11, 10, 2_500, 30_000)],
        [(99, 1, 500_000, 5)], [(98, 1, 500_000, 5)],
    ]
    arrivals = [[(8, 2_000), (7, 500)], [(10, 32_500), (8, 9_000)], [(9, 31_001)], [(1, 500_000)], [(2, 500_000)]]
    asked = windows_of(spark, str(tmp_path / "r"), requests, "request long, id long, at long, timeout_ms long", "at")
    came = windows_of(spark, str(tmp_path / "a"), arrivals, "id long, stored_at long", "stored_at")
    rows, held = run(spark, tm.wait_for_objects(asked, came, stored, "100 seconds"), str(tmp_path / "out"))
    got = {r.request: r.outcome for r in rows if r.request < 90}
    assert got == {
        1: "found", 2: "found", 3: "timed out", 4: "timeout out of range", 5: "timeout out of range", 6: "timed out", 7: "found", 8: "found",
        9: "timed out", 10: "found", 11: "found",
    }
    assert len([r for r in rows if r.request < 90]) == 11 and max(held) > held[-1]


def test_update_mode_keeps_the_last_window_of_a_node(spark, tmp_path):
    batches = [[(0, 1), (1, 1)], [(0, 2)], [(2, 3), (0, 3)], [(1, 4)]]
    stream = windows_of(spark, str(tmp_path / "in"), batches, "node long, at long", "at")
    got = st.drain(st.progress(stream, "node"), mode="update", keys=["node"])
    assert sorted((r.node, r.completed) for r in got.collect()) == [(0, 3), (1, 2), (2, 1)]

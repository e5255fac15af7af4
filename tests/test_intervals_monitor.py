import random

import pytest
from pyspark.sql import functions as F

from tensorloom.operators import intervals as oi
from tensorloom.operators import monitor as om

EVENT = "log_id long, channel long, key long, velocity long, tick long, ordinal long, on boolean"
PAIR = "log_id long, pos long, start long, duration long, key long, velocity long, release long"
HEADER = "log_id long, ticks_per_second long, loop_ticks long, measure_ticks long"


def test_pairing(spark, ranges):
    rng = random.Random(1)
    events = [
        (0 if rng.random() < 0.7 else rng.randrange(1, 4), rng.randrange(2), rng.randrange(60, 62), rng.randrange(0, 4), rng.randrange(40), i, rng.random() < 0.6)
        for i in range(200)
    ]
    df = oi.note_events(spark.createDataFrame(events, EVENT))
    ends = df.groupBy("log_id").agg(F.lit(100).cast("bigint").alias("end_tick"))
    got = sorted((r.log_id, r.channel, r.key, r.on_tick, r.off_tick, r.on_velocity, r.off_velocity) for r in oi.pair_events(df, ends).collect())
    held, want = {}, []
    for log, channel, key, velocity, tick, _, on in sorted(events, key=lambda e: (e[4], e[5])):
        on, at = on and velocity != 0, (log, channel, key)
        if at in held:
            start, attack = held.pop(at)
            want.append((*at, start, tick, attack, 0 if on else velocity))
        if on:
            held[at] = (tick, velocity)
    want += [(*at, start, 100, attack, 0) for at, (start, attack) in held.items()]
    assert got == sorted(want)


def test_rate_map(spark, ranges):
    changes = [(0, 0, 1, 250_000), (0, 480, 2, 1_000_000), (0, 480, 3, 500_000), (0, 960, 4, 250_000), (1, 960, 5, 1_000_000)]
    df = spark.createDataFrame(changes, "log_id long, tick long, ordinal long, micros long")
    segments = oi.rate_map(df, 480)
    asked = spark.createDataFrame([(0, 240), (0, 480), (0, 1440), (1, 480), (1, 1440), (2, 480)], "log_id long, tick long")
    out = oi.seconds_at(asked, "tick", segments, 480, "s")
    got = {(r.log_id, r.tick): r.s for r in out.collect()}
    assert got == pytest.approx({(0, 240): 0.125, (0, 480): 0.25, (0, 1440): 1.0, (1, 480): 0.5, (1, 1440): 2.0, (2, 480): 0.5})


def test_grid_choice(spark):
    changes = spark.createDataFrame([(1, 0, 1, 500_000), (2, 0, 1, 700_001), (3, 5, 1, 500_000), (4, 0, 1, 7), (4, 0, 2, 1_000_000)], "log_id long, tick long, ordinal long, micros long")
    logs = spark.range(6).select(F.col("id").alias("log_id"))
    got = {r.log_id: r.ticks_per_second for r in oi.choose_grid(logs, changes, 480).collect()}
    assert got == {0: 960, 1: 960, 2: 1_000_000, 3: 1_000_000, 4: 480, 5: 960}


def score(spark, rows, headers):
    return spark.createDataFrame(rows, PAIR), spark.createDataFrame(headers, HEADER)


def test_rescale_pulls_back_overruns(spark):
    pairs, headers = score(spark, [(0, 0, 0, 5, 60, 1, None), (0, 1, 5, 6, 60, 1, None), (0, 2, 9, 1, 60, 1, None)], [(0, 1, 10, 4)])
    out, heads = oi.rescale_to_duration(pairs, headers, 5.0)
    assert [(r.start, r.duration) for r in out.orderBy("pos").collect()] == [(0, 3), (4, 1), (4, 1)]
    assert (heads.first().loop_ticks, heads.first().measure_ticks) == (5, 2)
    assert oi.rescale_to_duration(pairs, headers, 0.1)[1].first().error == "duration rounds to no tick"
    with pytest.raises(ValueError):
        oi.rescale_to_duration(pairs, headers, float("nan"))


def test_shift_skip_truncate_merge(spark):
    pairs, headers = score(spark, [(0, 0, 3, 2, 60, 1, None), (0, 1, 8, 2, 61, 1, None), (1, 0, 1, 1, 60, 1, None)], [(0, 2, 20, None), (1, 2, None, None)])
    kept, heads = oi.skip_seconds(pairs, headers, 2)
    assert [(r.log_id, r.start) for r in kept.collect()] == [(0, 4)]
    assert {r.log_id: (r.loop_ticks, r.error) for r in heads.collect()} == {0: (16, None), 1: (None, "no notes left")}
    later, heads = oi.shift_seconds(pairs, headers, 1.5)
    assert sorted(r.start for r in later.collect()) == [4, 6, 11]
    assert {r.log_id: r.loop_ticks for r in heads.collect()} == {0: 23, 1: None}
    first, heads = oi.truncate(pairs, headers, 1)
    assert sorted((r.log_id, r.pos) for r in first.collect()) == [(0, 0), (1, 0)]
    assert {r.loop_ticks for r in heads.collect()} == {None}
    merged, heads = oi.merge_logs(pairs, headers, pairs, headers.withColumn("ticks_per_second", F.lit(1).cast("bigint")))
    assert sorted((r.pos, r.start) for r in merged.filter("log_id = 0").collect()) == [(0, 3), (1, 8), (2, 6), (3, 16)]
    assert {r.log_id: r.loop_ticks for r in heads.collect()} == {0: 40, 1: 4}


def test_events_and_diagnostics_do_not_depend_on_splitting(spark, ranges):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.7 else 1, i, rng.randrange(30), rng.randrange(1, 4), rng.randrange(60, 63), rng.randrange(2), rng.choice([None, 1])) for i in range(150)]
    pairs, headers = score(spark, rows, [(0, 7, 100, 10), (1, 7, 5, 10)])
    events = oi.to_events(pairs, headers).collect()
    assert [r.error for r in events if r.log_id == 1] == ["loop precedes the last release"]
    got = [(r.nanos, r.action, r.key, r.voice) for r in sorted((r for r in events if r.log_id == 0), key=lambda r: r.sequence)]
    mine = sorted((r for r in rows if r[0] == 0), key=lambda r: (r[2], r[4], r[5], r[1]))
    def nanos(t):
        return t // 7 * 10**9 + t % 7 * 10**9 // 7
    want = []
    for voice, r in enumerate(mine, 1):
        want.append((nanos(r[2]), 0, r[4], voice))
        want.append((nanos(r[2] + r[3]), 1, r[4], voice))
    assert got == [(n, "release" if k else "attack", key, v) for n, k, key, v in sorted(want)]
    found = {(r.log_id, r.finding): r.amount for r in oi.diagnostics(pairs, headers, oi.anchors(pairs, headers)).collect()}
    copies = sum(a[2:] == b[2:] for a, b in zip(mine, mine[1:]))
    assert found[0, "duplicate pair"] == copies and (0, "stale anchors") not in found
    assert (1, "loop precedes the last release") in found and (0, "pairs not sorted") in found


def test_mutation_edits_an_exact_share(spark, ranges):
    rows = [(0, i, i * 3, 2, 60, 64, 5) for i in range(100)] + [(1, i, i, 1, 60, 64, None) for i in range(7)]
    pairs, headers = score(spark, rows, [(0, 960, None, None), (1, 960, None, None)])
    out = oi.mutate(pairs, headers, 0.3, 9).collect()
    again = oi.mutate(pairs.repartition(7), headers, 0.3, 9).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    for log, n, m in ((0, 100, 30), (1, 7, 2)):
        mine = [r for r in out if r.log_id == log]
        kept = {r.pos for r in mine}
        edited = {r.pos for r in mine if r.edit != "keep"} | (set(range(n)) - kept)
        assert len(edited) == m
        for r in mine:
            assert 21 <= r.key <= 108 and 0 <= r.velocity <= 127 and r.duration >= 1
            if r.inserted:
                assert r.pos * (3 if log == 0 else 1) <= r.start


def test_loop_repeats(spark):
    df = spark.createDataFrame([(0, 4), (9, 10)], "timestamp long, loop long")
    got = sorted((r.timestamp, r.cycle, r.due) for r in oi.due_events(df, F.lit(20_000).cast("bigint")).collect())
    want = sorted([(0, c, 4 * c) for c in range(5001)] + [(9, c, 10 * c + 9) for c in range(2000)])
    assert got == want


def test_log_line_uses_the_latest_attack(spark):
    rows = [(0, 1, 0, "attack", 0, 1.0, 60), (0, 1, 1, "attack", 10**9, 0.5, 60), (0, 1, 2, "release", 2 * 10**9, 0.1, 60), (0, 1, 3, "release", 3 * 10**9, 0.1, 60)]
    df = spark.createDataFrame(rows, "log_id long, voice long, seq long, action string, nanos long, velocity double, key long")
    assert [r.line for r in oi.log_lines(df).collect()] == ["1920 1920 C4 64 13"]


def walk(phase):
    return phase % 3 + 1


def test_pending_phases(spark, ranges):
    rng = random.Random(8)
    rows, state, seq = [], {}, {}
    for i in range(120):
        node = 0 if rng.random() < 0.7 else 1
        for _ in range(rng.randrange(0, 8)):
            state[node] = walk(state.get(node, 0))
            seq[node] = seq.get(node, 0) + 1
        back = 1 if rng.random() < 0.1 else 0
        rows.append((node, i, state.get(node, 0), max(seq.get(node, 0) - back, 0)))
    df = spark.createDataFrame(rows, "node long, i long, phase int, sequence long")
    got = {}
    for r in om.pending_phases(df, ["i"]).collect():
        got.setdefault(r.node, {})[r["rank"]] = r.shown
    for node in (0, 1):
        latest, seen, shown = 0, 0, []
        for n, _, phase, sequence in rows:
            if n != node or sequence < seen:
                continue
            path, at = [], latest
            for _ in range(sequence - seen):
                at = walk(at)
                path.append(at)
            if not path or path[-1] != phase:
                path, at = [], latest
                while at != phase:
                    at = walk(at)
                    path.append(at)
            shown += path[-4:]
            latest, seen = phase, sequence
        assert [got[node][k] for k in (4, 3, 2, 1)] == shown[-4:]


def test_frozen_flag_is_held_while_optimising(spark):
    rows = [(0, 1, 1, True), (0, 2, 2, True), (0, 3, 2, False), (0, 4, 3, False), (0, 5, 1, False), (1, 1, 3, True)]
    df = spark.createDataFrame(rows, "node long, i long, phase int, frozen boolean")
    got = {(r.node, r.i): r.shown for r in om.shown_frozen(df, ["i"]).collect()}
    assert got == {(0, 1): True, (0, 2): True, (0, 3): False, (0, 4): True, (0, 5): False, (1, 1): True}

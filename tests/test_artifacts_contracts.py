import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tensorloom.operators import contracts as oc
from tensorloom.plans import contracts_queries as cq
from tensorloom.sources import artifacts as sa
from tensorloom.sources import checkpoints as ck
from tensorloom.sources import pieces as sp


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TRANSFER = "transfer long, status string, expected_chunks long, expected_len long, expected_hash string, deadline_ms long"
ARRIVAL = "transfer long, seq long, at_ms long, idx long, data string, hash string"


def random_arrivals(seed):
    rng = random.Random(seed)
    transfers, arrivals = [], []
    for t in range(25):
        n = rng.randrange(1, 5)
        size = rng.randrange(3, 14)
        transfers.append((t, rng.choice(["in progress"] * 4 + ["aborted"]), n, size, "x", 60))
        for seq in range(rng.randrange(0, 14)):
            data = "abcdefg"[: rng.randrange(1, 7)]
            good = rng.random() < 0.8
            arrivals.append((t, seq, rng.randrange(50, 65), rng.randrange(-1, n + 1), data, sha(data) if good else "bad"))
    arrivals.append((99, 0, 1, 0, "z", sha("z")))
    return transfers, arrivals


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ingest_equals_one_by_one_handling(spark, seed):
    transfers, arrivals = random_arrivals(seed)
    out = sa.ingest_chunks(spark.createDataFrame(transfers, TRANSFER), spark.createDataFrame(arrivals, ARRIVAL))
    got = {(r.transfer, r.seq): r.error for r in out.collect()}
    known = {t[0]: t for t in transfers}
    stored = {}
    for t, seq, at, idx, data, digest in sorted(arrivals):
        if t not in known or known[t][1] != "in progress" or at >= 60:
            want = "not in progress"
        elif not 0 <= idx < known[t][2]:
            want = "index out of range"
        elif idx in stored.setdefault(t, {}):
            want = "duplicate index"
        elif sha(data) != digest:
            want = "hash mismatch"
        elif sum(stored[t].values()) + len(data) > known[t][3]:
            want = "over the declared length"
        else:
            want = None
            stored[t][idx] = len(data)
        assert got[t, seq] == want, (t, seq)
    assert len(got) == len(arrivals)


def test_streamed_hash_of_pieces(spark):
    rng = random.Random(4)
    texts = {k: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 400))) for k in range(12)}
    rows = [(k, i, text[i * 7 : i * 7 + 7]) for k, text in texts.items() for i in range(-(-len(text) // 7))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, d string").repartition(6)
    got = {r.k: r.digest for r in sp.hashes(df, ["k"], "i", "d").collect()}
    assert got == {k: sha(text) for k, text in texts.items()}
    binary = df.select("k", "i", F.col("d").cast("binary").alias("d"))
    assert {r.k: r.digest for r in sp.hashes(binary, ["k"], "i", "d").collect()} == got


def test_commit_rules(spark):
    chunks = [(1, 0, 2, "ab", sha("ab")), (1, 1, 1, "c", sha("c")), (2, 0, 2, "ab", sha("ab")), (3, 0, 2, "ab", "bad"),
              (5, 0, 2, "ab", sha("ab")), (6, 0, 2, "ab", sha("ab")), (6, 0, 2, "ab", sha("ab"))]
    transfers = [(1, "in progress", 2, 3, sha("abc"), 9), (2, "in progress", 2, 3, sha("abc"), 9), (3, "in progress", 1, 2, sha("ab"), 9),
                 (4, "in progress", 0, 0, sha(""), 9), (5, "in progress", 1, 2, sha("other"), 9), (6, "in progress", 1, 2, sha("ab"), 9),
                 (7, "in progress", 0, 0, sha(""), 1)]
    commits = [(t[0], 5, t[4]) for t in transfers] + [(8, 5, "x")]
    out = sa.commit_transfers(
        spark.createDataFrame(transfers, TRANSFER),
        spark.createDataFrame(chunks, "transfer long, idx long, len long, data string, hash string"),
        spark.createDataFrame(commits, "transfer long, at_ms long, aggregate_hash string"),
    )
    got = {r.transfer: (r.status, r.error) for r in out.collect()}
    assert got[1] == ("committed", None) and got[4] == ("committed", None)
    assert {t: e for t, (_, e) in got.items() if e} == {
        2: "chunks incomplete", 3: "chunk failed validation", 5: "total hash differs", 6: "chunks incomplete",
        7: "not in progress", 8: "not in progress",
    }


def test_ranges_and_reassembly(spark):
    objects = spark.createDataFrame([(1, bytearray(b"0123456789"))], "id long, data binary")
    ranges = spark.createDataFrame([(1, 8, 5), (1, 20, 2), (1, 3, 2), (2, 0, 0), (2, 0, 1)], "id long, offset long, length long")
    got = [(r.id, r.offset, bytes(r.piece) if r.piece is not None else None, r.error) for r in sa.read_ranges(ranges, objects, "data").collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 8, b"89", None), (1, 20, b"", None), (1, 3, b"34", None), (2, 0, b"", None), (2, 0, None, "object not found")], key=str
    )


def test_ranges_over_pieces_of_any_length(spark):
    rng = random.Random(3)
    whole = {k: bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 300, 2000]))) for k in range(8)}
    rows = []
    for k, data in whole.items():
        at = 0
        while at < len(data):
            n = rng.choice([1, 2, 50, 700])
            rows.append((k, at, bytearray(data[at : at + n])))
            at += n
    pieces = spark.createDataFrame(rows, "id long, start long, data binary")
    objects = spark.createDataFrame([(k, len(d)) for k, d in whole.items()], "id long, extent long")
    asked = [(rng.randrange(9), rng.choice([0, 3, 299, 300, 1 << 62]), rng.choice([0, 1, 10, 1500, 1 << 62]), i) for i in range(150)]
    ranges = spark.createDataFrame(asked, "id long, offset long, length long, n long")
    for width in (1, 64, 1 << 20):
        got = {}
        for r in sp.read_ranges(ranges, objects, pieces, "data", width).collect():
            got.setdefault(r.n, []).append((r.at, None if r.data is None else bytes(r.data), r.error))
        for k, offset, length, i in asked:
            parts = sorted(got[i], key=lambda x: x[0])
            if k == 8 and length:
                assert parts == [(0, None, "object not found")]
                continue
            want = whole.get(k, b"")[offset : offset + length]
            assert b"".join(p[1] for p in parts) == want and all(p[2] is None for p in parts)
            assert [p[0] for p in parts] == [sum(len(q[1]) for q in parts[:j]) for j in range(len(parts))]


def test_reassembly_of_reads(spark, ranges):
    reads = [(1, 0, "ab"), (1, 2, "cd"), (1, 4, ""), (2, 0, ""), (3, 0, "ab"), (3, 3, "d"), (4, 0, "abc"), (4, 2, "cd"), (5, 2, "x"), (6, 0, "y")]
    df = spark.createDataFrame(reads, "id long, offset long, data string")
    objects, pieces = sp.reassemble(df, "data")
    gap = "ranges do not cover the object"
    assert {r.id: (r.pieces, r.size, r.error) for r in objects.collect()} == {
        1: (2, 4, None), 2: (0, 0, None), 3: (2, 3, gap), 4: (2, 5, gap), 5: (1, 1, gap), 6: (1, 1, None),
    }
    assert sorted(map(tuple, pieces.collect())) == [(1, 0, "ab"), (1, 2, "cd"), (6, 0, "y")]


def test_checkpoint_sink(spark, tmp_path):
    folder = str(tmp_path / "c")
    rows = spark.range(0, 9).withColumn("step", F.col("id") % 5)
    assert ck.write_checkpoints(rows, "step", 2, folder) == [2, 4] == ck.steps(spark, folder)
    assert ck.write_checkpoints(rows, "step", 0, folder) == []
    assert sorted(r.id for r in ck.read_checkpoint(spark, folder).collect()) == [4]
    assert sorted(r.id for r in ck.read_checkpoint(spark, folder, 2).collect()) == [2, 7]
    # A step that is saved again leaves one copy; a step without its manifest, or short of rows, is not there.
    again = spark.createDataFrame([(70, 4), (71, 4)], "id long, step long")
    assert ck.write_checkpoints(again, "step", 4, folder) == [4]
    assert sorted(map(tuple, ck.read_checkpoint(spark, folder).collect())) == [(70, 4), (71, 4)]
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if not p.name.startswith(".")) == ["step=2", "step=4"]
    (tmp_path / "c" / "step=4" / ck.MANIFEST).write_text((tmp_path / "c" / "step=4" / ck.MANIFEST).read_text().replace('"rows": 2', '"rows": 3'))
    for crc in (tmp_path / "c" / "step=4").glob("._manifest*"):
        crc.unlink()
    assert {r.step for r in ck.read_checkpoint(spark, folder).collect()} == {2}
    with pytest.raises(FileNotFoundError):
        ck.read_checkpoint(spark, folder, 3)


def test_resent_part_replaces(spark):
    uploads = spark.createDataFrame([(1, 2), (2, 2), (3, 0), (4, 1)], "id long, part_count long")
    parts = spark.createDataFrame(
        [(1, 1, 0, "aa"), (1, 2, 1, "b"), (1, 1, 2, "c"), (2, 1, 0, "x"), (2, 3, 1, "y"), (3, 1, 0, "z"), (1, 0, 5, "q")],
        "id long, part long, seq long, data string",
    )
    judged, pieces, refused = sa.assemble_parts(uploads, parts, "data")
    assert {r.id: (r.error, r.size, r.refused) for r in judged.collect()} == {
        1: (None, 2, 1), 2: ("parts incomplete", None, 0), 3: ("part count out of range", None, 0),
        4: ("upload never begun", None, 0),
    }
    assert sorted(map(tuple, pieces.collect())) == [(1, 1, 0, "c"), (1, 2, 1, "b")]
    assert [tuple(r) for r in refused.collect()] == [(1, 0, 5, "part number out of range")]


def test_audit_order_of_rules(spark):
    rows = [
        (1, 0, "scores", "f32", [2, 3]), (1, 1, "noise", "f32", [1]), (1, 2, "scores", "f32", [2, 3]),
        (2, 0, "noise", "f32", [1]), (2, 1, "embedding", "f64", [64]),
        (3, 0, "embedding", "f64", [8, 8]), (3, 1, "mask", "u8", [2]), (3, 2, "scores", "f32", [2, 3]),
        (4, 0, "embedding", "f32", [64]), (4, 1, "mask", "u8", [2]), (4, 2, "scores", "f32", [3, 3]),
        (5, 0, "embedding", "f32", [64]), (5, 1, "mask", "u8", [2]), (5, 2, "scores", "f32", [2, 9]),
    ]
    tensors = spark.createDataFrame(rows, "artifact long, pos int, name string, dtype string, shape array<bigint>")
    tagged = tensors.withColumn("contract", F.lit("vectors")).withColumn("side", F.lit("input"))
    artifacts = tagged.select("artifact", "contract", "side").distinct()
    got = {r.artifact: r.error for r in oc.audit_bundles(artifacts, tagged, cq.ports(spark)).collect()}
    assert got == {1: "duplicate scores", 2: "unexpected noise", 3: "dtype embedding", 4: "symbolic scores", 5: None}


def test_frame_lengths_cannot_overflow(spark):
    big = F.lit(2**62)
    row = spark.range(1).select(oc.frame_fault(F.lit(100), F.lit(10), big, big).alias("e")).first()
    assert row.e == "length mismatch"

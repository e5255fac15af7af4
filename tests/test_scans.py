"""Ordered scans against plain Python, over many ranges and few."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tensorloom.operators import training as tr
from tensorloom.plans import scans

KEYS, ORDER = ["k"], ["t", "i"]


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}"
        out.append((key, rng.randrange(60), i, rng.choice([None, 1, 2, 5]), rng.randrange(-3, 4)))
    return out


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "k string, t long, i long, v long, d long").repartition(7)


def test_running_total_and_row_numbers(df, data, ranges):
    got = {r.i: (r.s, r.rn) for r in scans.row_numbers(
        scans.running_total(df, KEYS, ORDER, {"s": F.col("v")}), KEYS, ORDER, "rn"
    ).collect()}
    for group in by_key(data).values():
        total = None
        for n, r in enumerate(group, 1):
            if r[3] is not None:
                total = (total or 0) + r[3]
            assert got[r[2]] == (total, n)


@pytest.mark.parametrize("step", [1, -1])
def test_neighbours(df, data, ranges, step):
    got = {r.i: (r.ni, r.nv) for r in scans.neighbours(
        df, KEYS, ORDER, {"ni": "i", "nv": "v"}, step
    ).collect()}
    for group in by_key(data).values():
        for n, r in enumerate(group):
            other = n + step
            want = (group[other][2], group[other][3]) if 0 <= other < len(group) else (None, None)
            assert got[r[2]] == want


def test_last_known_and_running_min(df, data, ranges):
    known = {r.i: r.lv for r in scans.last_known(df, KEYS, ORDER, {"lv": "v"}).collect()}
    low = {r.i: r.m for r in scans.running_min(df, KEYS, ORDER, "d", "m").collect()}
    for group in by_key(data).values():
        last, least = None, None
        for r in group:
            last = r[3] if r[3] is not None else last
            assert known[r[2]] == last
            assert low[r[2]] == least
            least = r[4] if least is None else min(least, r[4])


def test_shuffled_rank_is_a_permutation_and_stable(df):
    a = scans.shuffled_rank(df.select("i"), 3, "i", "p").collect()
    b = scans.shuffled_rank(df.select("i").repartition(3), 3, "i", "p").collect()
    assert sorted(r.p for r in a) == list(range(len(a)))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_digest_cutoff_picks_exactly_n(df):
    drawn = df.select(scans.digest(4, "i").alias("_d"))
    for n in (0, 1, 17, 400):
        cut = scans.digest_cutoff(drawn, F.lit(n))
        assert drawn.filter(F.col("_d") <= cut).count() == n


def test_session_audit_against_state_machine(spark, ranges):
    rng = random.Random(5)
    log = []
    for i in range(500):
        inst = 0 if rng.random() < 0.7 else rng.randrange(1, 9)
        log.append((inst, i, rng.choice(["up", "infer", "down", "optimise"])))
    out = tr.session_audit(spark.createDataFrame(log, "instance long, seq long, command string"))
    got = {r.seq: (r.state, r.legal) for r in out.collect()}
    states = {}
    for inst, seq, command in log:
        state = states.get(inst, "idle")
        need = {"up": "idle", "down": "awaits down", "optimise": "awaits update"}.get(command)
        legal = need is None or state == need
        assert got[seq] == (state, legal), (inst, seq)
        if command == "infer":
            state = "awaits down" if state in ("after up", "awaits down") else "awaits update"
        elif legal:
            state = {"up": "after up", "down": "after down", "optimise": "idle"}[command]
        states[inst] = state


def test_match_passes_is_fifo(spark, ranges):
    rng = random.Random(6)
    log = [(0 if rng.random() < 0.6 else rng.randrange(1, 6), i, rng.choice(["forward", "backward"])) for i in range(300)]
    out = tr.match_passes(spark.createDataFrame(log, "instance long, seq long, kind string"))
    got = sorted((r.forward_seq, r.backward_seq, r.status) for r in out.collect() if r.forward_seq is not None)
    orphans = sorted(r.backward_seq for r in out.collect() if r.forward_seq is None)
    queues, want, lost = {}, {}, []
    for inst, seq, kind in log:
        queue = queues.setdefault(inst, [])
        if kind == "forward":
            queue.append(seq)
            want[seq] = None
        elif queue:
            want[queue.pop(0)] = seq
        else:
            lost.append(seq)
    assert got == sorted((f, b, "pending" if b is None else "matched") for f, b in want.items())
    assert orphans == lost


def spread_over_tasks(laid):
    """Rows per task of a window over the layout."""
    sizes = laid.df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return [r["count"] for r in sizes]


def place(i: int, kind: str):
    far = 10**6 if i == 0 else i
    return {
        "bigint": 1_700_000_000_000_000_000 + far, "string": f"{far:08d}", "double": far / 7, "tied": 5,
        "timestamp": dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=far), "decimal(38,18)": Decimal(far) / 1000,
        "array<int>": [far // 10, far % 10], "date": dt.date(2020, 1, 1) + dt.timedelta(days=i % 700), "null": None,
    }[kind]


@pytest.mark.parametrize("kind", ["bigint", "string", "double", "tied", "timestamp", "decimal(38,18)", "array<int>", "date", "null"])
def test_one_key_with_most_rows_is_spread_evenly(spark, kind):
    """90 % of the rows in one key, one value far off, orders of any type, ties and NULLs."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        rows = [("hot" if i % 10 else None, place(i, kind), i) for i in range(4000)]
        type_ = {"tied": "int", "null": "int"}.get(kind, kind)
        df = spark.createDataFrame(rows, f"k string, t {type_}, v bigint").repartition(5)
        laid = scans.lay_out(df, ["k"], ["t"])
        sizes = spread_over_tasks(laid)
        assert sum(sizes) == 4000 and len(sizes) >= 7 and max(sizes) <= 2 * 4000 / len(sizes)
        got = scans.running_total(df, ["k"], ["t"], {"s": F.col("v")}).collect()
        for key in ("hot", None):
            mine = sorted((r for r in got if r.k == key), key=lambda r: r.s)
            assert mine[-1].s == sum(v for k, _, v in rows if k == key)
            steps = [b.s - a.s for a, b in zip(mine, mine[1:])]
            assert [mine[0].s, *steps] == [r.v for r in mine] or len({r.s for r in mine}) < len(mine)
            if kind not in ("tied", "null"):
                assert [r.t for r in mine if r.v] == sorted(r.t for r in mine if r.v)
        plan = scans.running_total(laid.df, ["k"], ["t"], {"s": F.col("v")}, laid)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_lay_block" not in plan.split("Window")[1].split("BroadcastExchange")[0]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_falling_order_and_no_keys(df, data, ranges):
    got = {r.i: r.n for r in scans.row_numbers(df, [], ["-t", "i"], "n").collect()}
    for n, r in enumerate(sorted(data, key=lambda r: (-r[1], r[2])), 1):
        assert got[r[2]] == n


def test_first_rows_rank_a_few_per_task(spark, df, data, ranges):
    for count in (0, 3, 2000):
        got = sorted((r.k, r.i) for r in scans.first_rows(df, KEYS, ORDER, count).collect())
        assert got == sorted((k, r[2]) for k, group in by_key(data).items() for r in group[:count])
    plan = scans.first_rows(df, KEYS, ORDER, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan.split("Exchange")[1] or "WindowGroupLimit" in plan.split("hashpartitioning")[1]


def test_scans_of_an_empty_table(spark, ranges):
    empty = spark.createDataFrame([], "k string, t long, i long, v long, d long")
    assert scans.running_total(empty, KEYS, ORDER, {"s": F.col("v")}).collect() == []
    assert scans.neighbours(empty, KEYS, ORDER, {"n": "v"}, 1).collect() == []


def test_scans_take_any_column_names(df, data, ranges):
    """Columns of the caller named like those that scans use for the ends of ranges."""
    named = df.select("k", F.col("t").alias("_first"), F.col("i").alias("_last"), F.col("v").alias("_b"))
    got = {r["_last"]: (r["_first"], r["_b"], r.rn) for r in scans.row_numbers(named, KEYS, ["_first", "_last"], "rn").collect()}
    for group in by_key(data).values():
        assert [got[r[2]] for r in group] == [(r[1], r[3], n) for n, r in enumerate(group, 1)]

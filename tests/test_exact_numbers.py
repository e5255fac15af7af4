"""Integer results for values that doubles and short decimals cannot hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.functions.cols import whole_div
from tensorloom.operators import intervals
from tensorloom.sources import artifacts

TOP = 9223372036854775807


def test_division_is_exact(spark):
    values = [(TOP, 3), (TOP, 7), (1 << 53, 1), ((1 << 60) + 1, 2), (5, 8)]
    df = spark.createDataFrame(values, "a bigint, b bigint")
    got = df.select(whole_div("a", F.col("b")), intervals.exact_div(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(a // b, a // b) for a, b in values]


def test_rescaling_does_not_round_twice(spark):
    values = [(1499999, 3000000, 1), (1500000, 3000000, 1), (10**7 - 1, 10**7 + 1, 3), (TOP // 4, TOP // 2, TOP // 3), (0, 5, 9)]
    df = spark.createDataFrame(values, "t bigint, old bigint, new bigint")
    got = df.select(intervals.rescale_ticks(F.col("t"), F.col("old"), F.col("new"))).collect()
    assert [r[0] for r in got] == [(t * new + old // 2) // old for t, old, new in values]


def test_time_of_large_ticks(spark):
    values = [(TOP, 480), (TOP - 1, 1_000_000), (1 << 54, 3)]
    df = spark.createDataFrame(values, "t bigint, g bigint")
    got = df.select(*intervals.exact_time(F.col("t"), F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(t // g, t % g * 10**9 // g) for t, g in values]


def test_range_past_the_end(spark):
    df = spark.createDataFrame([("abcdef", 2, 3), ("abcdef", 1 << 40, 3), ("abcdef", 4, 1 << 40)], "d string, o bigint, n bigint")
    got = df.select(artifacts.byte_range("d", F.col("o"), F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == ["cde", "", "ef"]

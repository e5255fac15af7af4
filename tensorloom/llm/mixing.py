"""Entropy balancing: document rates that meet token targets per source.

Of all rates with the targeted words per source, the ones nearest to "every
document once" in relative entropy are ``min(most, exp(lambda_s * size))``. The
dual has one variable a source and is convex; Newton steps for all sources run
together, each as one aggregation over (source, size) counts. Documents of one
source and size share a rate, so rates become copies by passing the rounding
error on from larger to smaller sizes.

No step collects documents or sources: tables of scalars aside, the driver sees
sums. A corpus of W words has at most sqrt(2 W) different sizes a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.texts import shared_folder, slices, text_rows

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2
ROUNDS = 80
WITHIN_WORDS = 0.25
WITHIN_SHARE = 1e-9
FULL = 1e300

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each value of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8, last - first, first)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = offsets[:-1] - first
    full = starts[offsets[1:] > offsets[:-1]]
    begins[full] = ~space[full]
    before = np.concatenate([[0], np.cumsum(begins)])
    return before[offsets[1:] - first] - before[starts]


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words and ``draw``, a digest of id and text."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = F.col(f"`{source_col}`").cast("string").alias("source")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "data"):
            words = pa.array(word_counts(part.column("data")), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), words, part.column("mark"), part.column("at")],
                ["doc_id", "source", "size", "mark", "at"],
            )

    rows = text_rows(docs, id_col, text_col, source, F.crc32(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(bytearray()))).alias("mark"), F.monotonically_increasing_id().alias("at"))
    return (
        rows.mapInArrow(count, f"doc_id {kind}, source string, size bigint, mark bigint, at bigint")
        .select("doc_id", "source", "size", F.xxhash64("doc_id", "mark").alias("draw"), "at")
    )


class Tables:
    """Steps written into one shared folder and read back with a known schema."""

    def __init__(self, spark):
        self.spark, self.folder, self.count = spark, shared_folder(spark, "mix"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def ranked_sources(counted: DataFrame, tables: Tables, weights: Sequence[int]) -> DataFrame:
    """Sources with a number by code point (NULL last) and their weight."""
    order = [F.col("source").isNull(), F.col("source")]
    # Sizes at most 2^63 in sum; squares are for the scale of the tilt alone.
    found = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size").cast("double") ** 2).alias("squares"))
    ranged = tables.keep(found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # One row per task.
    starts, before = [], 0
    for row in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((row["part"], before))
        before += row["count"]
    tasks = tables.spark.createDataFrame(starts, "part bigint, before bigint")
    number = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    joined = ranged.withColumn("part", part).join(F.broadcast(tasks), "part").withColumn("k", number)
    return tables.keep(joined.select("k", "source", "source_size", "squares", weight.alias("weight")))


def with_targets(sources: DataFrame, share: Fraction, most: int) -> DataFrame:
    """Targets in proportion to the weights; what exceeds ``most`` times a source is shared out again.

    Each round fixes all sources above their limit at it, and the level of the
    others rises; no round takes one back.
    """
    whole = Fraction(int(sources.agg(F.sum("source_size")).first()[0] or 0)) * share
    limit, weight = F.col("source_size") * most, F.col("weight").cast("double")
    level, fixed = 0.0, -1
    while True:
        above = limit < weight * level if fixed >= 0 else F.lit(False)
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("taken"), F.count(F.when(above, 1)).alias("n"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == fixed or not row["open"]:
            break
        fixed, level = row["n"], float((whole - int(row["taken"])) / int(row["open"]))
    return sources.withColumn("target", F.least(limit.cast("double"), weight * level))


def balanced(histogram: DataFrame, sources: DataFrame, tables: Tables, most: int) -> DataFrame:
    """The dual variable ``tilt`` of every source, by Newton steps inside a bracket.

    ``histogram``: k, size, n. A step aggregates the tilted words of a source and
    their derivative. Steps that leave the bracket, or shrink the gap by less
    than half, are replaced by halving it.
    """
    state = tables.keep(sources.select(
        "k", "target", F.col("source_size").cast("double").alias("words"),
        F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).otherwise(1.0).alias("unit"),
        F.when((F.col("target") >= F.col("source_size") * most) & (F.col("source_size") > 0), FULL).otherwise(0.0).alias("tilt"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("gap"),
        ((F.col("target") >= F.col("source_size") * most) | (F.col("source_size") == 0)).alias("done"),
    ))
    for _ in range(ROUNDS):
        if state.filter(~F.col("done")).isEmpty():
            break
        words = F.col("size") * F.col("n")
        rate, raw = tilted(most), F.col("tilt") * F.col("size") / F.col("unit")
        sums = (
            histogram.join(state.filter(~F.col("done")).select("k", "tilt", "unit"), "k").groupBy("k")
            .agg(F.sum(words * rate).alias("_sum"), F.sum(F.when(raw < math.log(most), words * rate * F.col("size") / F.col("unit")).otherwise(0.0)).alias("_slope"))
        )
        off = F.col("_sum") - F.col("target")
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.col("_off") / F.nullif(F.col("_slope"), F.lit(0.0))
        inside = F.coalesce(newton > F.col("_low"), F.lit(True)) & F.coalesce(newton < F.col("_high"), F.lit(True))
        falls = F.coalesce(F.abs("_off") <= F.col("gap") / 2, F.lit(True))
        halved = (
            F.when(F.col("_low").isNull(), F.least(F.col("tilt") * 2, F.col("tilt") - 1))
            .when(F.col("_high").isNull(), F.greatest(F.col("tilt") * 2, F.col("tilt") + 1))
            .otherwise((F.col("_low") + F.col("_high")) / 2)
        )
        near = F.abs("_off") <= F.greatest(F.lit(WITHIN_WORDS), F.col("target") * WITHIN_SHARE)
        tight = F.coalesce(F.col("_high") - F.col("_low") <= 1e-15 * F.abs("tilt"), F.lit(False))
        moved = state.join(sums, "k", "left").withColumns({"_off": off, "_low": low, "_high": high}).select(
            "k", "target", "words", "unit",
            F.when(F.col("done") | near | tight, F.col("tilt")).when((F.col("_slope") > 0) & inside & falls, newton).otherwise(halved).alias("tilt"),
            F.col("_low").alias("low"), F.col("_high").alias("high"), F.abs("_off").alias("gap"),
            (F.col("done") | F.coalesce(near | tight, F.lit(False))).alias("done"),
        )
        state = tables.keep(moved)
    return state


def tilted(most: int) -> Column:
    """Rate of a document: the exponential of its tilt, at most ``most``."""
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("unit"), F.lit(math.log(most) + 1))))


def rounded(classes: DataFrame, most: int) -> DataFrame:
    """Copies of all documents of a source and size together, sizes falling.

    What a size takes too much or too little is passed on to the next smaller
    one, so a source ends off its target by about half its smallest document,
    as far as 0 to ``most`` copies allow.
    """

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, over = None, 0.0
        for batch in batches:
            k, size, n, rate = (batch.column(c).to_pylist() for c in ("k", "size", "n", "rate"))
            copies = []
            for key, words, count, r in zip(k, size, n, rate):
                if key != now:
                    now, over = key, 0.0
                if words:
                    wanted = over + words * count * r
                    take = min(most * count, max(0, round(wanted / words)))
                    over = wanted - take * words
                else:
                    take = count
                copies.append(take)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("size"), pa.array(copies, pa.int64())], ["k", "size", "copies"])

    ordered = classes.repartition("k").sortWithinPartitions("k", F.desc("size"))
    return ordered.mapInArrow(deal, "k bigint, size bigint, copies bigint")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Whole copies of documents, 0 to ``most`` each, that meet word targets per source.

    Sources by code point (a NULL source last) have the weights in turn and
    together get ``share`` times all words; none gets more than ``most`` times
    its own words, and the rest goes to the others.

    Returns per row ``doc_id``, ``source``, ``size``, ``source_size``,
    ``target``, ``rate``, ``copies`` and ``taken`` (words of all copies).
    Documents without words (NULL or empty text too) are taken once and count
    nothing. Rows with one id, and equal rows, are documents of their own; which
    of one source and size get a copy more follows from digests of id and text,
    and of equal rows from their place in the input. Other columns are ignored,
    whatever their names. An empty table gives no rows; without any words all
    targets are 0.
    """
    if share > most:
        raise ValueError("more words are asked for than the copies can give")
    tables = Tables(docs.sparkSession)
    counted = tables.keep(sizes(docs, id_col, text_col, source_col))
    sources = tables.keep(with_targets(ranked_sources(counted, tables, weights), share, most))
    # Equal sizes of a source lie together, over as many tasks as they need.
    place = ["source", "size", "draw", "at"]
    rows = tables.keep(
        counted.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "source", "size", F.monotonically_increasing_id().alias("row"))
    )
    part = F.shiftright("row", 33)
    found = rows.groupBy("source", "size", part.alias("part")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    keyed = sources.select("k", F.col("source").alias("_source"))
    runs = tables.keep(found.join(keyed, found["source"].eqNullSafe(keyed["_source"])).select("k", "source", "size", "part", "first", "n"))
    histogram = tables.keep(runs.groupBy("k", "size").agg(F.sum("n").alias("n")))
    tilts = balanced(histogram, sources, tables, most).select("k", "tilt", "unit")
    classes = tables.keep(histogram.join(tilts, "k").select("k", "size", "n", tilted(most).alias("rate")))
    dealt = rounded(classes, most).join(classes.withColumnRenamed("n", "_n"), ["k", "size"])
    # A class has one run in a task at most, so these windows are as long as there are tasks.
    earlier = Window.partitionBy("k", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(dealt, ["k", "size"])
    shares = placed.join(sources.select("k", "source_size", "target"), "k").select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("part").alias("_part"),
        (F.col("before") - F.col("first")).alias("_shift"), F.expr("copies div _n").alias("_each"), (F.col("copies") % F.col("_n")).alias("_more"),
        "source_size", "target", "rate",
    )
    same = (part == F.col("_part")) & (F.col("size") == F.col("_size")) & F.col("source").eqNullSafe(F.col("_source"))
    copies = F.col("_each") + F.when(F.col("row") + F.col("_shift") < F.col("_more"), 1).otherwise(0)
    return rows.join(shares, same).withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )

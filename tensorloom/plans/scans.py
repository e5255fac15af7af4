"""Ordered scans over keyed rows, by one plan for all sizes and orderable types.

A window partitioned by a key puts all rows of that key into one task. Here rows
are laid out in ranges of (keys, order columns, input place), so a key fills as
many ranges as it needs, whatever the types and however many rows tie. A window
runs per (range, key), and what earlier or later ranges contribute arrives as a
carry with one row per range. Only the last key of a range can go on in the next
one, so carries have as many rows as there are ranges: they are broadcast, and
where no key crosses a border there is none.

NULL keys form a key of their own; NULLs come first in the order. An order column
written with a leading ``-`` falls. Rows that compare equal stand in the order
of the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tensorloom.functions.draws import digest
from tensorloom.session import durable

# Range, place in the whole order, and whether a row's key comes from or goes on in another range.
BLOCK, AT, HEAD, TAIL = "_lay_block", "_lay_at", "_lay_head", "_lay_tail"
MARKS = [BLOCK, AT, HEAD, TAIL]


@dataclass(frozen=True)
class Laid:
    """Rows in ranges, with the marks that scans need.

    ``borders`` has a row per range whose first key comes from an earlier range:
    ``block``, the range before it ``prev``, and ``run``, which the borders that
    one key crosses share. None where no key crosses one.
    """

    df: DataFrame
    keys: tuple[str, ...]
    borders: DataFrame | None

    def settle(self, df: DataFrame) -> DataFrame:
        """Between two scans of a chain: with carries a scan reads its input twice."""
        return df if self.borders is None else durable(df)

    def window(self) -> WindowSpec:
        return Window.partitionBy(BLOCK, *self.keys).orderBy(AT)

    def carry(self, df: DataFrame, values: dict[str, Column], running: dict[str, Column], back: bool = False) -> DataFrame:
        """What the ranges on the other side of a border hold of the key that crosses it.

        ``values`` aggregate the key's rows within a range, ``running`` combine
        them over its ranges up to the border, or from it on with ``back``.
        """
        here, there, side = ("prev", "block", HEAD) if back else ("block", "prev", TAIL)
        found = df.filter(side).groupBy(BLOCK).agg(*[v.alias(n) for n, v in values.items()])
        borders = self.borders.select("run", F.col(here).alias("_here"), F.col(there).alias(BLOCK))
        return borders.join(found, BLOCK, "left").select(F.col("_here").alias(BLOCK), *[c.alias(n) for n, c in running.items()])

    def with_carry(self, local: DataFrame, carry: DataFrame) -> DataFrame:
        return local.join(F.broadcast(carry), BLOCK, "left")


def _so_far(back: bool = False) -> WindowSpec:
    """The borders one key crosses up to this one: fewer than there are ranges."""
    return Window.partitionBy("run").orderBy(F.desc("_here") if back else F.asc("_here")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Laid:
    """Rows sorted into ranges of (keys, order), kept by a checkpoint.

    Limits of ranges come from Spark's own sampling of the sort columns, to
    which the place in the input belongs: rows that compare equal are spread as
    well. The driver sees numbers of ranges alone.
    """
    keys = tuple(keys)
    sort = [*map(F.asc, keys), *[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order], F.asc("_lay_tie")]
    ranged = df.withColumn("_lay_tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    # Ranges are not the same when they are computed again, so they are kept.
    kept = durable(ranged.drop("_lay_tie").withColumns({BLOCK: F.spark_partition_id(), AT: F.monotonically_increasing_id()}))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("k"))
    # One row per range from here on.
    ends = durable(kept.groupBy(BLOCK).agg(F.min_by(key, AT).alias("_first"), F.max_by(key, AT).alias("_last")))
    inorder = Window.orderBy(BLOCK)
    crossed = F.coalesce(F.lag("_last").over(inorder).eqNullSafe(F.col("_first")) & F.lag(BLOCK).over(inorder).isNotNull(), F.lit(False))
    linked = ends.withColumn("_in", crossed).withColumns({"prev": F.lag(BLOCK).over(inorder), "_out": F.coalesce(F.lead("_in").over(inorder), F.lit(False))})
    fresh = ~(F.lag("_in").over(inorder) & F.lag("_first").over(inorder).eqNullSafe(F.lag("_last").over(inorder)))
    counted = linked.withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(inorder))
    numbers = counted.select(F.col(BLOCK).alias("block"), "prev", "run", "_in").collect()
    blocks = max((r["block"] for r in numbers), default=0) + 1
    borders = [(r["block"], r["prev"], r["run"]) for r in numbers if r["_in"]]
    # They meet the caller's columns, whose names are any others.
    at, first, last = "_lay_of", "_lay_first", "_lay_last"
    edges = counted.select(F.col(BLOCK).alias(at), F.when(F.col("_in"), F.col("_first")).alias(first), F.when(F.col("_out"), F.col("_last")).alias(last))
    if borders:
        marks = {m: F.col(c).isNotNull() & F.col(c).eqNullSafe(key) for m, c in ((HEAD, first), (TAIL, last))}
        marked = kept.join(F.broadcast(edges), F.col(BLOCK) == F.col(at)).withColumns(marks).drop(at, first, last)
    else:
        marked = kept.withColumns({HEAD: F.lit(False), TAIL: F.lit(False)})
    listed = df.sparkSession.createDataFrame(borders, "block int, prev int, run bigint") if borders else None
    # The number of the range is the number of the task, so windows need no shuffle of their own.
    return Laid(marked.repartitionById(blocks, F.col(BLOCK)), keys, listed)


def _input(df: DataFrame, keys: Sequence[str], order: Sequence[str], laid: Laid | None) -> tuple[DataFrame, Laid, list[str]]:
    """Rows with marks, their layout, and marks that the caller does not want back."""
    if laid is not None:
        return df, laid, []
    laid = lay_out(df, keys, order)
    return laid.df, laid, MARKS


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column], laid: Laid | None = None
) -> DataFrame:
    """Inclusive running sums of the given expressions, by name."""
    df, laid, extra = _input(df, keys, order, laid)
    kept = [c for c in df.columns if c not in totals and c not in extra]
    names = list(totals)
    valued = df.withColumns({f"_v_{n}": value for n, value in totals.items()})
    window = laid.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = valued.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(window) for n in names})
    if laid.borders is None:
        return local.select(*kept, *[F.col(f"_s_{n}").alias(n) for n in names])
    carry = laid.carry(
        valued, {f"_t_{n}": F.sum(f"_v_{n}") for n in names}, {f"_c_{n}": F.sum(f"_t_{n}").over(_so_far()) for n in names}
    )
    own, far = (lambda n: F.col(f"_s_{n}")), (lambda n: F.when(F.col(HEAD), F.col(f"_c_{n}")))
    return laid.with_carry(local, carry).select(*kept, *[F.coalesce(own(n) + far(n), own(n), far(n)).alias(n) for n in names])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, laid: Laid | None = None
) -> DataFrame:
    """1-based position of each row within its key."""
    return running_total(df, keys, order, {name: F.lit(1).cast("bigint")}, laid)


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], step: int, laid: Laid | None = None
) -> DataFrame:
    """Next (``step=1``) or previous (``step=-1``) row's columns, as name -> column."""
    if step not in (1, -1):
        raise ValueError("step is 1 or -1")
    df, laid, extra = _input(df, keys, order, laid)
    kept = [c for c in df.columns if c not in values and c not in extra]
    packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    shift = F.lead if step == 1 else F.lag
    local = df.withColumn("_near", shift(packed).over(laid.window()))
    if laid.borders is not None:
        back = step == 1
        edge, crosses = (F.min_by, TAIL) if back else (F.max_by, HEAD)
        carry = laid.carry(df, {"_edge": edge(packed, AT)}, {"_far": F.last("_edge", ignorenulls=True).over(_so_far(back))}, back)
        local = laid.with_carry(local, carry).withColumn("_near", F.coalesce("_near", F.when(F.col(crosses), F.col("_far"))))
    return local.select(*kept, *[F.col("_near").getField(n).alias(n) for n in values])


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], laid: Laid | None = None
) -> DataFrame:
    """Latest non-NULL value at or before each row, as name -> column."""
    df, laid, extra = _input(df, keys, order, laid)
    kept = [c for c in df.columns if c not in values and c not in extra]
    window = laid.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumns({f"_l_{n}": F.last(c, ignorenulls=True).over(window) for n, c in values.items()})
    if laid.borders is None:
        return local.select(*kept, *[F.col(f"_l_{n}").alias(n) for n in values])
    carry = laid.carry(
        df,
        {f"_b_{n}": F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(AT))) for n, c in values.items()},
        {f"_c_{n}": F.last(f"_b_{n}", ignorenulls=True).over(_so_far()) for n in values},
    )
    found = [F.coalesce(F.col(f"_l_{n}"), F.when(F.col(HEAD), F.col(f"_c_{n}"))).alias(n) for n in values]
    return laid.with_carry(local, carry).select(*kept, *found)


def running_min(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, laid: Laid | None = None
) -> DataFrame:
    """Minimum of the column over all earlier rows of the key (NULL at the first)."""
    df, laid, extra = _input(df, keys, order, laid)
    kept = [c for c in df.columns if c not in extra]
    local = df.withColumn("_s", F.min(value).over(laid.window().rowsBetween(Window.unboundedPreceding, -1)))
    if laid.borders is None:
        return local.select(*kept, F.col("_s").alias(name))
    carry = laid.carry(df, {"_m": F.min(value)}, {"_c": F.min("_m").over(_so_far())})
    return laid.with_carry(local, carry).select(*kept, F.least(F.col("_s"), F.when(F.col(HEAD), F.col("_c"))).alias(name))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """The first ``count`` rows of every key.

    For counts up to the session's limit for partial ranking a task passes on its
    own first ``count`` rows of a key alone; larger counts number the rows by a scan.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if count > limit:
        return row_numbers(df, keys, order, "_nth").filter(F.col("_nth") <= count).drop("_nth")
    sort = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= count).drop("_nth")


def shuffled_rank(
    df: DataFrame, seed: int | str, identity: str, name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """0-based position in a seeded random order, overall or per key.

    Rows are ordered by a digest. Its first three hex digits cut every key into
    4096 even blocks, so neither a global order nor a hot key meets in one task.
    ``keys`` is for a handful of classes or epochs.
    """
    drawn = df.withColumn("_d", digest(seed, *keys, identity)).withColumn(
        BLOCK, F.substring("_d", 1, 3)
    )
    local = drawn.withColumn(
        "_r",
        F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy("_d", identity)),
    )
    before = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most 4096 rows per key.
    carry = (
        drawn.groupBy(*keys, BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return local.join(carry, [*keys, BLOCK]).select(
        *df.columns, (F.col("_before") + F.col("_r") - 1).alias(name)
    )



def digest_cutoff(drawn: DataFrame, n: Column) -> Column:
    """The n-th smallest ``_d`` digest as a scalar; NULL when n is 0.

    A histogram over 4096 digest prefixes finds the block that holds it and only
    that block's rows are ranked. Choosing n random rows then is a filter on the
    scan, with no shuffle of the rows themselves.
    """
    prefixed = drawn.select("_d", F.substring("_d", 1, 3).alias(BLOCK))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    target = (
        prefixed.groupBy(BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(BLOCK, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        .withColumn("_want", n)
        .filter((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_n")))
        .select(BLOCK, (F.col("_want") - F.col("_before")).alias("_k"))
    )
    return (
        prefixed.join(F.broadcast(target), BLOCK)
        .withColumn("_r", F.row_number().over(Window.partitionBy(BLOCK).orderBy("_d")))
        .filter(F.col("_r") == F.col("_k"))
        .agg(F.max("_d"))
        .scalar()
    )

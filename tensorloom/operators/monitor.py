"""Run-monitoring operators over status logs, one row per observation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.cols import first_failure
from tensorloom.plans.scans import MARKS, Laid, last_known, lay_out, neighbours, running_min, running_total

# Phases in order; after the third the first active one returns.
PHASES = ("idle", "propagation 1", "propagation 2", "potentiation")
# Fixed value: transitions kept per node.
PENDING = 4


def phase_distance(before: Column, after: Column) -> Column:
    """Steps from one phase (0..3) to another; phase 0 only occurs at the start."""
    return F.when(before == after, 0).when(before == 0, after).otherwise(F.pmod(after - before, F.lit(3)))


def phase_sequence(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """Monotonic state number per node from its phase messages (node, phase)."""
    laid = lay_out(log, ["node"], order)
    before = laid.settle(neighbours(laid.df, ["node"], order, {"_before": "phase"}, -1, laid))
    step = phase_distance(F.coalesce("_before", F.lit(0)), F.col("phase"))
    return running_total(
        before.withColumn("distance", step), ["node"], order, {"sequence": F.col("distance")}, laid
    ).drop("_before", *MARKS)


def phase_after(before: Column, steps: Column) -> Column:
    """Phase ``steps`` (at least one) further on; the three active phases repeat."""
    return (F.pmod(before - 1 + steps, F.lit(3)) + 1).cast("int")


def _steps(before: Column, first: Column, last: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(last < first, none).otherwise(
        F.transform(F.sequence(first, last), lambda i: phase_after(before, i))
    )


def phase_path(before: Column, after: Column) -> Column:
    """Phases passed on the way to ``after``, which is the last one; empty when equal."""
    walk = _steps(before, F.lit(1), phase_distance(before, after).cast("int"))
    return F.when((after == 0) & (before != 0), F.array(F.lit(0))).otherwise(walk)


def recent_path(before: Column, count: Column) -> Column:
    """The last four phases of a walk of ``count`` steps."""
    return _steps(before, F.greatest(count - PENDING, F.lit(0)) + 1, count)


def pending_phases(observations: DataFrame, order: Sequence[str]) -> DataFrame:
    """Transitions to show per node: skipped phases filled in, the last four kept.

    ``observations``: node, phase, sequence. Rows whose sequence went back are
    ignored. The most recent transition has rank 1.
    """
    laid = lay_out(observations, ["node"], order)
    kept = laid.settle(forward_only(laid.df, order, laid))
    before = neighbours(kept, ["node"], order, {"_phase": "phase", "_sequence": "sequence"}, -1, laid)
    start, seen = F.coalesce("_phase", F.lit(0)), F.coalesce("_sequence", F.lit(0))
    count = F.col("sequence") - seen
    recent = recent_path(start, count)
    fits = (count > 0) & (F.element_at(recent, -1) == F.col("phase"))
    path = F.when(fits, recent).otherwise(phase_path(start, F.col("phase")))
    spread = before.select("node", *order, F.posexplode(path).alias("step", "shown"))
    # Partial ranking: a task passes on its last four transitions of a node alone.
    latest = Window.partitionBy("node").orderBy(*[F.desc(c) for c in (*order, "step")])
    ranked = spread.withColumn("rank", F.row_number().over(latest).cast("bigint"))
    return ranked.filter(F.col("rank") <= PENDING).select("node", *order, "step", "shown", "rank")


def forward_only(
    observations: DataFrame, order: Sequence[str], laid: Laid | None = None
) -> DataFrame:
    """Observations whose sequence is not below an earlier one."""
    low = running_min(observations.withColumn("_neg", -F.col("sequence")), ["node"], order, "_neg", "_low", laid)
    return low.filter(F.col("_low").isNull() | (F.col("_neg") <= F.col("_low"))).drop("_neg", "_low")


def attach_nested(nodes: DataFrame, appearances: DataFrame, states: DataFrame) -> DataFrame:
    """Frozen flag of every node's instance and why its nested graph is missing.

    ``nodes``: node, instance, nested. ``states``: instance, frozen.
    ``appearances``: nested, published, decodable.
    """
    known = appearances.select("nested", F.lit(True).alias("_k"), "published", "decodable")
    joined = nodes.join(states.select("instance", "frozen"), "instance", "left").join(known, "nested", "left")
    asked = F.col("nested").isNotNull()
    reason = first_failure(
        (asked & F.col("_k").isNull(), "fetch failed"),
        (asked & ~F.col("published"), "not published yet"),
        (asked & ~F.col("decodable"), "not decodable"),
    )
    return joined.select(*nodes.columns, "frozen", reason.alias("reason"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, shown: Sequence[str]) -> DataFrame:
    """Rows that appeared, vanished or differ in a shown column."""
    a = before.select(key, F.struct(*shown).alias("_a"))
    b = after.select(key, F.struct(*shown).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def progress_ratio(step: Column, steps: Column) -> Column:
    whole = F.greatest(steps, F.lit(1))
    return F.least(F.greatest(step, F.lit(1)), whole) / whole


def shown_frozen(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """Flag to show per row: while optimising, the one seen when phase 2 began.

    ``log``: node, phase, frozen. Other phases, and optimisation without such a
    moment, show the latest flag.
    """
    laid = lay_out(log, ["node"], order)
    before = laid.settle(neighbours(laid.df, ["node"], order, {"_before": "phase"}, -1, laid))
    moment = F.when((F.col("_before") == 1) & (F.col("phase") == 2), F.col("frozen"))
    held = last_known(
        before.withColumn("_moment", moment), ["node"], order, {"_held": "_moment", "_latest": "frozen"}, laid
    )
    shown = F.when(F.col("phase") == 3, F.coalesce("_held", "_latest")).otherwise(F.col("_latest"))
    return held.withColumn("shown", shown).select(*log.columns, "shown")


def latest_state(log: DataFrame, order: Sequence[str]) -> DataFrame:
    return log.groupBy("node").agg(
        F.max_by("state", F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("observations")
    )

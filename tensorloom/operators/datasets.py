"""Sampling, splitting, ordering and batching of labelled tables.

Random choices order rows by a digest of (seed, id); ids are unique. A choice of
n rows becomes a comparison with the n-th digest, so payload columns are read
once, filtered at the scan and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cols import whole_div
from tensorloom.functions.draws import digest
from tensorloom.plans.scans import digest_cutoff, shuffled_rank

# Batch size, held-out share and the two positive class labels.
BATCH_SIZE = 4
VALIDATION_PERCENT = 15
POSITIVE_LABELS = (111, 112)


def is_positive(label: Column, positives: Sequence[int] = POSITIVE_LABELS) -> Column:
    return label.isin(*positives)


def balanced_sample(df: DataFrame, identity: str, positive: Column, seed: int) -> DataFrame:
    """All positive rows and equally many negatives, drawn without replacement.

    Fails when there is no positive row or there are too few negatives.
    """
    counts = df.agg(
        F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("n")
    )
    p, n = F.col("p"), F.col("n")
    checked = (
        F.when(p == 0, F.raise_error(F.lit("dataset has no positive samples")).cast("bigint"))
        .when(n < p, F.raise_error(F.lit("dataset has too few negative samples")).cast("bigint"))
        .otherwise(p)
    )
    wanted = counts.select(checked).scalar()
    draw = digest(seed, identity)
    cutoff = digest_cutoff(df.filter(~positive).select(draw.alias("_d")), wanted)
    return df.filter(positive | (draw <= cutoff))


def held_out(df: DataFrame, identity: str, seed: int, percent: int = VALIDATION_PERCENT) -> Column:
    """Condition that holds on exactly ``floor(rows * percent / 100)`` rows."""
    draw = digest(seed, identity)
    share = df.agg(F.floor(F.count(F.lit(1)) * F.lit(percent) / F.lit(100))).scalar()
    return F.coalesce(draw <= digest_cutoff(df.select(draw.alias("_d")), share), F.lit(False))


def training_split(df: DataFrame, identity: str, seed: int) -> DataFrame:
    return df.filter(~held_out(df, identity, seed))


def validation_split(df: DataFrame, identity: str, seed: int) -> DataFrame:
    return df.filter(held_out(df, identity, seed))


def shuffle(df: DataFrame, identity: str, seed: int, epoch: int = 0) -> DataFrame:
    """Rows in a seeded order (range-partitioned sort on the digest)."""
    return df.orderBy(digest(seed, F.lit(epoch), identity), identity)


def cursor(df: DataFrame, identity: str, seed: int, epochs: int) -> DataFrame:
    """Endless cursor cut after ``epochs`` passes: every pass has its own order.

    Adds ``epoch`` and the global ``position``.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    passes = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    ranked = shuffled_rank(passes, seed, identity, "_rank", ["epoch"])
    return ranked.withColumn("position", F.col("epoch") * n + F.col("_rank")).drop("_rank")


def batches(df: DataFrame, position: str, size: int = BATCH_SIZE) -> DataFrame:
    """Batch number and slot from the cursor position."""
    return df.withColumn("batch", whole_div(position, size)).withColumn(
        "slot", (F.col(position) % size).cast("int")
    )


def micro_batches(
    df: DataFrame, batch: str, per_step: int, replicas: int
) -> DataFrame:
    """Step, replica and micro-batch number of every batch.

    ``per_step`` batches per replica form a step, so a step has ``per_step *
    replicas`` of them. The last step may be short; its batches are split evenly
    or, when the replicas do not divide them, carry an error.
    """
    replicas = max(replicas, 1)
    whole = max(per_step, 1) * replicas
    steps = df.withColumn("step", whole_div(batch, whole))
    size = F.col("_size")
    sizes = steps.groupBy("step").agg(F.countDistinct(batch).alias("_size"))
    m = F.greatest(whole_div(size, replicas), F.lit(1))
    within = F.col(batch) % whole
    even = size % replicas == 0
    return (
        steps.join(sizes, "step")
        .withColumn("replica", F.when(even, whole_div(within, m)))
        .withColumn("micro", F.when(even, within % m))
        .withColumn("error", F.when(~even, "micro-batches cannot be split across replicas"))
        .drop("_size")
    )


def two_passes(df: DataFrame) -> DataFrame:
    """Every input once for the up pass and once for the down pass."""
    return df.withColumn("side", F.explode(F.array(F.lit("up"), F.lit("down"))))

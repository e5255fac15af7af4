"""Tensor operators over tables: long-form twins, losses and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import tensor_expr as te

# Parts of an inner index in a long-form product.
SPLITS = 16


def tensor_chain(df: DataFrame, values: str, out: str) -> DataFrame:
    """Matmul with the 3x4 weights, halve, ReLU: one projection."""
    return df.withColumn(
        out, te.relu(te.scale(te.matmul(values, te.PIPELINE_WEIGHTS), 0.5))
    )


def explode_values(df: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Long form ``(keys, idx, value)`` of an array tensor."""
    return df.select(*keys, F.posexplode(values).alias("idx", "value"))


def matmul_long(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long-form product of ``(keys, i, k, value)`` and ``(k, j, value)``.

    For weights that outgrow a literal. There are few inner indices, so each is
    split: rows of the left go to one of ``SPLITS`` parts of it, and the weights,
    which do not grow with the rows, to all. Partial sums combine before the shuffle.
    """
    part = F.pmod(F.xxhash64(*keys, "i"), F.lit(SPLITS))
    b = right.select("k", "j", F.col("value").alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("_part"))
    return (
        left.withColumn("_part", part.cast("int")).join(b, ["k", "_part"])
        .groupBy(*keys, "i", "j")
        .agg(F.sum(F.col("value") * F.col("_w")).alias("value"))
    )


def spatial_mean_long(df: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Mean over the plane of every channel of long-form CHW tensors.

    Every plane is full, so the mean of line means is the plane mean.
    """
    plane = height * width
    return df.groupBy(*keys, F.floor(F.col("idx") / plane).cast("int").alias("channel")).agg(
        (F.sum("value") / F.lit(float(plane))).alias("value")
    )


def max_pool_long(df: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Long-form 3x3 stride-2 maximum: each cell goes to the windows that hold it."""
    out_h, out_w = (height + 1) // 2, (width + 1) // 2

    def windows(coordinate: Column, limit: int) -> Column:
        taps = F.transform(
            F.array(F.lit(0), F.lit(1), F.lit(2)),
            lambda d: F.when((coordinate + 1 - d) % 2 == 0, F.floor((coordinate + 1 - d) / 2)),
        )
        return F.filter(taps, lambda o: o.isNotNull() & (o >= 0) & (o < limit))

    y, x = te.reshape_index("idx", (height, width))
    return (
        df.withColumn("_y", F.explode(windows(y, out_h)))
        .withColumn("_x", F.explode(windows(x, out_w)))
        .groupBy(*keys, (F.col("_y") * out_w + F.col("_x")).cast("int").alias("idx"))
        .agg(F.max("value").alias("value"))
    )


def collapse_head(weights: DataFrame, label: str, dim: str, value: str, chosen: Sequence[int]) -> DataFrame:
    """Two-row head: mean of the chosen class rows (row 0) and of the others (row 1)."""
    row = F.when(F.col(label).isin(*chosen), 0).otherwise(1)
    return weights.groupBy(row.alias("row"), F.col(dim).alias("dim")).agg(
        F.avg(value).alias("value")
    )


def mean_loss(df: DataFrame, batch: str, loss: str) -> DataFrame:
    return df.groupBy(batch).agg(
        (F.sum(loss) / F.count(F.lit(1))).alias("mean_loss"), F.count(F.lit(1)).alias("rows")
    )


def accuracy(df: DataFrame, predicted: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    hit = F.when(F.col(predicted) == F.col(target), 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def step_metrics(df: DataFrame, step: str, output: str, batch_size: int) -> DataFrame:
    """Per step: summed loss and hits over ``max(outputs * batch_size, 1)``.

    Rows carry ``loss``, ``predicted`` and ``target``.
    """
    n = F.greatest(F.col("outputs") * F.lit(batch_size), F.lit(1)).cast("double")
    return (
        df.groupBy(step)
        .agg(
            F.sum("loss").alias("_loss"),
            F.sum(F.when(F.col("predicted") == F.col("target"), 1).otherwise(0)).alias("_hits"),
            F.countDistinct(output).alias("outputs"),
        )
        .select(step, "outputs", (F.col("_loss") / n).alias("mean_loss"), (F.col("_hits") / n).alias("accuracy"))
    )


def batch_concat(df: DataFrame, batch: str, slot: str, values: str, size: int) -> DataFrame:
    """One tensor per full batch, slots in order; a batch of another size is an error row.

    The count runs first and only batches of the declared size are collected, so
    a group never holds more than ``size`` tensors.
    """
    counts = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("slots"),
        F.countDistinct(slot).alias("_d"), F.min(slot).alias("_lo"), F.max(slot).alias("_hi"),
    )
    fits = (F.col("slots") == size) & (F.col("_d") == size) & (F.col("_lo") == 0) & (F.col("_hi") == size - 1)
    checked = counts.withColumn("status", F.when(fits, "ok").otherwise("wrong batch size"))
    full = (
        df.join(checked.filter("status = 'ok'").select(batch), batch, "left_semi")
        .groupBy(batch)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(slot), F.col(values)))).alias("_parts"))
        .select(batch, F.flatten(F.transform("_parts", lambda p: p[values])).alias(values))
    )
    return checked.select(batch, "slots", "status").join(full, batch, "left")

"""Structured Streaming forms of the table operators.

Stateful joins need event time: pass streams that already carry a watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import contracts as oc
from tensorloom.session import ensure_checkpoint_dir
from tensorloom.streaming.timers import valid_wait

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Policy = Callable[[DataFrame], DataFrame]


def new_folder(spark: SparkSession) -> str:
    """Fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_windowed(spark: SparkSession, schema, folder: str, in_flight: int, **options: str) -> DataFrame:
    """File stream that takes at most ``in_flight`` files per window; 0 counts as 1.

    The next window starts when every row of this one has reached the sink.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(in_flight, 1))
    return reader.options(**options).parquet(folder)


def serve(
    outputs: DataFrame,
    policy: Policy,
    folder: str,
    order: Sequence[str] = (),
    checkpoint: str | None = None,
    mode: str = "append",
    typed_state: bool = False,
):
    """Start a query that applies the policy to every micro-batch, in ``order``.

    Each batch writes its own folder, so a replayed batch replaces its rows.
    Typed state needs the RocksDB store; a query keeps the store it starts with.
    """
    def sink(batch: DataFrame, number: int) -> None:
        ordered = batch.orderBy(*order) if order else batch
        policy(ordered).write.mode("overwrite").parquet(f"{folder}/window={number}")

    conf = outputs.sparkSession.conf
    before = conf.get(STORE, None)
    if typed_state:
        conf.set(STORE, ROCKSDB)
    try:
        return (
            outputs.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint or f"{folder}-checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(sink)
            .start()
        )
    finally:
        if typed_state:
            conf.unset(STORE) if before is None else conf.set(STORE, before)


def drain(
    outputs: DataFrame,
    policy: Policy = lambda df: df,
    order: Sequence[str] = (),
    mode: str = "append",
    keys: Sequence[str] = (),
    typed_state: bool = False,
) -> DataFrame:
    """Run a stream over all data there is and read its results back.

    In update mode windows repeat what changed: of each of the ``keys`` the row
    of the last window counts. A replayed window has the number it had before,
    so it replaces itself. A stream that runs no window gives no rows.
    """
    spark = outputs.sparkSession
    folder = new_folder(spark)
    query = serve(outputs, policy, folder, order, mode=mode, typed_state=typed_state)
    query.awaitTermination()
    if query.lastProgress is None or not _exists(spark, folder):
        return spark.createDataFrame([], policy(spark.createDataFrame([], outputs.schema)).schema).withColumn("window", F.lit(0))
    rows = spark.read.parquet(folder)
    if not keys:
        return rows
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, "window").alias("_row")).select("_row.*")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def header_audit(ports: DataFrame) -> Policy:
    """Policy that audits bundle headers (artifact, contract, side, tensors) per batch."""
    def audit(batch: DataFrame) -> DataFrame:
        artifacts = batch.select("artifact", "contract", "side")
        tensors = batch.select("artifact", "contract", "side", F.explode("tensors").alias("_t")).select(
            "artifact", "contract", "side", "_t.*"
        )
        return oc.audit_bundles(artifacts, tensors, ports)

    return audit


def wait_for_objects_batch(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch twin of the wait for objects."""
    first = stored.groupBy("id").agg(F.min("stored_at").alias("_first"))
    found = F.unix_millis("_first") <= F.unix_millis("at") + F.col("timeout_ms")
    return requests.join(first, "id", "left").select(
        "request",
        "id",
        F.when(~valid_wait(F.col("timeout_ms")), "timeout out of range")
        .when(found, "found")
        .otherwise("timed out")
        .alias("outcome"),
    )


def fan_in_stream(left: DataFrame, right: DataFrame, on: Sequence[str], wait: str) -> DataFrame:
    """Pair the two ports of a vertex; a partner may come up to ``wait`` later.

    Both sides: the ``on`` columns, at (event time), payload, address.
    """
    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(
            *[F.col(c).alias(f"_{c}{n}") for c in on],
            F.col("at").alias(f"_at{n}"), F.col("payload").alias(f"p{n}"), F.col("address").alias(f"_a{n}"),
        )

    match = F.lit(True)
    for c in on:
        match = match & (F.col(f"_{c}1") == F.col(f"_{c}2"))
    near = F.col("_at2").between(F.col("_at1") - F.expr(f"INTERVAL {wait}"), F.col("_at1") + F.expr(f"INTERVAL {wait}"))
    return side(left, 1).join(side(right, 2), match & near).select(
        *[F.col(f"_{c}1").alias(c) for c in on],
        "p1", "p2",
        F.when(F.col("_a1") != F.col("_a2"), "ports name different receivers").alias("error"),
    )


def live_or_durable(live: Column, durable: Column, durability: Column) -> Column:
    return F.coalesce(live, F.when(durability == "replay required", durable))


def progress(completions: DataFrame, node: str) -> DataFrame:
    return completions.groupBy(node).agg(F.count(F.lit(1)).alias("completed"))


def completion_target(nodes: int, inputs: int, passes: int = 1) -> int:
    return nodes * inputs * passes

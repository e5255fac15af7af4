"""Checkpoints of parameter tables: one folder per step, published by a rename.

A step is written beside its place with a manifest and then renamed into it, so
a reader sees whole steps only, and saving a step again replaces it. A step
without its manifest, or whose rows are not as many as that says, is not there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_manifest.json"


class _Files:
    """Folder operations on the file system of a path."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.jvm = jvm

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))]

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """Put a folder in the place of another; between the two renames the step is absent, never mixed."""
        old = f"{target}-{uuid.uuid4().hex}.old"
        if self.exists(target):
            self.fs.rename(self.path(target), self.path(old))
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"{target} could not be published")
        if self.exists(old):
            self.fs.delete(self.path(old), True)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def checkpoint_rows(params: DataFrame, step: str, every: int) -> DataFrame:
    """Rows of the steps that are saved; ``every`` 0 and step 0 save nothing."""
    if every <= 0:
        return params.limit(0)
    return params.filter((F.col(step) > 0) & (F.col(step) % every == 0))


def write_checkpoints(params: DataFrame, step: str, every: int, folder: str) -> list[int]:
    """Save the steps that are due, all in one job; returns their numbers.

    Rows are dealt by step, and steps are as few as a run saves: the driver
    publishes a folder for each.
    """
    spark, files = params.sparkSession, _Files(params.sparkSession, folder)
    staging = f"{folder}/_writing-{uuid.uuid4().hex}"
    due = checkpoint_rows(params, step, every).withColumn("_step", F.col(step).cast("bigint"))
    due.write.partitionBy("_step").parquet(staging)
    written = spark.read.schema(due.schema).parquet(staging)
    counts = {r["_step"]: r["count"] for r in written.groupBy("_step").count().collect()}
    for number, rows in sorted(counts.items()):
        part = f"{staging}/_step={number}"
        files.write(f"{part}/{MANIFEST}", json.dumps({"step": number, "rows": rows, "schema": params.schema.json()}))
        files.replace(part, f"{folder}/step={number}")
    files.delete(staging)
    return sorted(counts)


def steps(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the steps that are there with their manifest."""
    files = _Files(spark, folder)
    found = [n for n in files.names(folder) if n.startswith("step=") and n[5:].isdigit()]
    return sorted(int(n[5:]) for n in found if files.exists(f"{folder}/{n}/{MANIFEST}"))


def read_checkpoint(spark: SparkSession, folder: str, step: int | None = None) -> DataFrame:
    """The rows of a step as they were saved, by default of the latest complete one."""
    files = _Files(spark, folder)
    for number in reversed(steps(spark, folder)) if step is None else [step]:
        place = f"{folder}/step={number}"
        if not files.exists(f"{place}/{MANIFEST}"):
            continue
        manifest = json.loads(files.read(f"{place}/{MANIFEST}"))
        rows = spark.read.schema(T.StructType.fromJson(json.loads(manifest["schema"]))).option("recursiveFileLookup", "true").parquet(place)
        if rows.count() == manifest["rows"]:
            return rows
    raise FileNotFoundError(f"no complete step in {folder}" if step is None else f"step {step} is not complete in {folder}")

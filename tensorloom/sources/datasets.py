"""Reading labelled payload tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def labelled_columns(schema: T.StructType) -> tuple[Column, Column]:
    """The first BIGINT column (label) and the nested binary ``bytes`` (payload)."""
    label = next((f.name for f in schema if isinstance(f.dataType, T.LongType)), None)
    payload = [
        f.name
        for f in schema
        if isinstance(f.dataType, T.StructType)
        and any(n.name == "bytes" and isinstance(n.dataType, T.BinaryType) for n in f.dataType)
    ]
    if label is None:
        raise ValueError("dataset has no label")
    if not payload:
        raise ValueError("dataset has no payload bytes")
    return F.col(label), F.col(f"{payload[-1]}.bytes")


def labelled(df: DataFrame) -> DataFrame:
    """Columns ``label`` and ``payload`` beside the others; a missing payload fails."""
    label, payload = labelled_columns(df.schema)
    checked = F.when(
        payload.isNull(), F.raise_error(F.lit("dataset row has no payload bytes"))
    ).otherwise(payload)
    return df.select("*", label.alias("label"), checked.alias("payload"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return labelled(spark.read.parquet(path))

"""Registry of the queries: Spark builder and equivalent SQL side by side."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    build: Builder
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def keep(build: Builder) -> Builder:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(build, sql)
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small constant table as an expression, without a Python-backed scan."""
    names = T.StructType.fromDDL(schema).names
    text = json.dumps([dict(zip(names, row)) for row in rows])
    parsed = F.from_json(F.lit(text), f"array<struct<{', '.join(_fields(schema))}>>")
    return spark.range(1).select(F.inline(parsed))


def _fields(schema: str) -> list[str]:
    return [f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema)]

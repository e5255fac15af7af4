"""Where user code plugs in: operations, monoids, policies, fusions, steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cols import first_failure
from tensorloom.operators import graphs as og


@dataclass(frozen=True)
class Port:
    """One-port contract of a table with one tensor per row."""

    dtype: str
    size: int | None = None

    def fault(self, dtype: Column, values: Column) -> Column:
        rules = [(values.isNull(), "missing tensor"), (dtype != self.dtype, "dtype mismatch")]
        if self.size is not None:
            rules.append((F.size(values) != self.size, "dimension mismatch"))
        return first_failure(*rules)


@dataclass(frozen=True)
class Operation:
    """A forward function on pandas batches between two contracts, and state verbs.

    ``forward`` maps an iterator of frames (keys, v) to frames of the same columns.
    ``verbs`` maps 'backward', 'step', 'perturb', ... to functions on DataFrames.
    """

    accepts: Port
    returns: Port
    forward: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
    verbs: Mapping[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def run(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Rows (keys, v, error): checked, computed, and checked again."""
        kinds = dict(df.dtypes)
        schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "v array<double>"])
        judged = df.withColumn("error", self.accepts.fault(F.col("dtype"), F.col("v")))
        done = judged.filter("error IS NULL").select(*keys, "v").mapInPandas(self.forward, schema)
        out = done.withColumn("error", self.returns.fault(F.lit(self.returns.dtype), F.col("v")))
        refused = judged.filter("error IS NOT NULL").select(
            *keys, F.lit(None).cast("array<double>").alias("v"), F.concat(F.lit("input: "), "error").alias("error")
        )
        return out.withColumn("error", F.concat(F.lit("output: "), "error")).unionByName(refused)

    def call(self, verb: str, *args: Any, **kwargs: Any) -> DataFrame:
        if verb not in self.verbs:
            raise NotImplementedError(f"{verb} capability is not implemented")
        return self.verbs[verb](*args, **kwargs)


@dataclass(frozen=True)
class Monoid:
    """Associative merge with an identity, over one column's Python values."""

    identity: Any
    merge: Callable[[Any, Any], Any]

    def fold(self, df: DataFrame, key: str, order: str, value: str) -> DataFrame:
        """Merge values per key in ``order``.

        Rows are range-partitioned by (key, order): every task folds its runs to one
        partial per key, and a key's partials, at most one per partition, merge in
        order. The merge need not commute.
        """
        kinds = dict(df.dtypes)
        identity, merge = self.identity, self.merge
        partial_schema = f"`{key}` {kinds[key]}, _at {kinds[order]}, `{value}` {kinds[value]}"

        def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list | None = None
            for frame in frames:
                done = []
                for k, at, v in frame.itertuples(index=False):
                    if held is None or held[0] != k:
                        if held is not None:
                            done.append(tuple(held))
                        held = [k, at, identity]
                    held[2] = merge(held[2], v)
                yield pd.DataFrame(done, columns=[key, "_at", value])
            if held is not None:
                yield pd.DataFrame([tuple(held)], columns=[key, "_at", value])

        def finish(frame: pd.DataFrame) -> pd.DataFrame:
            total = identity
            for v in frame.sort_values("_at")[value]:
                total = merge(total, v)
            return pd.DataFrame({key: [frame[key].iloc[0]], value: [total]})

        return (
            df.select(key, order, value)
            .repartitionByRange(key, order)
            .sortWithinPartitions(key, order)
            .mapInPandas(runs, partial_schema)
            .groupBy(key)
            .applyInPandas(finish, f"`{key}` {kinds[key]}, `{value}` {kinds[value]}")
        )


def apply_policy(
    outputs: DataFrame, policy: Callable[[DataFrame], DataFrame], gives: Sequence[str]
) -> DataFrame:
    """Turn outputs into losses or metrics; the promised columns must be there."""
    result = policy(outputs)
    missing = [c for c in gives if c not in result.columns]
    if missing:
        raise ValueError(f"policy gives no {', '.join(missing)}")
    return result


def fuse(
    deliveries: DataFrame, payload: str, address: str, transform: Callable[[Column, Column], Column]
) -> DataFrame:
    """Apply a two-input transform to the paired ports of every vertex and step."""
    paired = og.fan_in(deliveries, payload, address)
    value = F.when(F.col("error").isNull(), transform(F.col("p1"), F.col("p2")))
    return paired.withColumn("fused", value)


def source_steps(source: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A source followed by augmentation steps."""
    for step in steps:
        source = step(source)
    return source

"""Type-label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.functions.cols import col, let


def short_label(label: Column | str) -> Column:
    """Drop the module path of every name; generics stay."""
    return F.trim(F.regexp_replace(col(label), "[A-Za-z0-9_:']*::", ""))


def boundary_label(label: Column | str) -> Column:
    """Text after the first top-level comma of ``Warp<A, B>``; NULL for other labels."""
    label = col(label)
    whole = F.regexp_extract(label, "(?s)^Warp<(.*)>$", 1)
    matches = F.rlike(label, F.lit("(?s)^Warp<(.*)>$"))

    def tail(inner: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("found"))

        def walk(acc: Column, char: Column) -> Column:
            depth = acc["depth"] + F.when(char == "<", 1).when(char == ">", -1).otherwise(0)
            at = acc["at"] + 1
            hit = (acc["found"] == 0) & (char == ",") & (acc["depth"] == 0)
            return F.struct(
                depth.alias("depth"), at.alias("at"), F.when(hit, at).otherwise(acc["found"]).alias("found")
            )

        found = F.aggregate(F.split(inner, ""), start, walk, lambda acc: acc["found"])
        return let(
            found,
            lambda n: F.when(n > 0, short_label(F.substring(inner, n + 1, F.length(inner)))),
        )

    return F.when(matches, let(whole, tail))

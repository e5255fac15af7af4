"""Small column helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def first_failure(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds, NULL when none does."""
    chain = None
    for condition, label in rules:
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    return chain


def whole_div(a: Column | str, b: Column | int) -> Column:
    """Integer quotient, exact for every size; decimals give a BIGINT."""
    return F.call_function("div", col(a), F.lit(b) if isinstance(b, int) else b)


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(ts))


def let(value: Column | str, body) -> Column:
    """``body(value)`` with the value computed once per row.

    The optimizer inlines column expressions into lambdas, where they would run
    once per array element; a lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(col(value)), body), 1)

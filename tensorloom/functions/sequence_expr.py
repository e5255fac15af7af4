"""Token-sequence expressions.

A token is ``struct<predicted:bigint, dark:array<struct<token_id, log_prob>>>``;
functions that only look at the predicted id also take plain id arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.functions.cols import col, let

# The tokenizer's padding, end-of-message and start-of-message ids.
PAD = 248044
FRAME_START = 248045
IM_END = 248046

DARK = "array<struct<token_id:bigint,log_prob:double>>"


def plain(token: Column) -> Column:
    return token


def predicted(token: Column) -> Column:
    return token["predicted"]


def one_hot(token_id: Column | int) -> Column:
    """Token whose whole distribution sits on one id."""
    token_id = F.lit(token_id) if isinstance(token_id, int) else token_id
    token_id = token_id.cast("bigint")
    entry = F.struct(token_id.alias("token_id"), F.lit(0.0).alias("log_prob"))
    return F.struct(token_id.alias("predicted"), F.array(entry).alias("dark"))


def trim_padding(tokens: Column | str, id_of: Callable[[Column], Column] = plain) -> Column:
    """Drop the trailing run of PAD and IM_END; earlier ones stay."""

    def trimmed(seq: Column) -> Column:
        last = F.array_max(
            F.transform(seq, lambda t, i: F.when(id_of(t).isin(PAD, IM_END), 0).otherwise(i + 1))
        )
        return F.slice(seq, F.lit(1), F.coalesce(last, F.lit(0)))

    return let(tokens, trimmed)


def pad_start_to(tokens: Column | str, length: Column, pad: Column | None = None) -> Column:
    """Left-pad to ``length``; longer sequences stay whole."""
    pad = F.lit(PAD).cast("bigint") if pad is None else pad
    missing = F.greatest(length - F.size(col(tokens)), F.lit(0)).cast("int")
    return F.concat(F.array_repeat(pad, missing), col(tokens))


def words(text: Column | str) -> Column:
    return F.filter(F.split(col(text), "[ \\n\\t\\r]+"), lambda w: w != "")


def top_k(dark: Column | str, k: int) -> Column:
    """The k most likely entries, best first; the lower id wins a tie."""
    ranked = F.array_sort(
        F.transform(
            col(dark),
            lambda e: F.struct((-e["log_prob"]).alias("m"), e["token_id"].alias("token_id")),
        )
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda e: F.struct(e["token_id"].alias("token_id"), (-e["m"]).alias("log_prob")),
    )

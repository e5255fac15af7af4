"""Draws keyed by (seed, key): independent of partitioning and row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.functions.cols import col

HEX_RANGE = float(16**8)


def digest(seed: int | str, *keys: Column | str) -> Column:
    """Hex digest of the seed and the key columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def sign(seed: int | str, *keys: Column | str) -> Column:
    """+1.0 or -1.0 with equal odds."""
    return F.when(F.substring(digest(seed, *keys), 1, 1) < "8", 1.0).otherwise(-1.0)


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """Double in [0, 1) with 32 random bits."""
    head = F.substring(digest(seed, *keys), 1, 8)
    return F.conv(head, 16, 10).cast("bigint").cast("double") / F.lit(HEX_RANGE)


def coin(seed: int | str, *keys: Column | str) -> Column:
    """True with odds one half."""
    return F.substring(digest(seed, *keys), 1, 1) < "8"

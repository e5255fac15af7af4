"""Mailbox chains: every message names the inbox of the next one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.plans.scans import neighbours
from tensorloom.session import durable


def name_next_inbox(
    messages: DataFrame, keys: Sequence[str], order: Sequence[str], inbox: Column
) -> DataFrame:
    """Add inbox and next_inbox from a sequence column; the last message names none."""
    return neighbours(messages.withColumn("inbox", inbox), keys, order, {"next_inbox": "inbox"}, 1)


def follow_inboxes(messages: DataFrame) -> DataFrame:
    """Place of every message from the end of its chain, by inbox links alone.

    Links double their reach every round, so a chain of n messages takes log2(n)
    joins; each round is cut with a reliable checkpoint. ``to_end`` is 0 for the
    last message; a ring has no end and keeps NULL.
    """
    links = durable(
        messages.select("inbox", F.col("next_inbox").alias("_to"), F.when(F.col("next_inbox").isNull(), 0).otherwise(1).cast("bigint").alias("_d"))
    )
    total = links.count()
    for _ in range(max(total, 1).bit_length()):
        if links.filter("_to IS NOT NULL").isEmpty():
            break
        ahead = links.select(F.col("inbox").alias("_to"), F.col("_to").alias("_to2"), F.col("_d").alias("_d2"))
        # Chains that have reached their end take no part in the join.
        further = links.filter("_to IS NOT NULL").join(ahead, "_to", "left").select(
            "inbox", F.col("_to2").alias("_to"), (F.col("_d") + F.coalesce("_d2", F.lit(0))).alias("_d")
        )
        links = durable(further.unionByName(links.filter("_to IS NULL")))
    place = links.select("inbox", F.when(F.col("_to").isNull(), F.col("_d")).alias("to_end"))
    return messages.join(place, "inbox")

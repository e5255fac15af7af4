"""Packing of documents into sequences of fixed capacity by the sum-of-squares rule.

The rule keeps the number of open sequences per residual gap even: an item goes
where the sum of the squared counts grows least, so no gap that later items
could fill dies out. Items are dealt to groups at random and each group is
packed by one task; its sequences that stay open are broken up again and their
items meet those of other groups in the next round, until one group is left.
A round has as many groups as the items still waiting need, so no group outgrows
its size. With mixed lengths open sequences hold a small share of a group; where
lengths seldom fill a sequence most items stay open, meeting others gains
nothing, and all groups of the round are settled as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.texts import BLOCK_BYTES, PieceEncoder, slices, text_rows
from tensorloom.session import durable

GROUP_ITEMS = 1 << 17
CACHED_PIECES = 300_000  # a worker keeps up to two tables of so many, some 150 bytes for each piece
FAN_IN = 16
GROUP_BITS, SEQUENCE_BITS = 32, 24


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text",
    as_text: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids (4 bytes each).

    A document is its ids and one ``end_id``; NULL and empty texts have only the
    latter. Documents up to ``capacity`` stay whole. Of longer ones all pieces
    are full but the first, which takes the remainder. Repeated rows stay. The
    strings of special tokens give their special ids, as in a plain library
    call; with ``as_text`` they are ordinary text.
    """
    cut = _cut(tokenizer, end_id, capacity, as_text)
    return text_rows(docs, id_col, text_col).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def _cut(tokenizer: str, end_id: int, capacity: int, as_text: bool):
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer, as_text=as_text, limit=CACHED_PIECES)
        for batch in slices(batches, "data", BLOCK_BYTES):
            rows = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.encode_many(batch.column("data").to_pylist())):
                found += end
                n = len(found) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc, k, a, b - a, found[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each item in the given order, and the gap of each sequence.

    Moving a sequence from gap g to g - n changes the sum of squares by
    2 * (count[g - n] - count[g]) + 2; full sequences (gap 0) are not counted,
    and a new sequence counts as a gap of ``capacity`` that costs nothing to
    leave. Of equal changes the smallest gap wins.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        leaving = count[n : capacity + 1]
        change = 2 * (count[: capacity + 1 - n] - leaving) + 2
        # Gap n is filled up: the sum only loses.
        change[0] = 1 - 2 * leaving[0]
        change[leaving == 0] = np.iinfo(np.int64).max
        if n < capacity:
            change[-1] = 2 * count[capacity - n] + 1
        else:
            change[-1] = 0
        gap = n + int(change.argmin())
        if gap == capacity:
            where = len(gaps)
            gaps.append(capacity)
        else:
            where = open_at[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = where, capacity - gap
        gaps[where] = rest = gap - n
        if rest:
            open_at[rest].append(where)
            count[rest] += 1
    return sequence, offset, np.array(gaps, np.int64)


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        """Longest items first; ties in the order of their row digests, so runs repeat."""
        order = np.lexsort((table["_tie"].to_numpy(), -table["_len"].to_numpy()))
        table = table.take(pa.array(order))
        sequence, offset, gaps = sum_of_squares(table["_len"].to_numpy(), capacity)
        if len(gaps) > 1 << SEQUENCE_BITS:
            raise ValueError("a group has more sequences than its numbers tell apart")
        table = table.append_column("_seq", pa.array(sequence)).append_column("_at", pa.array(offset))
        return table.append_column("_done", pa.array(gaps[sequence] == 0))

    return run


def groups_for(waiting: int, group_items: int) -> int:
    return max(1, -(-waiting // group_items))


def pack(
    items: DataFrame, length: str, capacity: int, *, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to items of lengths 1 to ``capacity``.

    Offsets in a sequence have no gaps from 0 on. Items longer than
    ``capacity``, shorter than 1 or NULL raise an error. Items that fill a
    sequence alone are settled at once. Repeated rows are items of their own;
    columns named like the results are replaced, others of any name stay. A
    sequence's number is made of its round, its group and its place there, so no
    two share one. An empty table stays empty.
    """
    if not 1 <= group_items <= 1 << SEQUENCE_BITS - 2:
        raise ValueError(f"group_items is between 1 and {1 << SEQUENCE_BITS - 2}")
    items = items.drop("sequence_id", "offset")
    kept = items.columns
    size = F.col(f"`{length}`").cast("bigint")
    sound = F.when(size.between(1, capacity), size).otherwise(
        F.raise_error(F.format_string("length %s is not between 1 and %d", size.cast("string"), F.lit(capacity))).cast("bigint")
    )
    # Written once: what is dealt out must not change when a task is repeated.
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in kept])
    numbered = durable(items.select(own.alias("_own"), sound.alias("_len"), F.monotonically_increasing_id().alias("_row")))
    total = numbered.filter(F.col("_len") < capacity).count()
    groups = groups_for(total, group_items)
    seed = F.xxhash64("_row")
    waiting = numbered.filter(F.col("_len") < capacity).select("_row", "_len", seed.alias("_tie"))
    settled = [numbered.filter(F.col("_len") == capacity).select("_row", F.lit(-1).alias("_round"), F.col("_row").alias("_group"), F.lit(0).cast("bigint").alias("_seq"), F.lit(0).cast("bigint").alias("_at"))]
    schema = "_row bigint, _len bigint, _tie bigint, _group bigint, _seq bigint, _at bigint, _done boolean"
    step = 0
    while True:
        dealt = waiting.withColumn("_group", F.pmod(F.xxhash64("_tie", F.lit(step)), F.lit(groups)))
        packed = durable(dealt.groupBy("_group").applyInArrow(_pack_group(capacity), schema))
        left = 0 if groups == 1 else packed.filter(~F.col("_done")).count()
        last = left == 0 or (left > group_items and 2 * left > total)
        settled.append((packed if last else packed.filter("_done")).select("_row", F.lit(step).alias("_round"), "_group", "_seq", "_at"))
        if last:
            break
        waiting = packed.filter(~F.col("_done")).select("_row", "_len", "_tie")
        # What is left of at most ``fan_in`` groups meets in one.
        total, groups, step = left, max(groups_for(left, group_items), groups // fan_in), step + 1
    placed = settled[0]
    for part in settled[1:]:
        placed = placed.unionByName(part)
    inner = F.shiftleft(F.col("_round").cast("bigint"), GROUP_BITS + SEQUENCE_BITS) + F.shiftleft("_group", SEQUENCE_BITS) + F.col("_seq")
    # Sequences of one item have the negative numbers, by row.
    name = F.when(F.col("_round") < 0, -F.col("_row") - 1).otherwise(inner)
    columns = [F.col("_own").getField(c).alias(c) for c in kept]
    return numbered.join(placed, "_row").select(*columns, name.alias("sequence_id"), F.col("_at").alias("offset"))

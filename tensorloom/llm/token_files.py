"""Token files: one concatenated id array in blocks, document bounds in Elias-Fano form.

A file row is a block: the ids of consecutive documents as little-endian
integers (two bytes where the vocabulary allows), the document ids, and the
places where documents start. Those places never decrease, so they are kept as
Elias-Fano code: the low bits packed, the high bits in unary, about two bits a
document plus the low bits, with a select sample for every 64th document. An
offset is answered by `select` without a table of 64-bit numbers.

Blocks are ordered by (shard, block). Shards are the range partitions of the
document order, so the array has one order though many tasks write it, and a
task that is repeated writes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.llm.texts import PieceEncoder, slices, text_rows

BLOCK_IDS = 1 << 18
SAMPLE = 64

BLOCK_SCHEMA = """shard int, block int, first_id bigint, n_docs int, n_ids bigint, width int,
doc_ids array<bigint>, low_bits int, low binary, high binary, samples binary, ids binary"""


class Bounds:
    """Elias-Fano code of a sequence that never decreases."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = low, high
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def build(cls, values: np.ndarray) -> Bounds:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        lows = (values[:, None] >> np.arange(low_bits)) & 1
        places = (values >> low_bits) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(
            n, low_bits,
            np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(unary, bitorder="little").tobytes(),
            places[::SAMPLE].astype("<u4").tobytes(),
        )

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = self.low[first // 8 : (first + self.low_bits + 7) // 8]
        return int.from_bytes(part, "little") >> first % 8 & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, ones of the unary part are counted."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place // 8
        word = self.high[byte] >> place % 8 << place % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return place - i << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        unary = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        high = np.flatnonzero(unary)[: self.n] - np.arange(self.n)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")
        lows = bits[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return high << self.low_bits | lows @ (1 << np.arange(self.low_bits, dtype=np.int64))


def _block(shard: int, block: int, first: int, width: int, docs: list, parts: list[bytes]) -> dict:
    ends = np.cumsum([len(p) // width for p in parts])
    starts = Bounds.build(np.concatenate([[0], ends]))
    return {
        "shard": shard, "block": block, "first_id": first, "n_docs": len(docs), "n_ids": int(ends[-1]),
        "width": width, "doc_ids": docs, "low_bits": starts.low_bits, "low": starts.low, "high": starts.high,
        "samples": starts.samples.tobytes(), "ids": b"".join(parts),
    }


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id",
    text_col: str = "text", width: int = 2, block_ids: int = BLOCK_IDS, shards: int | None = None, as_text: bool = False,
) -> None:
    """Encode all texts and write the token files.

    Documents come in ascending order of id (NULL ids first), equal ids in
    order of their texts; repeated rows stay. A NULL or empty text gives only
    the end id. ``width`` is the bytes of an id, 2 where the vocabulary has at
    most 65536 entries. A block is closed when it holds ``block_ids`` ids; a
    longer document has a block of its own. The strings of special tokens give
    their special ids, as in a plain library call; with ``as_text`` they are
    ordinary text. Other columns are not read. An empty table gives files
    without rows.
    """
    end = int(end_id).to_bytes(width, "little")
    schema = pa.schema(_arrow_fields())

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = PieceEncoder.of(tokenizer, width, as_text), TaskContext.get().partitionId()
        block = first = held = 0
        ids: list = []
        parts: list[bytes] = []
        for batch in slices(batches, "data"):
            names = batch.column("doc_id").to_pylist()
            for name, found in zip(names, encoder.encode_many(batch.column("data").to_pylist())):
                if parts and held + len(found) // width >= block_ids:
                    row = _block(shard, block, first, width, ids, parts)
                    yield pa.RecordBatch.from_pylist([row], schema)
                    block, first, held, ids, parts = block + 1, first + row["n_ids"], 0, [], []
                ids.append(name)
                parts.append(found + end)
                held += len(parts[-1]) // width
        if parts:
            yield pa.RecordBatch.from_pylist([_block(shard, block, first, width, ids, parts)], schema)

    rows = text_rows(docs, id_col, text_col)
    ranged = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    ordered = ranged.sortWithinPartitions("doc_id", "data")
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(folder)


def _arrow_fields() -> list[tuple]:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return [(n, kinds[k]) for n, k in (x.split() for x in BLOCK_SCHEMA.replace("\n", " ").split(","))]


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the files with ``base``, the number of ids in all earlier blocks.

    The only thing summed in one task is a row per shard, that is per writing task.
    """
    read = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        read.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
        .select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    return read.join(bases, "shard").withColumn("base", F.col("_base") + F.col("first_id")).drop("_base")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before), n_tokens, ids (4 bytes each)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds = Bounds(row["n_docs"] + 1, row["low_bits"], row["low"], row["high"], row["samples"]).values()
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                starts, ends = bounds[:-1], bounds[1:]
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), row["n_docs"], [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids)]
                ) if len(ids) >= 1 << 29 else pa.BinaryArray.from_buffers(
                    pa.binary(), row["n_docs"], [None, pa.py_buffer((bounds * 4).astype("<i4")), pa.py_buffer(ids)]
                )
                columns = [pa.array(row["doc_ids"], pa.int64()), starts + row["base"], ends - starts, data.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], schema=schema)

    stored = blocks(spark, folder).select("base", "n_docs", "width", "doc_ids", "low_bits", "low", "high", "samples", "ids")
    return stored.mapInArrow(cut, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def lookup(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """start and n_tokens of the listed documents, by `select` in the blocks that hold them."""
    wanted = doc_ids.select("doc_id").distinct()
    places = blocks(spark, folder).select(
        "base", "n_docs", "low_bits", "low", "high", "samples", F.posexplode("doc_ids").alias("place", "doc_id")
    ).join(wanted, "doc_id")

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                bounds = Bounds(r["n_docs"] + 1, r["low_bits"], r["low"], r["high"], r["samples"])
                at, end = bounds.select(r["place"]), bounds.select(r["place"] + 1)
                out.append((r["doc_id"], r["base"] + at, end - at))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens"])

    return places.mapInArrow(answer, "doc_id bigint, start bigint, n_tokens bigint")

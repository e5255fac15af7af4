"""Fingerprints as invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs, lines and the sentences in them. Each paragraph
adds one to three cells: to a count, to the xor of the digests and to the xor of
their check values. Two tables of one size subtract cell by cell, and what both
texts have cancels. From what is left, cells with one digest are peeled off until
nothing remains: the digests that differ. If cells remain that cannot be peeled,
both tables are built again four times as large.

All texts of a slice are worked on at once, each in its own stretch of the cells.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.llm.shingles import byte_sums, mixed, stretch_hashes
from tensorloom.llm.texts import WINDOW_BYTES, as_bytes, slices, windows

CELLS = 12
GROWTH = 4
PARTS = 3
_U = np.uint64
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_LOWEST = -(1 << 63)


def paragraph_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of all texts and the place of each text's first.

    A paragraph ends after a line end, or after a full stop, exclamation or
    question mark that a space follows. Repeats of a paragraph in its text have
    digests of their own, so that a table is a multiset. Texts of more than four
    windows are also cut where windows end.
    """
    data = [part for text in texts for part in (windows(text) if len(text) > 4 * WINDOW_BYTES else (text,))]
    home = np.repeat(np.arange(len(texts)), [1 if len(t) <= 4 * WINDOW_BYTES else sum(1 for _ in windows(t)) for t in texts])
    digests, owners = [], []
    held: list[bytes] = []
    names: list[int] = []
    for part, name in [*zip(data, home.tolist()), (None, -1)]:
        if part is None or (held and sum(map(len, held)) + len(part) > 4 * WINDOW_BYTES - 64):
            found, owner = _cut(held)
            digests.append(found)
            owners.append(np.array(names, np.int64)[owner])
            held, names = [], []
        if part is not None:
            held.append(part)
            names.append(name)
    digest, owner = np.concatenate(digests), np.concatenate(owners)
    order = np.lexsort((digest, owner))
    same = np.concatenate([[False], (digest[order][1:] == digest[order][:-1]) & (owner[order][1:] == owner[order][:-1])]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order))
    repeat = place - np.maximum.accumulate(np.where(same, 0, place)) if len(order) else place
    digest, owner = mixed(digest[order] + repeat.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), owner[order]
    return digest, np.searchsorted(owner, np.arange(len(texts) + 1))


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.cumsum([0, *map(len, texts)])
    values = np.frombuffer(b"".join(texts), np.uint8)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.zeros(len(values) + 1, bool)
    ends[1:] = values == 10
    ends[1:-1] |= _ENDS[values[:-1]] & (values[1:] == 32)
    ends[offsets] = True
    edges = np.flatnonzero(ends)
    starts, stops = edges[:-1], edges[1:]
    return stretch_hashes(byte_sums(values), starts, stops), np.searchsorted(offsets, starts, "right") - 1


class Tables:
    """One lookup table per text, all of ``cells`` cells, or of as many as listed per text."""

    def __init__(self, digests: np.ndarray, bounds: np.ndarray, cells: np.ndarray):
        self.base = np.concatenate([[0], np.cumsum(cells)])
        self.part = cells // PARTS
        owner = np.repeat(np.arange(len(cells)), np.diff(bounds))
        self.count = np.zeros(self.base[-1], np.int64)
        self.keys = np.zeros(self.base[-1], np.uint64)
        self.checks = np.zeros(self.base[-1], np.uint64)
        self.add(owner, digests, 1)

    @staticmethod
    def check(digests: np.ndarray) -> np.ndarray:
        return mixed(digests ^ _U(0xA0761D6478BD642F)) & _U(0xFFFFFFFF)

    def add(self, owner: np.ndarray, digests: np.ndarray, sign) -> None:
        checks = self.check(digests)
        for j in range(PARTS):
            salted = mixed(digests + _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) + self.part[owner].astype(np.uint64))
            cell = self.base[owner] + j * self.part[owner] + (salted % self.part[owner].astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.keys, cell, digests)
            np.bitwise_xor.at(self.checks, cell, checks)

    def subtract(self, other: Tables) -> None:
        self.count -= other.count
        self.keys ^= other.keys
        self.checks ^= other.checks

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign of all that could be peeled, and whether each table is empty then."""
        found: list[tuple] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            pure = look[self.checks[look] == self.check(self.keys[look])]
            if not len(pure):
                break
            owner = np.searchsorted(self.base, pure, "right") - 1
            digests, signs = self.keys[pure], self.count[pure]
            order = np.lexsort((digests, owner))
            new = np.concatenate([[True], (digests[order][1:] != digests[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
            first = order[new]
            owner, digests, signs = owner[first], digests[first], signs[first]
            found.append((owner, digests, signs))
            self.add(owner, digests, -signs)
            look = np.flatnonzero(np.abs(self.count) == 1)
        full = np.add.reduceat((self.count != 0) | (self.keys != 0), self.base[:-1]) if len(self.base) > 1 else np.zeros(0)
        owner, digests, signs = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return owner, digests, signs, full == 0

    def encoded(self) -> list[str]:
        """Each table as text: counts, digests and check values of its cells."""
        rows = np.zeros(len(self.count), [("n", "<i4"), ("key", "<u8"), ("check", "<u4")])
        rows["n"], rows["key"], rows["check"] = self.count, self.keys, self.checks
        data = rows.tobytes()
        return [base64.b64encode(data[16 * a : 16 * b]).decode() for a, b in zip(self.base[:-1], self.base[1:])]


def pick(digests: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of some texts, one after the other."""
    sizes = bounds[texts + 1] - bounds[texts]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return digests[np.arange(ends[-1]) - np.repeat(ends[:-1] - bounds[texts], sizes)], ends


def differences(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, digest and sign (1: left only, -1: right only) of all paragraphs that differ."""
    todo, cells = np.arange(len(left[1]) - 1), CELLS
    out: list[tuple] = []
    while len(todo):
        width = np.full(len(todo), cells)
        table = Tables(*pick(*left, todo), width)
        table.subtract(Tables(*pick(*right, todo), width))
        owner, digests, signs, done = table.peel()
        keep = done[owner]
        out.append((todo[owner[keep]], digests[keep], signs[keep]))
        todo, cells = todo[~done], cells * GROWTH
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def likeness(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shared paragraphs over all paragraphs of each pair; 1 where neither text has any."""
    pair, _, signs = differences(left, right)
    n = len(left[1]) - 1
    only_left = np.bincount(pair[signs > 0], minlength=n)
    only_right = np.bincount(pair[signs < 0], minlength=n)
    both = np.diff(left[1]) - only_left
    total = both + only_left + only_right
    return np.where(total > 0, both / np.maximum(total, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows dealt so that each part, in descending order of id, ends with the first row of the next.

    Parts are ranges of ids; their limits are quantiles, and the first id of
    each is a list as long as the number of parts. The first row of a part is
    also sent to the part before it, marked ``ahead``; the first row of all
    follows the last. Columns: part, ahead, key, doc_id, data.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(F.col(f"`{text_col}`")).alias("data"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST)))
    at = [k / parts for k in range(1, parts)] or [0.5]
    limits = np.unique(np.array(rows.agg(F.percentile_approx("key", at, 20 * max(parts, 500))).first()[0] or [], np.int64))
    of_part = F.arrow_udf(lambda keys: pa.array(np.searchsorted(limits, keys.to_numpy(), "right").astype(np.int64)), T.LongType())
    heads = sorted(rows.select("key", of_part("key").alias("part")).groupBy("part").agg(F.max("key")).collect())
    # By head: the part that it follows, the next higher one or, for the highest, the lowest.
    names = [h[0] for h in heads]
    before = {int(head): int(names[(i + 1) % len(names)]) for i, (_, head) in enumerate(heads)}

    def places(keys: pa.Array) -> pa.Array:
        own = np.searchsorted(limits, keys.to_numpy(), "right").tolist()
        return pa.array([[2 * p, 2 * before[k] + 1] if k in before else [2 * p] for p, k in zip(own, keys.to_pylist())], pa.list_(pa.int64()))

    place = F.explode(F.arrow_udf(places, T.ArrayType(T.LongType()))("key"))
    dealt = rows.withColumn("place", place).select((F.col("place") / 2).cast("bigint").alias("part"), (F.col("place") % 2 == 1).alias("ahead"), "key", "doc_id", "data")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.desc("key"), "data")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited (bytes), both fingerprints, near_edited, near_next.

    The next row is that of the next smaller id; NULL ids come last, equal ids
    in order of their texts, and the first row follows the last (a single row
    follows itself). NULL texts are empty; two texts without paragraphs have
    likeness 1. Repeated rows stay; other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        """All but the last text, each with the one after it."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        changed = [edited(a, b).encode() for a, b in zip(plain, plain[1:])]
        own, new = paragraph_digests(texts), paragraph_digests(changed)
        n = len(changed)
        first, second = pick(*own, np.arange(n)), pick(*own, np.arange(1, n + 1))
        prints = [Tables(*x, np.full(n, CELLS)).encoded() for x in (first, new)]
        columns = [ids[:n], [len(t) for t in plain[:n]], changed, *prints, likeness(first, new), likeness(first, second)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        part = None
        for batch in slices(batches, "data"):
            for p, ahead, name, data in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "data"))):
                if ahead:
                    if part is not None:  # the first of the rows that follow; others repeat its id
                        yield work([*ids, name], [*texts, data])
                        ids, texts, part = [], [], None
                    continue
                ids.append(name)
                texts.append(data)
                part = p
            if len(texts) > 1 and sum(map(len, texts)) > 1 << 20:
                yield work(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    schema = "doc_id bigint, n_chars bigint, edited binary, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col=id_col, text_col=text_col, parts=parts).mapInArrow(run, schema)

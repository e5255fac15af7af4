"""Byte-level BPE as a reduction over a tree.

Encodings form a monoid: the ids of two neighbouring stretches of bytes and the
bytes around their border give the ids of both together. Texts and long matches
are halved down to leaves, leaves are encoded, and neighbours are joined by
encoding again a window around the border that grows until nothing outside it
can change.

* Inside a match of the pattern: a sequence of tokens is the encoding of its
  bytes exactly if every two neighbours are the encoding of theirs. So a window
  is large enough once its first and last token are those that stood there
  before: every pair inside it and on its edges is then sound.
* Between matches: what the pattern matches at a place depends on that place
  and on no more than three characters past the start or one past the end of
  the match. Matches further from the border stand, and once a match of the
  window ends where a match of the right part begins, all later ones stand.

Decoding looks up the bytes of leaves and concatenates up the same tree.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tensorloom.llm.texts import CACHED_PIECES, LONG_PIECE, pieces, slices, text_rows

LEAF_TEXT = 1 << 14
LEAF_MATCH = 48
REACH = 16


NO_PAIR = 1 << 62


class Vocabulary:
    """Ranks of tokens; ids are ranks. ``pairs`` has what two neighbours merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.of_byte = [ranks.get(bytes([b])) for b in range(256)]
        self.pairs = {
            (ranks[token[:k]], ranks[token[k:]]): rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            rows = [x.split() for x in lines if x.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in rows})


def merge_pairs(data: bytes, words: Vocabulary) -> list[int]:
    """Ids of a short stretch: the neighbours of lowest rank are merged, leftmost first."""
    if data in words.ranks:
        return [words.ranks[data]]
    ids = [words.of_byte[b] for b in data]
    get = words.pairs.get
    scores = [get(pair, NO_PAIR) for pair in zip(ids, ids[1:])]
    while scores:
        best = min(scores)
        if best == NO_PAIR:
            break
        at = scores.index(best)
        ids[at : at + 2] = [best]
        del scores[at]
        if at:
            scores[at - 1] = get((ids[at - 1], best), NO_PAIR)
        if at < len(scores):
            scores[at] = get((best, ids[at + 1]), NO_PAIR)
    return ids


def join_tokens(left: list[int], right: list[int], words: Vocabulary) -> list[int]:
    """Ids of the bytes of both lists, each the encoding of its own."""
    if not left or not right:
        return left + right
    i = j = 1
    while True:
        i, j = min(i, len(left)), min(j, len(right))
        window = merge_pairs(b"".join(map(words.token.__getitem__, left[-i:] + right[:j])), words)
        left_holds = i == len(left) or window[0] == left[-i]
        right_holds = j == len(right) or window[-1] == right[j - 1]
        if left_holds and right_holds:
            return left[:-i] + window + right[j:]
        i, j = (i if left_holds else 2 * i), (j if right_holds else 2 * j)


def encode_match(data: bytes, words: Vocabulary, leaf: int = LEAF_MATCH) -> list[int]:
    """Ids of one match of the pattern, halves first."""
    if len(data) <= leaf or data in words.ranks:
        return merge_pairs(data, words)
    middle = len(data) // 2
    return join_tokens(encode_match(data[:middle], words, leaf), encode_match(data[middle:], words, leaf), words)


class TreeCodec:
    """Encoder and decoder for a rank file and a pattern of the regex library."""

    _loaded: dict[tuple, TreeCodec] = {}

    def __init__(self, path: str, pattern: str, leaf_text: int = LEAF_TEXT, leaf_match: int = LEAF_MATCH, limit: int = CACHED_PIECES):
        import regex

        self.words = Vocabulary.read(path)
        self.pattern = regex.compile(pattern)
        self.leaf_text, self.leaf_match, self.limit = leaf_text, leaf_match, limit
        self.known: dict[bytes, bytes] = {b"": b""}
        self.matches: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> TreeCodec:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def cut(self, data: bytes) -> list[bytes]:
        """Parts that end where matches end: white-space pieces, or single matches in unusual texts."""
        parts = pieces(data)
        if len(parts) > 1 or len(data) <= LONG_PIECE:
            return [x for x in parts if x]
        return [x.encode() for x in self.pattern.findall(data.decode("utf-8", "replace"))]

    def join_parts(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Parts of the concatenation; those of the left that reach near the border are cut again."""
        if not left or not right:
            return left + right
        keep, near = len(left), 0
        while keep and (near < REACH or keep == len(left)):
            keep -= 1
            near += len(left[keep])
        start, taken = b"".join(left[keep:]), 1
        while True:
            taken = min(taken, len(right))
            window = start + b"".join(right[:taken])
            ends, at = {len(start)}, len(start)
            for part in right[:taken]:
                at += len(part)
                ends.add(at)
            found, at = [], 0
            for part in self.cut(window):
                found.append(part)
                at += len(part)
                sure = at + REACH <= len(window)
                if at >= len(start) and at in ends and sure:
                    used, size = 0, len(start)
                    while size < at:
                        size += len(right[used])
                        used += 1
                    return left[:keep] + found + right[used:]
            if taken == len(right):
                return left[:keep] + found
            taken *= 2

    def parts(self, data: bytes) -> list[bytes]:
        if len(data) <= self.leaf_text:
            return self.cut(data)
        middle = len(data) // 2
        while data[middle] & 0xC0 == 0x80:  # not inside a character
            middle += 1
            if middle == len(data):
                return self.cut(data)
        return self.join_parts(self.parts(data[:middle]), self.parts(data[middle:]))

    def ids_of_match(self, match: bytes) -> bytes:
        ids = self.matches.get(match)
        if ids is None:
            if len(self.matches) > self.limit:
                self.matches.clear()
            ids = array("I", encode_match(match, self.words, self.leaf_match)).tobytes()
            if len(match) <= LONG_PIECE:
                self.matches[match] = ids
        return ids

    def encode(self, data: bytes) -> bytes:
        """Ids as little-endian 32-bit integers."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
            known[b""] = b""
        parts, long = self.parts(data), []
        for part in set(parts).difference(known):
            found = self.pattern.findall(part.decode("utf-8", "replace"))
            known[part] = b"".join([self.ids_of_match(x.encode()) for x in found])
            if len(part) > LONG_PIECE:
                long.append(part)
        ids = b"".join(map(known.__getitem__, parts))
        for part in long:
            del known[part]
        return ids

    def decode(self, ids: bytes) -> bytes:
        if len(ids) > 4 * self.leaf_text:
            middle = len(ids) // 8 * 4
            return self.decode(ids[:middle]) + self.decode(ids[middle:])
        found = array("I")
        found.frombytes(ids)
        return b"".join(map(self.words.token.__getitem__, found))


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (4 bytes each). NULL and empty texts have no ids.

    Repeated rows stay; other columns are not read. Bytes that are not UTF-8
    are encoded as replacement characters.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec.of(ranks, pattern)
        for batch in slices(batches, "data"):
            ids = [codec.encode(x) for x in batch.column("data").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds ``data``, the bytes of the ids, to rows of doc_id, n_tokens and ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec.of(ranks, pattern)
        for batch in slices(batches, "ids"):
            data = [codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield batch.append_column("data", pa.array(data, pa.binary()))

    columns = encoded.select("doc_id", "n_tokens", "ids")
    return columns.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, data binary")

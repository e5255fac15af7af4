"""Shared pieces of the text operators: scans in bounded slices, words, encoders.

Texts cross into Python as UTF-8 bytes. A slice holds whole documents of a few
megabytes, and a single long document is worked on in windows, so the memory of
a task does not depend on how long texts are.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.session import ensure_checkpoint_dir

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 19  # where a slice becomes several arrays of eight bytes for each of its own, or a list of its words
WINDOW_BYTES = 1 << 20
CACHED_PIECES = 600_000
LONG_PIECE = 64


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_bytes(text: str | Column, missing: bytes | None = b"") -> Column:
    """UTF-8 bytes of a text column; NULL texts become ``missing``."""
    data = (F.col(text) if isinstance(text, str) else text).cast("binary")
    return data if missing is None else F.coalesce(data, F.lit(bytearray(missing)))


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each part stay near ``limit`` bytes."""
    for batch in batches:
        sizes = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(sizes), 0)).cumsum()
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def windows(data: bytes, size: int = WINDOW_BYTES) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, cut only before ASCII white space that follows a word."""
    start, n = 0, len(data)
    while n - start > size:
        cut = _BREAK.search(data, start + size)
        if not cut:
            break
        yield data[start : cut.start() + 1]
        start = cut.start() + 1
    yield data[start:]


_BREAK = re.compile(rb"[^ \t\r\n](?=[ \t\r\n])")
_RUNS = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r")
# White space or separators beyond space, tab and line ends, in UTF-8.
_ODD = (
    b"\x00", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0",
    b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf",
)
_ODD_SPACES = re.compile(rb"\xe2\x80[\x80-\x8f\xa8-\xaf]")
# White space, Latin letters, marks without the apostrophe. Neither letters and marks nor a line end and letters share a token.
_WORD = re.compile(rb"([\n ]?)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
# What parts a special token from such a word: a mark or digit before a letter.
_NO_WORD = re.compile(r"[!-@\[-`{-~][A-Za-z]")
# Byte-level vocabularies write printable bytes as themselves and the others, in order, from code point 256 on.
_OTHERS = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_NAMES = {b: chr(256 + k) for k, b in enumerate(_OTHERS)}
_PIECE = re.compile(rb"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")


def pieces(data: bytes) -> list[bytes]:
    """Parts that byte-level and word tokenizers treat independently of each other.

    Cuts lie only where white space follows a word. No pre-tokenizer pattern used
    here has a match across such a place, and what a run of white space gives
    depends on that run and the next character alone. Texts with other kinds of
    white space stay whole, because libraries differ about those.
    """
    if any(x in data for x in _ODD) or (b"\xe2\x80" in data and _ODD_SPACES.search(data)):
        return [data]
    if any(x in data for x in _RUNS):
        return _PIECE.findall(data)
    return data.replace(b" ", b"\x00 ").replace(b"\n", b"\x00\n").split(b"\x00")


class _Known(dict):
    """Ids of pieces; a piece that is not there is encoded, and kept unless it is long."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__({b"": b""})
        self.encode = encode

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of texts by the tokenizers library, each distinct piece encoded once.

    Ids are kept per piece as little-endian bytes of ``width``. Pieces repeat so
    often that most of a text is looked up. When the table has ``limit`` entries
    it becomes the old one and a new one begins, into which pieces move as they
    come up again; so it is bounded and frequent pieces stay. Pieces of more
    than ``LONG_PIECE`` bytes are not kept. A tokenizer that drops white space
    and lowers letters gets lower-case words, of which there are fewer. Words of
    Latin letters go straight to the model of the library, past its normalizer
    and its patterns, where samples show that these leave them whole.

    Ids are those of a plain library call, so the strings of special tokens
    give their special ids; with ``as_text`` they are ordinary text.
    """

    _loaded: dict[tuple, PieceEncoder] = {}

    def __init__(self, path: str, width: int = 4, limit: int = CACHED_PIECES, as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        self.code = {2: "H", 4: "I"}[width]
        self.limit, self.known, self.old = limit, _Known(self._ids), {}
        plain = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        folds = not plain(" \t\r\n") and plain("A \n\tBc d") == plain("a") + plain("bc") + plain("d")
        self.cut = self._folded if folds else pieces
        names = [] if as_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, names)), re.IGNORECASE) if names else None
        # What no case changes and all of them begin with: sought first, as it is quick to find.
        self.hint = re.match(rb"[^A-Za-z\x80-\xff]*", os.path.commonprefix(names))[0] if names else b""
        self.folds, self.tokenize = folds, self.tokenizer.model.tokenize
        samples = ["a", "aB", "Word", "XYZ", "\u00e9t\u00e9", "\u00c0\u00dfc\u00d6", "a" * 50, *([] if folds else [" a", " aBc", " \u00c9t\u00e9"])]
        parted = [x + m for x in samples for m in ("", ".", "&&&,", "|>", "---")]
        self.by_words = (
            all(_NO_WORD.search(n.decode()) for n in names)
            and all(plain(x) == array(self.code, self._word(x.lower().encode() if folds else x.encode())).tolist() for x in samples)
            and all(plain(x) == plain(x.rstrip(".&,|>-")) + plain(x[len(x.rstrip(".&,|>-")) :]) for x in parted)
            and plain("\nabc") == plain("\n") + plain("abc")
        )

    @classmethod
    def of(cls, path: str, width: int = 4, as_text: bool = False, limit: int = CACHED_PIECES) -> PieceEncoder:
        """One encoder per Python worker, vocabulary, reading of special tokens and size of its table."""
        key = path, width, as_text, limit
        if key not in cls._loaded:
            cls._loaded[key] = cls(path, width, limit, as_text)
        return cls._loaded[key]

    def _has_special(self, data: bytes) -> bool:
        return self.special is not None and self.hint in data and bool(self.special.search(data))

    def _folded(self, data: bytes) -> list[bytes]:
        """Lower-case words; those with the string of a special token, in any case, as they stand."""
        if self._has_special(data):
            return [x if self._has_special(x) else x.lower() for x in data.split()]
        return data.lower().split()

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        parts = [self.cut(x) if len(x) <= WINDOW_BYTES else None for x in texts]
        found = self._look_up([p for p in parts if p is not None])
        return [next(found) if p is not None else self._long(x) for p, x in zip(parts, texts)]

    def _long(self, data: bytes) -> bytes:
        return b"".join(ids for part in windows(data) for ids in self._look_up([self.cut(part)]))

    def _look_up(self, groups: list[list[bytes]]) -> Iterator[bytes]:
        """Ids of each group of pieces."""
        if len(self.known) > self.limit:
            self.known, self.old = _Known(self._ids), self.known
        ids_of = self.known.__getitem__
        return iter([b"".join(map(ids_of, group)) for group in groups])

    def _ids(self, piece: bytes) -> bytes:
        """Ids of a piece that the table does not hold."""
        ids = self.old.get(piece)
        if ids is not None:
            return ids
        found = _WORD.fullmatch(piece) if self.by_words else None
        if found is None:
            return self._library(piece)
        lead, letters, marks = found.groups()
        if lead == b"\n":
            return self.known[lead] + self.known[letters] + self.known[marks]
        return self.known[lead + letters] + self.known[marks] if marks else self._word(piece)

    def _library(self, piece: bytes) -> bytes:
        found = self.tokenizer.encode_batch_fast([piece.decode("utf-8", "replace")], add_special_tokens=False)
        return array(self.code, found[0].ids).tobytes()

    def _word(self, data: bytes) -> bytes:
        """Ids of Latin letters, perhaps after a space, by the model alone."""
        if data.isascii():
            text = data.decode("ascii").replace(" ", _BYTE_NAMES[0x20])
        else:
            text = (data.decode().lower().encode() if self.folds else data).decode("latin-1").translate(_BYTE_NAMES)
        return array(self.code, [t.id for t in self.tokenize(text)]).tobytes()


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the id, the text as bytes (NULL: empty), under fixed names, and what is asked for besides."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(F.col(f"`{text_col}`")).alias("data"), *more)

"""Hashes of words and of runs of words, vectorised over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tensorloom.llm.texts import WINDOW_BYTES, windows

RUN = 5
_MOST = 4 * WINDOW_BYTES
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; no longer than what was asked for so far needs."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n - 1, 1 << 16).bit_length()
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table, out=table))
    return _powers


def byte_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base**place; differences give hashes of stretches."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + _U(1)) * _tables(len(values))[0][: len(values)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to each end, the same wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * _tables(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def _words(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of concatenated texts, and how many words begin before each text."""
    solid = ~_SPACE[values]
    first = np.zeros(len(values) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~first[:-1]
    starts = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) & ~first[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return stretch_hashes(byte_sums(values), starts, ends), np.searchsorted(starts, offsets)


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one text of any length."""
    found = []
    for part in windows(data):
        if len(part) <= _MOST:
            found.append(_words(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0])
        else:  # words of megabytes
            found.append(np.array([_scalar(w) for w in part.split()], np.uint64))
    return np.concatenate(found)


def _scalar(word: bytes) -> int:
    if len(word) > _MOST:
        return xxhash.xxh64_intdigest(word)
    return int(_words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a slice, and the place of each text's first word."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if offsets[-1] - offsets[0] <= _MOST:
        raw = texts.buffers()[2]
        values = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
        return _words(values, offsets - offsets[0])
    each = [word_hashes(x.as_py()) for x in texts]
    return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def run_hashes(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hashes of all runs of ``run`` words; the whole text where it has fewer words."""
    n = len(words)
    if n == 0:
        return words
    width = min(run, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = total * _U(_BASE) + words[k : n - width + 1 + k]
    return mixed(total)


def run_sets(texts: pa.Array, run: int = RUN) -> Iterator[np.ndarray]:
    """Sorted distinct run hashes of each text of a slice."""
    words, places = batch_words(texts)
    for a, b in zip(places[:-1], places[1:]):
        yield np.unique(run_hashes(words[a:b], run))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; 0 where either is empty."""
    if not len(a) or not len(b):
        return 0.0
    places = np.searchsorted(a, b)
    places[places == len(a)] = len(a) - 1
    both = int((a[places] == b).sum())
    return both / (len(a) + len(b) - both)

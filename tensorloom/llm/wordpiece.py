"""Token counts by greedy longest match in time linear in the text.

The vocabulary is a trie with a root for the start of a word and one for its
continuation. A node that cannot go on with the next byte has a failure link to
the node for what is left after the pieces that are certain by then, and the
number of those pieces is stored with the link. Counting walks the links and
adds the numbers; no piece is ever built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tensorloom.llm.texts import CACHED_PIECES, LONG_PIECE, slices, text_rows

ROOT, CONTINUED = 0, 1


class LongestMatch:
    """Piece counts of words; a word that greedy matching cannot cut is one unknown piece."""

    _loaded: dict[str, LongestMatch] = {}

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes], limit: int = CACHED_PIECES):
        self.next: dict[int, int] = {}
        whole = {}
        parents = [(-1, 0), (-1, 0)]
        for root, words in ((ROOT, first), (CONTINUED, later)):
            for word in words:
                node = root
                for byte in word:
                    key = node << 8 | byte
                    if key not in self.next:
                        self.next[key] = len(parents)
                        parents.append((node, byte))
                    node = self.next[key]
                if word:
                    whole[node] = True
        self.fail, self.popped = [-1] * len(parents), [0] * len(parents)
        depth = [0] * len(parents)
        for node in range(2, len(parents)):
            depth[node] = depth[parents[node][0]] + 1
        for node in sorted(range(2, len(parents)), key=depth.__getitem__):
            if node in whole:
                self.fail[node], self.popped[node] = CONTINUED, 1
                continue
            parent, byte = parents[node]
            at, popped = self.fail[parent], self.popped[parent]
            while at >= 0 and (at << 8 | byte) not in self.next:
                popped += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.next[at << 8 | byte], popped
        self.limit, self.known = limit, {}

    @classmethod
    def from_ranks(cls, path: str) -> LongestMatch:
        """Vocabulary of a rank file: pieces with a leading space start words, those without continue them.

        Every single byte may do both, so every word can be cut.
        """
        if path not in cls._loaded:
            with open(path, "rb") as lines:
                tokens = [base64.b64decode(x.split()[0]) for x in lines if x.strip()]
            single = [bytes([b]) for b in range(256)]
            cls._loaded[path] = cls(
                [*single, *(t[1:] for t in tokens if t[:1] == b" " and len(t.split()) == 1 and not t[1:2].isspace())],
                [*single, *(t for t in tokens if len(t.split()) == 1 and t.split()[0] == t)],
            )
        return cls._loaded[path]

    def count(self, word: bytes) -> int:
        """Number of pieces; 0 for an empty word, -1 where no cut exists."""
        node, total = ROOT, 0
        step, fail, popped = self.next.get, self.fail, self.popped
        for byte in word:
            while (to := step(node << 8 | byte)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = to
        while node > CONTINUED:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return total

    def counts(self, words: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        long = []
        for word in set(words).difference(known):
            known[word] = self.count(word)
            if len(word) > LONG_PIECE:
                long.append(word)
        found = [known[w] for w in words]
        for word in long:
            del known[word]
        return found


def token_counts(docs: DataFrame, ranks: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens, n_unknown, most_pieces (of one word).

    Words are runs without ASCII white space. A word that cannot be cut counts
    as one token and as unknown. NULL and empty texts have 0 everywhere;
    repeated rows stay, other columns are not read.
    """
    names = ["doc_id", "n_words", "n_tokens", "n_unknown", "most_pieces"]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch.from_ranks(ranks)
        for batch in slices(batches, "data"):
            rows = []
            for data in batch.column("data").to_pylist():
                found = automaton.counts(data.split())
                unknown = found.count(-1)
                rows.append((len(found), sum(found) + 2 * unknown, unknown, max(1 if unknown else 0, max(found, default=0))))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return text_rows(docs, id_col, text_col).mapInArrow(count, ", ".join(f"{n} bigint" for n in names))

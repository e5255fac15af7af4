"""Quality rules as a ledger: every rule once, failures as bits, policies afterwards.

One pass measures each text. A ledger row holds the measurements and a mask
whose bit k says that rule k failed. A policy is a mask as well, so a new
version of it, or the question what a rule rejects that no other does, needs the
stored ledger alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.llm.texts import as_bytes

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
    "n_top_word",
)

# Name and failing condition, in SQL over the measurements. The place is the bit:
# new rules go to the end, and none is ever moved.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines > 5 AND 2 * n_dup_lines > n_lines"),
    ("capitals", "2 * n_upper > n_letters"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("one_word", "5 * n_top_word > 2 * n_words"),
)

# Rules that a version of the policy enforces.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "capitals"),
    3: tuple(name for name, _ in RULES),
}
BASE, CURRENT = 1, 3

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + _UPPER.lower()
_TAILS = bytes(range(0x80, 0xC0))
# Letters of the Latin-1 supplement in UTF-8: À to ÿ without the two signs.
_LATIN = re.compile(rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]")
_LATIN_UPPER = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
# Characters that those counts do not know: beyond Latin-1, and its letters outside the range above.
_LATIN_BYTES = bytes(range(0xC4))
_ODD_LETTERS = (b"\xc2\xaa", b"\xc2\xb5", b"\xc2\xba")


def measure(data: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = lambda drop: len(data) - len(data.translate(None, drop))
    if not data.isascii() and (data.translate(None, _LATIN_BYTES) or any(x in data for x in _ODD_LETTERS)):
        letters, upper = letters_of(data)
    else:
        letters, upper = count(_LETTERS), count(_UPPER)
        if b"\xc3" in data:
            letters += len(_LATIN.findall(data))
            upper += len(_LATIN_UPPER.findall(data))
    return (
        len(words), len(data.translate(None, _SPACE + _TAILS)), count(_SYMBOLS), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), letters, upper, max(Counter(words).values(), default=0),
    )


def letters_of(data: bytes) -> tuple[int, int]:
    """Letters of all scripts with the marks that combine with them, and capitals among them."""
    letters = upper = 0
    for char, n in Counter(data.decode("utf-8", "replace")).items():
        kind = unicodedata.category(char)
        letters += n * (kind[0] in "LM")
        upper += n * (kind == "Lu")
    return letters, upper


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the list."""
    found = list(zip(words, words[1:], words[2:]))
    if len(set(found)) == len(found):
        return 0
    times = Counter(found)
    total = end = 0
    for i, x in enumerate(found):
        if times[x] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


_RESULT = pa.struct([(n, pa.int64()) for n in MEASURES])


def _measured(data: pa.Array) -> pa.Array:
    columns = list(zip(*[measure(x.as_py()) for x in data])) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_RESULT))


def mask(names: tuple[str, ...]) -> int:
    known = [name for name, _ in RULES]
    return sum(1 << known.index(n) for n in set(names))


def ledger(docs: DataFrame, *, text_col: str = "text", name: str = "ledger") -> DataFrame:
    """All rows and columns with a struct column ``name``: measurements and ``failed``.

    A NULL or empty text measures 0 everywhere and fails ``few_words``.
    Repeated rows stay; a column that is already called ``name`` is replaced.
    """
    measure_all = F.arrow_udf(_measured, T.StructType([T.StructField(n, T.LongType()) for n in MEASURES]))
    measured = docs.withColumn(name, measure_all(as_bytes(F.col(f"`{text_col}`"))))
    bits = [
        F.expr(f"IF({_NAMES.sub(lambda m: f'`{name}`.{m[0]}', rule)}, {1 << k}L, 0L)")
        for k, (_, rule) in enumerate(RULES)
    ]
    failed = reduce(lambda a, b: a.bitwiseOR(b), bits)
    fields = [F.col(f"`{name}`").getField(n).alias(n) for n in MEASURES]
    return measured.withColumn(name, F.struct(*fields, failed.alias("failed")))


_NAMES = re.compile(rf"\b({'|'.join(MEASURES)})\b")


def rejects(failed: str | Column, version: int = CURRENT) -> Column:
    """Whether a policy version rejects a row with this mask."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(mask(POLICIES[version])).cast("bigint")) != 0


def ablation(rows: DataFrame, failed: str = "failed", version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: rows it rejects, rows only it rejects, rows kept without it.

    Rows are counted per distinct mask first, so what is shuffled is bounded by
    the number of masks however large the ledger is. A NULL mask is counted as
    kept. One row per rule, also over an empty ledger.
    """
    active = mask(POLICIES[version])
    by_mask = rows.groupBy(F.coalesce(F.col(failed), F.lit(0)).bitwiseAND(F.lit(active).cast("bigint")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    known = [name for name, _ in RULES]
    bits = [(n, 1 << known.index(n)) for n in POLICIES[version]]
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    hit = lambda b: F.col("m").bitwiseAND(F.lit(b).cast("bigint")) != 0
    only = lambda b: F.col("m") == F.lit(b).cast("bigint")
    lines = F.array(*[
        F.struct(F.lit(n).alias("rule"), total(hit(b)).alias("rejected"), total(only(b)).alias("only_this"), total((F.col("m") == 0) | only(b)).alias("kept_without"))
        for n, b in bits
    ])
    return by_mask.agg(lines.alias("lines")).select(F.inline("lines"))

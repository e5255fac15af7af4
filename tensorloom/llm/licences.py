"""Licence scan by conditional compression.

Words that speak of licences, copyright or warranty are hints, wherever they
stand in a line. Around each hint every template gets a window of words that
holds any wording of it there, over line ends and inside long lines alike. The
window is compressed alone and with the template as a raw dictionary; what the
template saves, as a share of its own compressed size, says whether the window
speaks of it at all. Every template that saves enough is aligned word by word,
and of the places with few enough differing words all disjoint ones are results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tensorloom.llm.texts import slices, text_rows

_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu_notice(work: str, licence: str, version: str) -> str:
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {licence} as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
        f"later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"{licence} for more details."
    )


# Customary wordings of licence notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0.",
    "all-rights-reserved": "Copyright. All rights reserved.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause-full": _BSD_GRANT + _BSD_DISCLAIMER,
    "BSD-3-Clause-full": (
        _BSD_GRANT + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. "
        + _BSD_DISCLAIMER
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0-notice": _gnu_notice("program", "GNU General Public License", "3"),
    "GPL-2.0-notice": _gnu_notice("program", "GNU General Public License", "2"),
    "LGPL-2.1-notice": _gnu_notice("library", "GNU Lesser General Public License", "2.1"),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
}

# What a candidate line has, in lower case.
HINTS = (b"licens", b"licenc", b"copyright", b"warrant", b"redistribut", b"public domain", b"rights reserved", b"permission is hereby")
LEAST_SAVED = 0.15
MOST_DIFFERENT = 0.2
_LEVEL = 19
_HINT = re.compile(b"|".join(re.escape(h).replace(rb"\ ", rb"[^0-9A-Za-z\x80-\xff]+") for h in HINTS))
_START = 1 << 32  # an alignment is its differing words, then its start counted down, in one number
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+(?:[.-][0-9A-Za-z\x80-\xff]+)*")


def words(block: bytes) -> list[bytes]:
    return [w.lower() for w in _WORD.findall(block)]


def candidate_blocks(data: bytes) -> Iterator[tuple[int, int]]:
    """Maximal runs of lines with a hint, as (start, end) in bytes."""
    low = data.lower()
    if not any(h in low for h in HINTS):
        return
    start, at = -1, 0
    for line in low.split(b"\n"):
        if any(h in line for h in HINTS):
            if start < 0:
                start = at
            end = at + len(line)
        elif start >= 0:
            yield start, end
            start = -1
        at += len(line) + 1
    if start >= 0:
        yield start, end


class Scanner:
    """Compressors of all templates, made once per worker.

    Templates and texts are compressed as their words in lower case, so line
    ends, comment marks and capitals make no difference.
    """

    _made: dict[tuple, Scanner] = {}

    def __init__(self, templates: dict[str, str]):
        self.plain = zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False)
        self.templates = {}
        for name, text in templates.items():
            own = words(text.encode())
            said = b" ".join(own)
            given = zstandard.ZstdCompressionDict(said, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=_LEVEL, dict_data=given, write_content_size=False)
            self.templates[name] = (packer, own, len(self.plain.compress(said)), Counter(own))

    @classmethod
    def of(cls, templates: dict[str, str]) -> Scanner:
        key = tuple(templates.items())
        if key not in cls._made:
            cls._made[key] = cls(templates)
        return cls._made[key]

    def saved(self, name: str, window: list[bytes]) -> float:
        """What a template saves of a window, as a share of the template's own compressed size."""
        packer, _, size, _ = self.templates[name]
        data = b" ".join(window)
        return (len(self.plain.compress(data)) - len(packer.compress(data))) / size

    def places(self, name: str, window: list[bytes]) -> list[tuple[int, int, int]]:
        """Parts of a window that differ from a template in few enough words: how many, start and end.

        Missing and additional words count. Row by row over the template, for
        all ends in the window at a time; of a start the end with the fewest.
        """
        own = self.templates[name][1]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(own))}
        found = np.array([numbers.get(w, -1) for w in window], np.int64)
        steps = np.arange(len(window) + 1) * _START
        best = _START - 1 - np.arange(len(window) + 1)
        for word in own:
            row = best + _START
            row[1:] = np.where(found == numbers[word], np.minimum(row[1:], best[:-1]), row[1:])
            best = np.minimum.accumulate(row - steps) + steps
        least: dict[int, tuple[int, int, int]] = {}
        for end in np.flatnonzero(best // _START <= MOST_DIFFERENT * len(own)).tolist():
            count, start = int(best[end]) // _START, _START - 1 - int(best[end]) % _START
            least[start] = min(least.get(start, (count, start, end)), (count, start, end))
        return list(least.values())

    def near(self, at: list[int], n: int, size: int) -> Iterator[tuple[int, int]]:
        """Windows of words that hold each stretch of up to 1.2 times ``size`` words around a hint whole."""
        reach, low, high = int((1 + MOST_DIFFERENT) * size) + 1, -1, -1
        for place in [*at, None]:
            if place is not None and 0 <= high and place - reach <= high:
                high = min(n, place + reach + 1)
                continue
            if high >= 0:
                for start in range(low, max(low + 1, high - 2 * reach), 2 * reach):
                    yield start, min(high, start + 4 * reach)
            if place is not None:
                low, high = max(0, place - reach), min(n, place + reach + 1)

    def confirmed(self, own: list[bytes], at: list[int]) -> list[tuple[int, int, str, float, int]]:
        """All disjoint matches near hints: start and end in words, template, saved share, differing words.

        Of overlapping ones that with more words in common, less those that
        differ, wins, then the one with fewer that differ, the one that saves
        more, the first by name.
        """
        found = {}
        for name, (_, template, _, has) in self.templates.items():
            most = MOST_DIFFERENT * len(template)
            for a, b in self.near(at, len(own), len(template)):
                window = own[a:b]
                met = set(window)
                # So many template words are missing for certain.
                if sum(k for w, k in has.items() if w not in met) > most:
                    continue
                saved = self.saved(name, window)
                if saved >= LEAST_SAVED:
                    for count, start, end in self.places(name, window):
                        key = (count - len(template), count, -saved, name, a + start, a + end)
                        found[key] = None
        taken: list[tuple] = []
        for _, count, saved, name, start, end in sorted(found):
            k = bisect_left(taken, (start,))
            if (k == len(taken) or taken[k][0] >= end) and (k == 0 or taken[k - 1][1] <= start):
                insort(taken, (start, end, name, -saved, count))
        return taken

    def matches(self, data: bytes) -> list[tuple[int, int, str, float, int]]:
        """As ``confirmed``, for a text and in bytes."""
        low = data.lower()
        hints = [m.start() for m in _HINT.finditer(low)]
        if not hints:
            return []
        spans = np.array([m.span() for m in _WORD.finditer(low)], np.int64).reshape(-1, 2)
        at = np.unique(np.searchsorted(spans[:, 0], hints, "right") - 1).tolist()
        own = [low[a:b] for a, b in spans.tolist()]
        return [(int(spans[a, 0]), int(spans[b - 1, 1]), *rest) for a, b, *rest in self.confirmed(own, at)]

    def match(self, block: bytes) -> tuple[str, float, int] | None:
        """Template, saved share and number of differing words of the match with most words in common."""
        best = None
        for _, _, name, saved, count in self.matches(block):
            key = (count - len(self.templates[name][1]), count, -saved, name)
            if best is None or key < best[0]:
                best = (key, (name, saved, count))
        return best and best[1]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Confirmed notices: doc_id, start, end (bytes), licence, saved, n_different.

    A row per disjoint place at which a template was confirmed, from its first
    word to its last; texts without one, NULL and empty texts give no row.
    ``saved`` is a share of the template's own compressed size. Of templates
    that overlap the one with more words in common wins (``Scanner.confirmed``).
    Rows that repeat give their places again; other columns are not read.
    """
    templates = dict(TEMPLATES if templates is None else templates)
    names = ["doc_id", "start", "end", "licence", "saved", "n_different"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(templates)
        for batch in slices(batches, "data"):
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist()):
                rows += [(doc, *found) for found in scanner.matches(data)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, start bigint, end bigint, licence string, saved double, n_different bigint")

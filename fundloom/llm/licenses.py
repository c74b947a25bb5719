"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Every template's word n-grams are hashed; of each window of neighbouring hashes the least is kept in an inverted
index. Gram and window follow from the template's length, so that changes within the coverage leave one hash whole. A
text's n-grams are looked up in it. The diagonals on which a template is hit make candidates, neighbouring ones of a
long template together; one is dropped if its region does not even hold enough of the template's words, in whatever
order, so no match is lost by that. What is left is aligned with the whole template in a band around its diagonals, as
wide as words may be put in or left out; what is matched is reported with its coverage and span. The index is some hundreds of entries, given by the templates and not by the data, so the scan is
one pass without a shuffle.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a fingerprint and fingerprints in a winnowing window, at most; words that an alignment may shift, at least, and one in how many of the template's.
GRAM, WINNOW, BAND, SHIFT = 3, 3, 4, 6
#: Words of a template from which on neighbouring diagonals are one candidate: copies of it are further apart than its band is wide.
LONG = 64
COVERAGE = 0.8
PUNCTUATION = b"\"'`.,;:!?()[]{}<>*#/-_"

#: Notices by which documents name their license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}

def _gnu(program: str, license: str, version: str) -> str:
    """The header that the GNU licenses ask for."""
    return (
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {license} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license} for more details."
    )


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Texts and usual headers of common licenses. The long texts of the GNU, Apache, Mozilla and Creative Commons licenses are not among them, their headers are.
TEXTS = {
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": _BSD + _BSD_END,
    "bsd-3-clause": _BSD + _BSD_NAMES + _BSD_END,
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "gpl-2.0": _gnu("program", "General Public License", "2"),
    "gpl-3.0": _gnu("program", "General Public License", "3"),
    "lgpl-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "lgpl-3.0": _gnu("program", "Lesser General Public License", "3"),
    "agpl-3.0": _gnu("program", "Affero General Public License", "3"),
}

#: Names of SPDX-License-Identifier lines.
SPDX = {
    "mit": ("MIT",), "isc": ("ISC",), "bsd-2-clause": ("BSD-2-Clause",), "bsd-3-clause": ("BSD-3-Clause",), "apache-2.0": ("Apache-2.0",), "mpl-2.0": ("MPL-2.0",), "unlicense": ("Unlicense",),
    "gpl-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"), "gpl-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"),
    "lgpl-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+"), "lgpl-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+"),
    "agpl-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "cc-by-4.0": ("CC-BY-4.0",), "cc-by-sa-4.0": ("CC-BY-SA-4.0",), "cc-by-nc-4.0": ("CC-BY-NC-4.0",), "cc0-1.0": ("CC0-1.0",),
}

#: What the query scans for: short notices, texts and headers, SPDX lines.
PRODUCTION = {
    name: tuple(t for t in (TEMPLATES.get(name), TEXTS.get(name), *(f"SPDX-License-Identifier: {x}" for x in SPDX.get(name, ()))) if t) for name in sorted({*TEMPLATES, *TEXTS, *SPDX})
}


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words between white space, without punctuation around them; one that is all punctuation is empty."""
    return [w.strip(PUNCTUATION) for w in (text or b"").lower().split()]


def _hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def winnow(words: list[bytes], gram: int = GRAM, window: int = WINNOW) -> list[tuple[int, int]]:
    """(position, hash) of the least hash of each window; a text shorter than a gram is one gram."""
    size = min(gram, len(words))
    hashes = [_hash(words[k : k + size]) for k in range(len(words) - size + 1)] if words else []
    picked = {min(range(k, min(k + window, len(hashes))), key=lambda i: (hashes[i], -i)) for k in range(max(1, len(hashes) - window + 1))} if hashes else set()
    return [(k, hashes[k]) for k in sorted(picked)]


def grain(n: int, coverage: float = COVERAGE) -> tuple[int, int]:
    """Gram and window for a template of n words: a fingerprint stays whole if any words that the coverage allows are changed, or one is put in."""
    lost = int((1 - coverage) * n + 1e-9)
    run = max(1, min(-(-(n - lost) // (lost + 1)), -(-n // 2)))  # words side by side that are left at least
    gram = min(GRAM, run)
    return gram, min(WINNOW, run - gram + 1)


class Index:
    """Templates: a text, or several, for each license."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]], coverage: float = COVERAGE) -> None:
        self.words = {(name, k): words_of(text.encode()) for name, texts in templates.items() for k, text in enumerate([texts] if isinstance(texts, str) else texts)}
        self.postings: dict[int, dict[int, list[tuple[tuple[str, int], int]]]] = defaultdict(lambda: defaultdict(list))  # by gram size
        self.first: set[bytes] = set()
        for own, words in self.words.items():
            size, window = grain(len(words), coverage)
            for at, h in winnow(words, size, window):
                self.postings[size][h].append((own, at))
                self.first.add(words[at])

    def scan(self, text: bytes | None, coverage: float = COVERAGE) -> list[tuple[str, int, int, int, float]]:
        """(template, first word, word behind the last, matched words, coverage), best first where they overlap."""
        words = words_of(text)
        diagonals: dict[tuple[str, int], set[int]] = defaultdict(set)
        for k, word in enumerate(words):
            if word in self.first:
                for size, found in self.postings.items():
                    for own, at in found.get(_hash(words[k : k + size]), ()):
                        diagonals[own].add(k - at)
        found = []
        for own, seen in diagonals.items():
            found += [self._align(own[0], self.words[own], words, low, high) for low, high in self._regions(self.words[own], words, sorted(seen), coverage)]
        # Of overlapping matches the one with most matched words stays.
        kept: list[tuple[str, int, int, int, float]] = []
        for m in sorted((m for m in found if m and m[4] >= coverage), key=lambda m: (-m[3], -m[4], m[1], m[0])):
            at = bisect.bisect_left(kept, m[1], key=lambda x: x[1])  # kept ones lie apart, in order: only its neighbours can overlap it
            if (at == 0 or kept[at - 1][2] <= m[1]) and (at == len(kept) or m[2] <= kept[at][1]):
                kept.insert(at, m)
        return kept

    @staticmethod
    def _regions(own: list[bytes], words: list[bytes], diagonals: list[int], coverage: float) -> Iterator[tuple[int, int]]:
        """Bands of diagonals (lowest, highest) to align: hits side by side, whose region holds as many of the template's words as the coverage needs."""
        n, shift = len(own), max(BAND, len(own) // SHIFT)
        step = shift if n >= LONG else 1
        bag, held, inside, a, b = Counter(own), Counter(), 0, 0, 0
        for _, group in itertools.groupby(diagonals, lambda d: d // step):
            hits = list(group)
            low, high = hits[0] - shift, hits[-1] + shift
            first, last = max(0, low), min(len(words), high + n)
            if first >= b:
                held, inside, a, b = Counter(), 0, first, first
            while b < last:
                held[words[b]] += 1
                inside += held[words[b]] <= bag[words[b]]
                b += 1
            while a < first:
                inside -= held[words[a]] <= bag[words[a]]
                held[words[a]] -= 1
                a += 1
            if inside >= coverage * n - 1e-9:
                yield low, high

    def _align(self, name: str, own: list[bytes], words: list[bytes], low: int, high: int) -> tuple[str, int, int, int, float] | None:
        """The template against the words on diagonals low to high: match 2, else -1; the text's ends are free."""
        width = high - low + 1
        # Cell b of row i stands for word i + low + b of the text: (score, matched, first matched, behind last matched).
        row = [(0, 0, -1, -1)] * (width + 1)
        for i, want in enumerate(own):
            new = []
            for b in range(width):
                k = i + low + b
                score, matched, start, end = row[b]
                if 0 <= k < len(words) and words[k] == want:
                    best = (score + 2, matched + 1, k if start < 0 else start, k + 1)
                else:
                    best = (score - 1, matched, start, end)
                if b + 1 < width and row[b + 1][0] - 1 > best[0]:  # the template's word is missing
                    best = (row[b + 1][0] - 1, *row[b + 1][1:])
                if b and new[b - 1][0] - 1 > best[0]:  # the text has one more
                    best = (new[b - 1][0] - 1, *new[b - 1][1:])
                new.append(best)
            row = [*new, (-(10**9), 0, -1, -1)]
        _, matched, start, end = max(enumerate(row[:width]), key=lambda x: (x[1][1], x[1][0], -abs(x[0] - (width - 1) / 2)))[1]
        return (name, start, end, matched, matched / len(own)) if matched else None


def scan_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, start_word, end_word, matched_words, coverage): a row per notice found, words counted from 0.

    Words put in or left out shift what follows; a match is found as long as that is no more than one in SHIFT of the
    template's words on either side. A null or empty text has none. Repeated rows are scanned each; of overlapping notices the one with most matched
    words is reported, the first by name in a tie. A row without doc_id keeps a null id. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    texts = templates or PRODUCTION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(texts, coverage)
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in index.scan(text.as_py(), coverage)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "start_word", "end_word", "matched_words", "coverage"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, license string, start_word long, end_word long, matched_words long, coverage double")

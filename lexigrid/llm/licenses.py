"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Runs of `GRAM` words of each template are hashed, and winnowing keeps the least hash of every `WINNOW` neighbours, in an
inverted index from hash to (template, word). Every run of a document is looked up; hits on neighbouring diagonals are one
candidate, which is aligned with the template within a band around them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import reachable
from .text import U, Words, mix, slices

GRAM, WINNOW = 3, 4
#: Templates of fewer words have all their runs in the index.
SHORT = 2 * (GRAM + WINNOW)
#: Words that may be inserted or left out before the alignment leaves its band.
BAND = 6
#: Share of a template's words that a reported match covers.
COVERAGE = 0.8

TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}


_AS_IS = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
#: Whole licenses beside the notices and grants above.
TEMPLATES |= {
    "MIT": TEMPLATES["MIT-grant"]
    + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": _CONDITIONS + _AS_IS,
    "BSD-3-Clause": _CONDITIONS
    + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission." + _AS_IS,
    "ISC": TEMPLATES["ISC-grant"]
    + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of every run of GRAM words that lies in one row."""
    h, n = words.hash, len(words.hash) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out * U(0xD6E8FEB86659FD93) + h[k : n + k]
    at = np.flatnonzero(words.row[:n] == words.row[GRAM - 1 :])
    return at, mix(out[at])


class Index:
    """Winnowed fingerprints of templates: sorted hashes, with template and word position of each."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [Words(pa.array([templates[n]])) for n in self.names]
        found: set[tuple[int, int, int]] = set()
        for t, words in enumerate(self.words):
            at, value = grams(words)
            if len(words.hash) < SHORT:  # a change of any one word leaves other runs
                found |= {(int(v), t, int(p)) for v, p in zip(value, at)}
                continue
            for i in range(max(1, len(value) - WINNOW + 1) if len(value) else 0):
                k = i + int(np.argmin(value[i : i + WINNOW]))
                found.add((int(value[k]), t, int(at[k])))
        rows = sorted(found)
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)

    def hits(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in value, index entry) of all equal hashes."""
        lo = np.searchsorted(self.hash, value, side="left")
        count = np.searchsorted(self.hash, value, side="right") - lo
        who = np.repeat(np.arange(len(value)), count)
        return who, np.repeat(lo, count) + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)


def align(doc: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last + 1) of the longest common subsequence of a template and document words, where word i of
    the template may only meet document words i + shift - band to i + shift + band. First and last are document words; ties prefer the earliest end, then the latest start."""
    width = 2 * band + 1
    # best[k]: (matches, start) for the document up to word i + shift - band + k.
    best = [(0, 0)] * (width + 1)
    end, top = 0, (0, 0)
    for i, want in enumerate(template.tolist()):
        row: list[tuple[int, int]] = [(0, 0)] * (width + 1)
        for k in range(width):
            j = i + shift - band + k
            up = best[k + 1] if k + 1 <= width else (0, 0)
            here = max(up, row[k - 1] if k else (0, 0))
            if 0 <= j < len(doc) and doc[j] == want:
                n, start = best[k]
                here = max(here, (n + 1, start if n else j))
            row[k] = here
            if here[0] > top[0]:
                top, end = here, j + 1
        row[width] = row[width - 1]
        best = row
    return top[0], top[1], end


def matches(texts: pa.Array, index: Index, coverage: float = COVERAGE) -> list[tuple[int, int, int, int, int, int, int]]:
    """(row, template, matched words, words from, to, bytes from, to) of the matches in a slice of texts: for each template from
    left to right, each beginning after the one before; matches of several templates may overlap."""
    words = Words(texts)
    at, value = grams(words)
    who, entry = index.hits(value)
    if not len(who):
        return []
    place, row = at[who], words.row[at[who]]
    base = np.searchsorted(words.row, np.arange(words.rows + 1))
    template, place = index.template[entry], place - base[row]
    shift = place - index.place[entry]
    order = np.lexsort((place, template, row))
    found: list[tuple] = []
    begin = stop = None
    now, over, tried = (-1, -1), 0, None
    for r, t, p, s in zip(row[order].tolist(), template[order].tolist(), place[order].tolist(), shift[order].tolist()):
        if (r, t) != now:
            now, over, tried = (r, t), 0, None
        if p < over or s == tried:
            continue  # inside the match before, or on the diagonal of a candidate that failed
        want = index.words[t].hash
        lo = max(over, s - BAND)
        doc = words.hash[base[r] + lo : min(base[r + 1], base[r] + s + len(want) + BAND)]
        n, first, end = align(doc, want, s - lo)
        tried = s
        if n >= coverage * len(want):
            first, over, tried = first + lo, end + lo, None
            begin, stop = words.places() if begin is None else (begin, stop)
            found.append((r, t, n, first, over, int(begin[base[r] + first]), int(stop[base[r] + over - 1])))
    return sorted(found, key=lambda m: (m[0], m[3], m[1]))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, word_start, word_end, byte_start, byte_end): a row for each match of a template.

    Bytes are of the text in UTF-8 as it is. Null and empty texts match nothing, repeated rows each match, texts of any length are
    scanned whole, and columns beside doc_id and text aren't looked at; an empty table gives an empty table. Of matches of one
    template that overlap, the first stays. The templates are a fixed list, and go to the tasks.
    """
    texts = dict(templates or TEMPLATES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(texts)
        size = np.array([len(w.hash) for w in index.words])
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                rows = matches(batch.column(1).slice(lo, hi - lo), index, coverage)
                if rows:
                    r, t, n, a, b, c, d = (np.array(x, np.int64) for x in zip(*rows))
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(r + lo)), pa.array([index.names[i] for i in t]), pa.array(n / size[t]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(c), pa.array(d)],
                        names=["doc_id", "license", "coverage", "word_start", "word_end", "byte_start", "byte_end"],
                    )

    return reachable(docs).select("doc_id", "text").mapInArrow(scan, "doc_id long, license string, coverage double, word_start int, word_end int, byte_start long, byte_end long")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """All license matches in documents."""
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))

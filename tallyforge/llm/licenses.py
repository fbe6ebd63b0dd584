"""License scans: winnowed fingerprints pick candidates, a banded alignment says what matches.

A template's runs of GRAM words are hashed and of each WINDOW neighbouring hashes the least is kept with its place in an
inverted index; so any GRAM + WINDOW - 1 words in a row that a text shares with a template hit the index. Hits on one diagonal
make a segment, segments in order make a chain, with up to GAP words of other text between two of them, and an alignment
within a band that follows the chain gives the share of the template that is there and where it begins and ends. The index
holds the templates alone, which are few, and goes to every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tallyforge.llm.shared import picked

#: Words in a fingerprint, fingerprints of which the least is kept, words that an alignment may drift, least share of a template.
GRAM, WINDOW, BAND, LEAST = 3, 2, 8, 0.8
#: Words of other text that may stand between two parts of a notice of LONG words or more; in a shorter one, as many as its band.
GAP, LONG = 1000, 40
#: Words are runs of ASCII letters and digits, so a text's places do not shift when its words are put in lower case.
WORDS = re.compile(r"[A-Za-z0-9]+")
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
#: License notices by SPDX identifier and form: sentences, notices and whole short texts, as published. Fixed values. Longer texts
#: (Apache, GPL, MPL) are read from a folder by templates_from().
TEMPLATES = {
    "AGPL-3.0/notice": _GNU.format("Affero General Public License", "3"),
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause/conditions": _BSD.strip(),
    "BSD-2-Clause/text": _BSD + _BSD_END,
    "BSD-3-Clause/text": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "BSL-1.0/text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0/notice": _GNU.format("General Public License", "2"),
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": _GNU.format("General Public License", "3"),
    "ISC/grant": _ISC,
    "ISC/text": _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0/notice": _GNU.format("Lesser General Public License", "3"),
    "MIT/line": "Released under the MIT License.",
    "MIT/grant": _MIT,
    "MIT/text": f"{_MIT} {_WARRANTY}",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib/text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def templates_from(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from a folder of license texts, a file each, named by file. Licenses are few, so they are gathered on the driver."""
    return {r["path"].rsplit("/", 1)[-1]: r["value"] for r in spark.read.text(folder, wholetext=True).selectExpr("_metadata.file_path AS path", "value").collect()}


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in WORDS.findall(text or "")]


def _hash(words: tuple[str, ...]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words))


class Index:
    """Templates as word lists, and their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.templates = {name: words for name, text in templates.items() if (words := words_of(text))}
        self.at: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, words in self.templates.items():
            grams = [tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))]
            kept = {min(range(i, min(i + WINDOW, len(grams))), key=lambda j: (_hash(grams[j]), -j)) for i in range(max(1, len(grams) - WINDOW + 1))}
            for i in sorted(kept):
                self.at.setdefault(grams[i], []).append((name, i))
        self.starts = {g[0] for g in self.at}

    def candidates(self, words: list[str]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
        """(template, chain of segments): where a template may lie in the words."""
        hits: dict[str, list[tuple[int, int]]] = {}
        starts, at = self.starts, self.at
        for i, word in enumerate(words):
            if word in starts:
                for name, j in at.get(tuple(words[i : i + GRAM]), ()):
                    hits.setdefault(name, []).append((i - j, j))
        for name, found in hits.items():
            size = len(self.templates[name])
            for chain in chains(segments(found), band_of(size) if size < LONG else GAP):
                yield name, chain


def band_of(size: int) -> int:
    """Words that an alignment may drift: fewer for a short template, so that two copies in a row are two matches."""
    return min(BAND, max(1, size // 5))


def segments(hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """hits (diagonal, template place) -> runs (diagonal, first, last, hits) of hits on one diagonal with no more than BAND words between."""
    found: list[list[int]] = []
    for d, j in sorted(hits):
        if found and found[-1][0] == d and j - found[-1][2] <= BAND + GRAM:
            found[-1][2:] = [j, found[-1][3] + 1]
        else:
            found.append([d, j, j, 1])
    return [tuple(x) for x in found]


def chains(runs: list[tuple[int, int, int, int]], gap: int) -> list[list[tuple[int, int, int]]]:
    """Chains of segments (diagonal, first, last) that stand in the same order in text and template, with at most gap more words of the
    text between two of them than of the template. The chain with the most hits comes first, of equal ones the shortest, then the
    first in the text; the others are those that do not overlap a chain before them."""
    runs = sorted(runs, key=lambda r: (r[0] + r[1], r[1]))
    longest = max((r[2] for r in runs), default=0) + gap
    best: list[tuple[int, int, int]] = []  # hits, place in the text of the chain's start, run before
    low = 0
    for k, (d, first, last, n) in enumerate(runs):
        start = d + first
        while runs[low][0] + runs[low][2] < start - longest - BAND:
            low += 1
        found = (n, start, -1)
        for m in range(low, k):
            e, _, end, _ = runs[m]
            if end < first and e + end < start and d - e <= gap and (best[m][0] + n, best[m][1]) > found[:2]:
                found = (best[m][0] + n, best[m][1], m)
        best.append(found)
    out, taken = [], []
    for k in sorted(range(len(runs)), key=lambda k: (-best[k][0], runs[k][0] + runs[k][2] - best[k][1], best[k][1])):
        a, b = best[k][1], runs[k][0] + runs[k][2]
        if any(a <= y and x <= b for x, y in taken):
            continue
        taken.append((a, b))
        chain, m = [], k
        while m >= 0:
            chain.append(runs[m][:3])
            m = best[m][2]
        out.append(chain[::-1])
    return out


def align(template: list[str], words: list[str], chain: list[tuple[int, int, int]], band: int = BAND) -> tuple[int, int, int]:
    """(matched, first, last): the most template words that can be matched in order within the band around the chain's diagonals, and
    the places of the first and the last of them; of equal alignments the one that ends first and starts last. Between two
    segments the band covers both diagonals, so words put in between cost only the rows between them."""
    values, begin = [(0, 0, -1)], 0  # by place from begin on: matched, -end, start of the best alignment that ends before it
    at = 0
    for j, word in enumerate(template):
        while at + 1 < len(chain) and j >= chain[at + 1][1]:
            at += 1
        d = chain[at][0]
        other = chain[at + 1][0] if at + 1 < len(chain) and j > chain[at][2] else d
        low, high = max(0, j + min(d, other) - band), min(len(words), j + max(d, other) + band + 1)
        if high <= low:
            continue
        top = begin + len(values) - 1
        left = values[min(low, top) - begin] if low >= begin else (0, 0, -1)
        new = [left]
        for i in range(low, high):
            above = values[min(i + 1, top) - begin] if i + 1 >= begin else (0, 0, -1)
            best = left if left > above else above
            if words[i] == word:
                n, _, start = values[min(i, top) - begin] if i >= begin else (0, 0, -1)
                best = max(best, (n + 1, -i, start if n else i))
            new.append(best)
            left = best
        values, begin = new, low
    n, end, start = max(values)
    return n, start, -end


def matches(text: str | None, index: Index, least: float = LEAST) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) in order of start: end is past the last matched word, in characters. Of
    places that overlap, the one with the most matched words stays, then the best covered, then the first by name."""
    words = words_of(text)
    found: dict[tuple[str, int, int], int] = {}
    for name, chain in index.candidates(words):
        template = index.templates[name]
        n, first, last = align(template, words, chain, band_of(len(template)))
        if n >= least * len(template):
            found[name, first, last] = n
    if not found:
        return []
    kept: dict[tuple[str, int, int], int] = {}
    for (name, first, last), n in sorted(found.items(), key=lambda x: (-x[1], len(index.templates[x[0][0]]), x[0])):
        if all(last < a or b < first for _, a, b in kept):
            kept[name, first, last] = n
    places = [m.span() for m in WORDS.finditer(text)]
    return sorted(((name, n / len(index.templates[name]), n, places[a][0], places[b][1]) for (name, a, b), n in kept.items()), key=lambda x: (x[3], x[4], x[0]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, license, coverage, n_words, start, end): a row for each place in a document where at least `least` of a template's
    words stand in order. Documents without any, and null and empty texts, give no row; repeated documents repeat theirs. Only
    A-Z, a-z and 0-9 make words, so case and marks don't matter, and other letters part words. Very long texts are read whole, a text at
    a time. A notice with other text put in is one match whose span covers that text too. Other columns are not returned."""
    given = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(given)
        for b in batches:
            found = [(b.column(0)[i].as_py(), *m) for i in range(b.num_rows) for m in matches(b.column(1)[i].as_py(), index, least)]
            kinds = (b.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["doc_id", "license", "coverage", "n_words", "start", "end"])

    rows = picked(docs, doc_id=doc_id, text=text)
    made = [("license", StringType()), ("coverage", DoubleType()), ("n_words", LongType()), ("start", LongType()), ("end", LongType())]
    return rows.mapInArrow(run, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *[StructField(n, t) for n, t in made]]))

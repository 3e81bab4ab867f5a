"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

A template is a licence's text.  Texts and templates are lists of words
(lower-cased runs of letters, digits, '.' and '-').  For each window length the
text is cut into windows that overlap by half, so a template of up to half a
window's words (and one) lies whole in some window; window lengths double until
the longest template fits.  Every window has a MinHash
signature over its shingles; each of its values is a band of its own, so a
window that holds a template of share s of their union is retrieved with
probability 1 - (1 - s)^HASHES.  A template of one shingle in the shortest
window has s = 1/6, which gives 0.997; those of 4 words or more have s of a
quarter or more, which gives 0.9999.  Each retrieved pair is verified by exact containment of the template's shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a shingle, hash functions, words of the shortest window.
SHINGLE, HASHES, WINDOW = 3, 32, 8
#: Share of a template's shingles that must be in the window.
LEAST = 0.8
MEMO = 400_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""

#: Public short forms by which works name their licences, and the whole texts of the short licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE],
    "BSD-2-Clause": [f"{_BSD_2} {_BSD_END}"],
    "ISC": [_ISC],
    "Unlicense": [_UNLICENSE],
    "Zlib": [_ZLIB],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", _MIT],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", f"{_BSD_2} {_BSD_3} {_BSD_END}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved."],
}

_WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*").findall


class _Hash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_hash = _Hash()


def shingles(text: str) -> np.ndarray:
    """Hashes of the text's shingles in order (of all its words at once, if they are fewer)."""
    words = _WORDS(text.lower())
    h = np.fromiter(map(_hash.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    k, m = min(SHINGLE, len(h)), np.uint64(0x9E3779B97F4A7C15)
    out = h[: len(h) - k + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = (out ^ (out >> np.uint64(31))) * m + h[i : len(h) - k + 1 + i]
    return out


class Scanner:
    """Templates with their MinHash values, ready to scan texts."""

    def __init__(self, templates: dict[str, list[str]] | None = None, least: float = LEAST):
        self.least = least
        self.items = [(name, k, shingles(t)) for name, texts in (TEMPLATES if templates is None else templates).items() for k, t in enumerate(texts)]
        self.items = [(n, k, np.unique(s)) for n, k, s in self.items if len(s)]
        longest = max((len(_WORDS(t.lower())) for texts in (TEMPLATES if templates is None else templates).values() for t in texts), default=0)
        self.windows = [WINDOW]
        while self.windows[-1] // 2 + 1 < longest:
            self.windows.append(self.windows[-1] * 2)
        random = np.random.default_rng(2024)
        self.a = random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        #: the shingle that is a template's least under a hash function -> those functions and templates
        self.bands: dict[int, list[tuple[int, int]]] = {}
        for item, (_, _, t) in enumerate(self.items):
            for k, a in enumerate(self.a):
                self.bands.setdefault(int(t[np.argmin(self._mix(t, a))]), []).append((k, item))
        self.values = np.array(sorted(self.bands), dtype=np.uint64)

    @staticmethod
    def _mix(s: np.ndarray, a: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = s * a
            return (x ^ (x >> np.uint64(32))) * a

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """(licence, containment, word place) for every licence found, by name; its best template's first best window."""
        s = shingles(text or "")
        if not len(s) or not self.items:
            return []
        # A window's band hits where its least shingle is a template's: only windows around such shingles need be looked at.
        near = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        tried: set[tuple[int, int, int]] = set()
        for at in np.flatnonzero(self.values[near] == s).tolist():
            for size in self.windows:
                span, step = size - SHINGLE + 1, size // 2
                for w in range(max(0, (at - span) // step + 1), at // step + 1):
                    lo, hi = w * step, min(len(s), w * step + span)
                    for k, item in self.bands[int(s[at])]:
                        if (item, lo, hi) not in tried and self._mix(s[lo:hi], self.a[k]).min() == self._mix(s[at : at + 1], self.a[k])[0]:
                            tried.add((item, lo, hi))
        best: dict[str, tuple[float, int]] = {}
        for item, lo, hi in sorted(tried):
            name, _, t = self.items[item]
            here = np.isin(s[lo:hi], t)
            share = len(np.unique(s[lo:hi][here])) / len(t)
            if share >= self.least:
                at = lo + int(np.argmax(here))
                if name not in best or (-share, at) < (-best[name][0], best[name][1]):
                    best[name] = (share, at)
        return [(name, share, at) for name, (share, at) in sorted(best.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, license, containment, word_at), a row for each licence that a whole text names.

    Texts without a match, null and empty texts give no row.  Repeated rows give
    repeated results.  Of a licence's templates and windows the best containment
    counts, then the earliest place.  A template with fewer words than a shingle
    is one shingle of its own and matches only a text of just those words.
    Extra columns are ignored.  Templates are a parameter, broadcast with the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, least))

    kinds = [("license", pa.string()), ("containment", pa.float64()), ("word_at", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            hits = [(i, *hit) for i, x in enumerate(batch["text"]) for hit in scanner.scan(x.as_py())]
            ids = batch["doc_id"].take(pa.array([h[0] for h in hits], pa.int64()))
            columns = [pa.array([h[k] for h in hits], kind) for k, (_, kind) in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *(name for name, _ in kinds)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, containment double, word_at long")

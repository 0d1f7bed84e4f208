"""License scan: Dice coefficient over word bigrams against licence templates.

Both sides are normalised to lower-case words of ASCII letters and digits.  A
text is compared whole, by paragraph (split at blank lines) and by line, so
that both a licence file and a notice inside a document are found.  With a and
b distinct bigrams the coefficient 2 * common / (a + b) cannot exceed
2 * min(a, b) / (a + b); templates whose size is outside
[a * t / (2 - t), a * (2 - t) / t] are pruned before any bigram is compared.
Segments with too few words for any template are never split into bigrams.

Notices that are no segment of their own (wrapped over lines, of several
paragraphs in a longer text, inside a line of prose) are found by windows of
consecutive words: those with the highest coefficient, of any length and at any
place, that reach the threshold.  A window that meets a matching segment or a better window,
or lies in a much longer window that matches, is part of it and does not count.
Texts are searched for windows only where they hold as many of a template's
bigrams as a match needs, anywhere.

* null and empty texts match nothing; a segment of one word has no bigram and
  matches nothing; lines may end with CR LF; very long texts are searched whole;
* repeated rows are searched each;
* of templates with equal score the one first in order of its name is best;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from .shared import arrow_scan
from .tokens import as_bytes, chunks, mix, word_hashes

THRESHOLD = 0.8

# Short notices and short licences as published.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT-notice", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if (48 <= c <= 57 or 97 <= c <= 122) else 32 for c in range(256)
)


def words_of(text: str | bytes) -> list[bytes]:
    return (as_bytes(text) if isinstance(text, str) else text).translate(_WORDS).split()


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


def segments(text: str):
    """The whole text, its paragraphs and its lines, each once, with the number
    of the piece's kind."""
    yield 0, text
    text = text.replace("\r\n", "\n")
    paragraphs = text.split("\n\n")
    if len(paragraphs) > 1:
        yield from ((1, x) for x in paragraphs)
    lines = text.split("\n")
    if len(lines) > 1:
        yield from ((2, x) for x in lines if x)


def bigram_hashes(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


class Licences:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = sorted((name, bigrams(words_of(text))) for name, text in templates)
        reach = (2 - threshold) / threshold
        self.bounds = [(name, grams, len(grams) / reach, len(grams) * reach) for name, grams in self.templates]
        self.lowest = min(b[2] for b in self.bounds)
        self.highest = max(b[3] for b in self.bounds)

        hashed = [bigram_hashes(word_hashes([text], _WORDS)[0]) for _, text in sorted(templates)]
        self.hashes = np.unique(np.concatenate(hashed))
        self.holds = np.array([np.isin(self.hashes, h) for h in hashed]).T.astype(np.int32)
        self.hashed = [set(h.tolist()) for h in hashed]
        self.needed = np.array([low for _, _, low, _ in self.bounds]) * (1 - 1e-9)
        self.low_bits = np.zeros(1 << 16, bool)
        self.low_bits[self.hashes & np.uint64(0xFFFF)] = True

    def best(self, text: str | None) -> list[tuple[str, float, int]]:
        """(licence, best Dice, matches) of a text, best first."""
        return self.best_of([text])[0]

    def best_of(self, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
        out = []
        for part in chunks(texts):
            for text, (grams, candidates) in zip(texts[part], self._candidates(texts[part])):
                found, covered = self._segments(text or "")
                for name, score in self._windows(grams, candidates, covered) if len(candidates) else ():
                    seen = found.setdefault(name, [0.0, 0])
                    seen[0], seen[1] = max(seen[0], score), seen[1] + 1
                out.append(sorted(((n, s, k) for n, (s, k) in found.items()), key=lambda x: (-x[1], x[0])))
        return out

    def _segments(self, text: str) -> tuple[dict[str, list], list[tuple[int, int]]]:
        """({licence: [best Dice, matching segments]}, their ranges of words)."""
        out: dict[str, list] = {}
        covered, at = [], [0, 0, 0]
        for kind, segment in segments(text):
            words = words_of(segment)
            begin = at[kind]
            at[kind] += len(words)
            if len(words) - 1 < self.lowest:
                continue
            grams = bigrams(words)
            if len(grams) > self.highest:
                continue
            for name, template, low, high in self.bounds:
                if low <= len(grams) <= high:
                    score = 2 * len(grams & template) / (len(grams) + len(template))
                    if score >= self.threshold:
                        seen = out.setdefault(name, [0.0, 0])
                        seen[0], seen[1] = max(seen[0], score), seen[1] + 1
                        covered.append((begin, at[kind]))
        return out, covered

    def _candidates(self, texts: list[str | None]):
        """(bigram hashes, templates of which there are enough) of each text."""
        words, offsets = word_hashes(texts, _WORDS)
        grams = bigram_hashes(words) if len(words) else words
        near = np.flatnonzero(self.low_bits[grams & np.uint64(0xFFFF)])
        place = np.minimum(np.searchsorted(self.hashes, grams[near]), len(self.hashes) - 1)
        same = self.hashes[place] == grams[near]
        near, place = near[same], place[same]
        doc = np.searchsorted(offsets, near, "right") - 1
        inside = near + 1 < offsets[doc + 1]
        pairs = np.unique(doc[inside] * len(self.hashes) + place[inside])
        counts = np.zeros((len(texts), len(self.templates)), np.int32)
        np.add.at(counts, pairs // len(self.hashes), self.holds[pairs % len(self.hashes)])
        enough = counts >= self.needed
        for i in range(len(texts)):
            yield grams[offsets[i] : max(offsets[i], offsets[i + 1] - 1)], np.flatnonzero(enough[i])

    def _windows(self, grams: np.ndarray, candidates: np.ndarray, covered: list[tuple[int, int]]) -> list[tuple[str, float]]:
        """(licence, Dice) of the windows that match and are not part of another match."""
        grams = grams.tolist()
        after, last = [0] * len(grams), {}
        for i in range(len(grams) - 1, -1, -1):
            after[i] = last.get(grams[i], len(grams))
            last[grams[i]] = i
        chosen = []
        for t in candidates:
            template, size, high = self.hashed[t], len(self.templates[t][1]), self.bounds[t][3]
            scored = []
            for i in (i for i, g in enumerate(grams) if g in template):
                # the best window begins and ends with the template's bigrams, and does not repeat its first
                seen, common, best = set(), 0, (0.0, 0)
                for j in range(i, after[i]):
                    if grams[j] in seen:
                        continue
                    seen.add(grams[j])
                    if len(seen) > high:
                        break
                    if grams[j] in template:
                        common += 1
                        best = max(best, (2 * common / (len(seen) + size), -j))
                if best[0] >= self.threshold:
                    scored.append((-best[0], i, 2 - best[1]))
            taken = Taken(covered)
            for score, begin, end in sorted(scored):
                if taken.add(begin, end):
                    chosen.append((t, -score, begin, end))
        # windows of a template are apart, so one that holds another begins last before it
        by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, _, begin, end in chosen:
            by_template[t].append((begin, end))
        for own in by_template.values():
            own.sort()

        def inside_longer(begin: int, end: int) -> bool:
            for own in by_template.values():
                at = bisect_right(own, (begin, len(grams) + 2)) - 1
                if at >= 0 and end <= own[at][1] and own[at][1] - own[at][0] > 1.5 * (end - begin):
                    return True
            return False

        whole = [(-score, begin - end, t, begin, end) for t, score, begin, end in chosen if not inside_longer(begin, end)]
        out, taken = [], Taken([])
        for minus, _, t, begin, end in sorted(whole):
            if taken.add(begin, end):
                out.append((self.templates[t][0], -minus))
        return out


class Taken:
    """Ranges that are apart, sorted; those given at the start may overlap."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for begin, end in sorted(ranges):
            if self.ends and begin < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            elif begin < end:
                self.begins.append(begin)
                self.ends.append(end)

    def add(self, begin: int, end: int) -> bool:
        """Take a range that meets none that is taken; else false."""
        at = bisect_right(self.ends, begin)  # the first that ends behind the new one's begin
        if at < len(self.begins) and self.begins[at] < end:
            return False
        self.begins.insert(at, begin)
        self.ends.insert(at, end)
        return True


def find_licences(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (best, or null), dice (its score, 0 if none), licenses
    (all, sorted by name, comma-joined), n_segments (matches of all, segments and
    windows) per row."""
    licences = Licences(templates, threshold)

    def step(c):
        found = licences.best_of(c["text"])
        return {
            "doc_id": c["doc_id"],
            "license": [f[0][0] if f else None for f in found],
            "dice": [f[0][1] if f else 0.0 for f in found],
            "licenses": [",".join(sorted(n for n, _, _ in f)) for f in found],
            "n_segments": [sum(k for _, _, k in f) for f in found],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_scan(
        docs.select("doc_id", "text"),
        step,
        f"doc_id {kind}, license string, dice double, licenses string, n_segments long",
    )

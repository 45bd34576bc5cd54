"""Licence scan with a generalised suffix automaton of licence tokens.

One automaton holds every template (full texts, notices, and the three plain phrases that the base
result counts). A file is streamed through it word by word, which gives its matching statistics: the
automaton state and the length of the longest template substring that ends at each word. A match that
can't be extended and is long enough is placed on its template; matches of one template that go
forward in both text and template, with a bounded gap in the text, are chained into covered spans, one for
each copy of the template. A template of which a chain covers enough labels the file.

The automaton is built on the driver from the templates alone, some thousand tokens, and sent along
with the function; it does not grow with the data. Files are handled one by one in a map without a
shuffle, in time linear in their words.

Null and empty texts have no words, no places and no labels, and a score of 0; a null id stays null;
repeated rows are scanned each on its own; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import alnum_words, column_bytes, fields, map_arrow

#: Phrases whose every place counts, with their labels. Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices and licence texts, with their labels. Public licence wording.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "SPDX-License-Identifier: MIT"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "licensed under the GNU General Public License, version 2"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
)

#: Shortest match that may start or extend a chain, in words (or the whole template, if that is shorter).
MIN_MATCH = 4
#: Words of text that a chain may skip between two matches.
MAX_GAP = 12
#: Share of a template that its chain must cover for the label.
COVERAGE = 0.75


class Automaton:
    """Generalised suffix automaton over word ids, with the template places of each state."""

    def __init__(self, texts: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        at: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(texts):
            last = 0
            for end, w in enumerate(words, 1):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)), at)
                at[last].add((k, end))
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            at[self.link[v]] |= at[v]
        at[0] = set()
        self.places = [sorted(x) for x in at]

    def _state(self, length: int, follow: dict[int, int], link: int, at: list) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        at.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int, at: list) -> int:
        """The state for the strings of q up to length(p) + 1, taken out of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], at)
        self.link[q] = part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, c: int, at: list) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c], at)
        new = self._state(self.length[last] + 1, {}, 0, at)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c], at)
        return new

    def walk(self, ids: list[int]) -> int:
        v = 0
        for c in ids:
            v = self.next[v][c]
        return v


class Scanner:
    """The automaton of all phrases and templates, ready to stream files."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(label, alnum_words(p.encode())) for p, label in phrases]
        self.templates = [(label, alnum_words(t.encode())) for label, t in templates]
        self.sam = a = Automaton([w for _, w in self.phrases + self.templates])
        ends: dict[int, list[int]] = {}
        for k, (_, words) in enumerate(self.phrases):
            ends.setdefault(a.walk([a.ids[w] for w in words]), []).append(k)
        #: Phrases that are suffixes of a state's strings, with their lengths.
        self.suffixes: list[tuple[tuple[int, int], ...]] = []
        for v in range(len(a.next)):
            found, u = [], v
            while u > 0:
                found += [(k, len(self.phrases[k][1])) for k in ends.get(u, ())]
                u = a.link[u]
            self.suffixes.append(tuple(found))

    def scan(self, words: list[bytes]):
        """Places (phrase number, start) and covered template spans (template number, start, end, share)."""
        a = self.sam
        follow, link, length, suffixes = a.next, a.link, a.length, self.suffixes
        places, matches = [], []
        v = n = 0
        for i, c in enumerate(map(a.ids.get, words)):
            if c is None:
                if n >= 2:
                    matches.append((i, n, v))
                v = n = 0
                continue
            if c not in follow[v]:
                if n >= 2:
                    matches.append((i, n, v))
                while v and c not in follow[v]:
                    v = link[v]
                    n = length[v]
            u = follow[v].get(c)
            if u is not None:
                v = u
                n += 1
                for k, m in suffixes[v]:
                    if n >= m:
                        places.append((k, i - m + 1))
            else:
                v = n = 0
        if n >= 2:
            matches.append((len(words), n, v))
        return places, self._chains(matches)

    def _chains(self, matches: list[tuple[int, int, int]]):
        """Covered spans (template, start, end, share) of all copies of templates, and the largest share of all chains.

        Each place of a match on a template goes on from the open chain that covers most with it, or begins one. Of
        chains of one template that overlap in the text the one of the larger share counts."""
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # template: text start, text end, template end, words covered
        done: dict[int, list[tuple[float, int, int]]] = {}
        first = len(self.phrases)

        def close(k: int, chains) -> None:
            size = len(self.templates[k][1])
            done.setdefault(k, []).extend((min(1.0, covered / size), start, stop) for start, stop, _, covered in chains)

        for end, n, v in matches:
            start = end - n
            for k, at in self.sam.places[v]:
                k -= first
                if k < 0 or n < min(MIN_MATCH, len(self.templates[k][1])):
                    continue
                held = open_.get(k, [])
                near = [c for c in held if start - c[1] <= MAX_GAP]
                if len(near) < len(held):
                    close(k, [c for c in held if start - c[1] > MAX_GAP])
                # a word of the text counts once: what a chain has covered of this match is not new
                further = [(c[3] + min(n, at - c[2], end - c[1]), c) for c in near if at > c[2] and end > c[1]]
                covered, chain = max(further, default=(0, None))
                new = (chain[0], end, at, covered) if chain is not None and covered > n else (start, end, at, n)
                open_[k] = [c for c in near if c != chain or new[0] != c[0]] + [new]
        for k, chains in open_.items():
            close(k, chains)
        out = []
        for k, chains in sorted(done.items()):
            taken = _Taken()
            for share, start, stop in sorted(chains, key=lambda c: (-c[0], c[1], c[2])):
                if share >= COVERAGE and taken.add(start, stop):
                    out.append((k, start, stop, share))
        return sorted(out, key=lambda c: c[:3]), max((c[0] for chains in done.values() for c in chains), default=0.0)


class _Taken:
    """Spans that don't overlap, in order."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, start: int, end: int) -> bool:
        """Whether a span is free; if so, it is taken."""
        k = bisect_left(self.starts, end)
        if k and self.ends[k - 1] > start:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())])
COVER = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())]
)


def licence_scan(df: DataFrame, keys: list[str], text: str = "text", templates=TEMPLATES) -> DataFrame:
    """The key columns, n_words, ``places`` of the phrases, ``covers`` (all chained template spans) and ``best_share``.

    templates: (label, text) of each; whole licence texts can be added to those given here."""
    scanner = Scanner(templates=templates)
    schema = T.StructType(
        [
            *fields(df, keys),
            T.StructField("n_words", T.LongType()),
            T.StructField("places", T.ArrayType(PLACE)),
            T.StructField("covers", T.ArrayType(COVER)),
            T.StructField("best_share", T.DoubleType()),
        ]
    )

    def run(batch: pa.RecordBatch):
        sizes, places, covers, shares = [], [], [], []
        for t in column_bytes(batch.column(len(keys))):
            words = alnum_words(t)
            found, (spans, share) = scanner.scan(words)
            sizes.append(len(words))
            places.append([{"label": scanner.phrases[k][0], "start": s} for k, s in found])
            covers.append([{"label": scanner.templates[k][0], "start": s, "end": e, "share": x} for k, s, e, x in spans])
            shares.append(share)
        return [*(batch.column(k) for k in range(len(keys))), sizes, places, covers, shares]

    return map_arrow(df.select(*keys, F.col(text).cast("string").alias("_text")), run, schema)

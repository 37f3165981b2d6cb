"""Licence scans by patience alignment.

Words of a template that few texts use are looked up in whole texts by hash; around them lie the windows that may hold the
template. In a window, words that occur once in it and once in the template are anchors; the longest increasing run of
anchors is kept, and the gaps between them are aligned in the same way, words at the gaps' ends by equality. The matched
share of the template is the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from envspark.llm.common import LOWER, chunks, span_hashes, utf8

#: Public licence texts and notices, by name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}
COVERAGE = 0.75

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words(text: str) -> list[str]:
    """Runs of ASCII letters (lowered), digits and non-ASCII characters."""
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def key_words(template: list[str], coverage: float) -> set[str]:
    """The template's longest words, as many as make up more of it than a text that covers it may lack: such a text has one of them."""
    count, keys, have = Counter(template), set(), 0
    for w in sorted(count, key=lambda w: (-len(w), w)):
        if have > (1 - coverage) * len(template):
            break
        keys.add(w)
        have += count[w]
    return keys


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: increasing pairs of places of equal words."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: x for x, w in enumerate(b[k:m], k) if once_b[w] == 1}
        anchors = [(x, place[w]) for x, w in enumerate(a[i:j], i) if once_a[w] == 1 and w in place]
        tops: list[int] = []
        last: list[int] = []
        back = [-1] * len(anchors)
        for n, (_, y) in enumerate(anchors):
            at = bisect_left(tops, y)
            tops[at : at + 1] = [y]
            last[at : at + 1] = [n]
            back[n] = last[at - 1] if at else -1
        chain, n = [], last[-1] if last else -1
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        if not chain:
            continue
        chain.reverse()
        out += chain
        for (x, y), (x2, y2) in zip([(i - 1, k - 1), *chain], [*chain, (j, m)]):
            stack.append((x + 1, x2, y + 1, y2))
    return sorted(out)


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched_words, first_word, last_word): the best window of each document and template that it holds.

    coverage is the matched share of the template's words; the matched part of the text must be no longer than twice the
    template. Places count the text's words. Of windows that cover alike the first one counts. Null and empty texts hold
    nothing; repeated rows are scanned each; whole texts are read, and a text with many windows takes time in proportion.
    """
    known = {name: words(text) for name, text in templates.items()}
    known = {name: w for name, w in known.items() if w}
    keys_of = {name: key_words(w, coverage) for name, w in known.items()}
    all_keys = sorted(set().union(*keys_of.values()))
    at_of = {name: {k: [t for t, w in enumerate(template) if w == k] for k in keys_of[name]} for name, template in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = [w.encode() for w in all_keys]
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        end = np.cumsum([len(w) for w in encoded])
        keys = np.sort(span_hashes(raw, end - [len(w) for w in encoded], end))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in chunks(offsets):
                low = LOWER[data[offsets[a] : offsets[b]]]
                part = offsets[a : b + 1] - offsets[a]
                inside = np.r_[_ALNUM[low], False]
                edge = np.zeros(len(inside), dtype=bool)
                edge[part] = True
                before = np.r_[False, inside[:-1]]
                starts, ends = np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
                first = np.searchsorted(starts, part)
                hashes = span_hashes(low, starts, ends)
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hits = np.flatnonzero(keys[at] == hashes)
                owner = np.searchsorted(first, hits, side="right") - 1
                best: dict[tuple[int, str], tuple] = {}
                for row in np.unique(owner):
                    places = hits[owner == row]
                    text = [low[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in range(first[row], first[row + 1])] if len(places) else []
                    for name, template in known.items():
                        own = set(template)
                        size = len(template)
                        windows: list[list[int]] = []
                        for p in places - first[row]:
                            if text[p] in keys_of[name]:
                                x, y = max(0, int(p) - size - 4), min(len(text), int(p) + size + 4)
                                if windows and x <= windows[-1][0] + size // 2:
                                    windows[-1][1] = y
                                else:
                                    windows.append([x, y])
                        for x, y in windows:
                            if sum(w in own for w in text[x:y]) < coverage * size:
                                continue
                            # where a key word stands more often than in the template, every copy is aligned by itself: no word of two copies is an anchor
                            some = Counter(w for w in text[x:y] if w in keys_of[name])
                            parts = {(x, y)}
                            if any(n > len(at_of[name][w]) for w, n in some.items()):
                                slack = size // 4 + 4
                                parts |= {(max(x, p - t - slack), min(y, p - t + size + slack)) for p in range(x, y) if text[p] in keys_of[name] for t in at_of[name][text[p]]}
                            for u, v in sorted(parts):
                                pairs = align(text[u:v], template)
                                if len(pairs) >= coverage * size and pairs[-1][0] - pairs[0][0] < 2 * size:
                                    found = (len(pairs), -(u + pairs[0][0]), u + pairs[-1][0])
                                    best[row, name] = max(best.get((row, name), found), found)
                rows = sorted(best.items())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [ids[a + r] for (r, _), _ in rows], "license": [n for (_, n), _ in rows], "coverage": [v[0] / len(known[n]) for (_, n), v in rows], "matched_words": [v[0] for _, v in rows], "first_word": [-v[1] for _, v in rows], "last_word": [v[2] for _, v in rows]},
                    schema=pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]),
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, matched_words long, first_word long, last_word long")

"""Licence scans: Dice coefficient of word bigrams between text and licence templates."""

from __future__ import annotations

from collections import Counter
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import PLAIN, joined_bytes, load, on_text_batches, plain_words
from quarry.llm.rolling import Stretches, word_values

LEAST = 0.8

MATCHES = "array<struct<license:string,dice:double,unit:string,start_line:int,end_line:int>>"

# Notices and grants as their publishers word them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def full_texts() -> list[tuple[str, str]]:
    """The licences whose full texts stand in the folder ``texts`` beside this module, by file name."""
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(resources.files(__package__).joinpath("texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]


def bigrams(words: list[bytes]) -> Counter:
    """How often each pair of neighbouring words occurs; a single word pairs with nothing."""
    return Counter(zip(words, [*words[1:], b""])) if len(words) == 1 else Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """Twice what two bags share, by their sizes together."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    """Templates in order of size, and the hashes of all their bigrams."""

    def __init__(self, texts: list[tuple[str, str]], least: float):
        self.least = least
        rows = sorted(((sum(b.values()), name, b) for name, b in ((n, bigrams(plain_words(t))) for n, t in texts) if b), key=lambda r: (r[0], r[1]))
        self.sizes = np.array([r[0] for r in rows], np.int64)
        self.names, self.bags = [r[1] for r in rows], [r[2] for r in rows]
        pairs = sorted({p for b in self.bags for p in b if p[1]})
        data = b" ".join(x for p in pairs for x in p)
        values = word_values(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] if pairs else np.zeros(0, np.uint64)
        self.hashes, at = np.unique(Stretches(values).all_of(2)[::2], return_inverse=True) if pairs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.filter = np.zeros(1 << 18, bool)
        self.filter[(self.hashes >> np.uint64(46)).astype(np.int64)] = True
        #: How often each template has each bigram; the last column is for bigrams of none.
        number = dict(zip(pairs, at.tolist()))
        self.counts = np.zeros((len(rows), len(self.hashes) + 1), np.int32)
        for i, bag in enumerate(self.bags):
            for pair, n in bag.items():
                if pair[1]:
                    self.counts[i, number[pair]] = n
        #: A bag with this share of a template's size, or its inverse, is the smallest or largest that can reach ``least``.
        self.ratio = least / (2 - least)
        #: So many bigrams at least a window must share with each template, and so many at most it has.
        self.need = np.ceil(self.sizes * self.ratio - 1e-9).astype(np.int64)
        self.widest = np.floor(self.sizes / self.ratio + 1e-9).astype(np.int64)

    def known(self, pairs: np.ndarray) -> np.ndarray:
        out = self.filter[(pairs >> np.uint64(46)).astype(np.int64)]
        some = np.flatnonzero(out)
        out[some] = np.isin(pairs[some], self.hashes)
        return out

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        """The column of ``counts`` of each bigram."""
        at = np.minimum(np.searchsorted(self.hashes, pairs), len(self.hashes) - 1)
        return np.where(self.hashes[at] == pairs, at, len(self.hashes))

    def best(self, words: list[bytes]) -> tuple[str, float] | None:
        """The template of the largest coefficient (ties: the smaller, then by name), among those of possible size."""
        bag = bigrams(words)
        size = bag.total()
        lo, hi = np.searchsorted(self.sizes, [np.ceil(size * self.ratio - 1e-9), np.floor(size / self.ratio + 1e-9) + 1])
        found = max(((dice(bag, self.bags[i]), -i) for i in range(lo, hi)), default=(0.0, 0))
        return (self.names[-found[1]], found[0]) if found[0] >= self.least else None


def units(at_line: np.ndarray, line_words: np.ndarray) -> list[tuple[str, int, int]]:
    """Lines, paragraphs (lines between lines without words) and the whole, as (kind, first line, last line) of one text; each stretch once."""
    full = np.flatnonzero(line_words > 0)
    if not len(full):
        return []
    out = [("line", int(i), int(i)) for i in full]
    breaks = np.flatnonzero(np.diff(full) > 1)
    starts, ends = full[np.r_[0, breaks + 1]], full[np.r_[breaks, len(full) - 1]]
    out += [("paragraph", int(a), int(b)) for a, b in zip(starts, ends) if a < b]
    if len(starts) > 1:
        out.append(("text", int(full[0]), int(full[-1])))
    return out


def best_windows(ids: np.ndarray, templates: Templates, t: int) -> list[tuple[float, int, int, int]]:
    """Windows of the bigrams ``ids`` that reach the threshold for template t, as (-margin, t, first bigram, last bigram).

    A window's margin is twice what it shares with the template less ``least`` times both sizes: 0 or more
    is a coefficient of ``least`` or more. Each start gives the window of the largest margin (ties: the
    shortest), unless one more bigram in front raises the margin.
    """
    count = templates.counts[t][ids]
    member = count > 0
    n, widest, size = len(ids), int(templates.widest[t]), int(templates.sizes[t])
    upto = np.r_[0, np.cumsum(member)]
    starts = np.flatnonzero(member & (upto[np.minimum(np.arange(n) + widest, n)] - upto[:n] >= templates.need[t]))
    if not len(starts):
        return []
    # a bigram counts in a window if its count-th equal one before lies outside; with it in front, if that behind does
    order = np.argsort(ids, kind="stable")
    ranked, place = ids[order], np.arange(n)
    low, high = np.searchsorted(ranked, ranked), np.searchsorted(ranked, ranked, side="right")
    back, ahead = place - count[order], place + count[order]
    earlier, later = np.empty(n, np.int64), np.empty(n, np.int64)
    earlier[order] = np.where(back >= low, order[np.maximum(back, 0)], -1)
    later[order] = np.where(ahead < high, order[np.minimum(ahead, n - 1)], n + widest)
    front = starts - 1
    starts = starts[~((front >= 0) & member[front] & (later[front] >= starts + widest))]
    out = []
    for i in starts.tolist():
        share = np.cumsum(member[i : i + widest] & (earlier[i : i + widest] < i))
        margin = 2 * share - templates.least * (size + np.arange(1, len(share) + 1))
        j = int(margin.argmax())
        if margin[j] >= -1e-9 and not (i and member[i - 1] and later[i - 1] > i + j):
            out.append((-round(float(margin[j]), 6), t, i, i + j))
    return out


def windows(ids: np.ndarray, templates: Templates, possible: list[int]) -> list[tuple[int, int, int]]:
    """Disjoint stretches of a text's words that match templates, as (template, first word, word after the last).

    Windows are taken by margin (ties: the smaller template, the earlier start) where no word is taken
    yet; what lies between them is searched again until nothing is found.
    """
    found, parts = [], [(0, len(ids))]
    while parts:
        part, rest = parts.pop(), []
        a, b = part
        taken = np.zeros(b - a + 1, bool)
        for _, t, i, j in sorted(c for t in possible for c in best_windows(ids[a:b], templates, t)):
            if not taken[i : j + 2].any():
                taken[i : j + 2] = True
                rest.append((i, j))
                found.append((t, a + i, a + j + 2))
        if rest:
            rest.sort()
            gaps = zip([a, *(a + j + 2 for _, j in rest)], [*(a + i - 1 for i, _ in rest), b])
            parts += [(lo, hi) for lo, hi in gaps if hi > lo]
    return sorted(found, key=lambda f: f[1:])


def scan(texts: pa.Array, templates: Templates) -> list[list[dict]]:
    """Matches of each text: units, and windows of its words that no matching unit stands for. Only those that could reach the threshold are compared word by word.

    A unit or window shares with a template at most its bigrams that are in any template, so it can
    reach the threshold only if these are enough.
    """
    data, offsets = joined_bytes(texts)
    plain = PLAIN[data]
    values, starts, ends, at = word_values(plain, offsets)
    n = len(values)
    known = np.zeros(n + 1, np.int64)
    if n > 1:
        np.cumsum(np.append(templates.known(Stretches(values).all_of(2)), False), out=known[1:])
    breaks = np.flatnonzero(data == 10)
    pairs_all = Stretches(values).all_of(2) if n > 1 else np.zeros(0, np.uint64)
    possible = [[] for _ in range(len(texts))]
    for t, (need, widest) in enumerate(zip(templates.need, templates.widest)):
        # a window that starts with each word has enough bigrams of any template
        some = np.flatnonzero(known[np.minimum(np.arange(n) + widest, n)] - known[:n] >= need) if len(templates.hashes) else []
        for d in np.unique(np.searchsorted(at, some, side="right") - 1):
            possible[d].append(t)
    out = []
    for d in range(len(texts)):
        lines = np.r_[offsets[d], breaks[np.searchsorted(breaks, offsets[d]) : np.searchsorted(breaks, offsets[d + 1])] + 1, offsets[d + 1]]
        first = np.clip(np.searchsorted(starts, lines), at[d], at[d + 1])
        found, having = [], []
        for kind, a, b in units(lines, np.diff(first)):
            lo, hi = int(first[a]), int(first[b + 1])
            pairs = max(1, hi - lo - 1)
            if hi - lo == 1 or known[hi - 1] - known[lo] >= templates.ratio * pairs - 1e-9:
                words = plain[lines[a] : lines[b + 1]].tobytes().split()
                best = templates.best(words)
                if best:
                    found.append({"license": best[0], "dice": round(best[1], 6), "unit": kind, "start_line": a, "end_line": b})
                    having.append((lo, hi, best[0]))
        first_word = int(at[d])
        for t, lo, hi in windows(templates.numbers(pairs_all[first_word : at[d + 1] - 1]), templates, possible[d]) if possible[d] else []:
            lo, hi, name = lo + first_word, hi + first_word, templates.names[t]
            overlap = [(min(b, hi) - max(a, lo), b - a, of) for a, b, of in having]
            if any(2 * both > hi - lo and (of == name or 2 * both > size) for both, size, of in overlap):
                continue
            value = dice(bigrams(plain[starts[lo] : ends[hi - 1]].tobytes().split()), templates.bags[t])
            if value >= templates.least:
                a, b = (int(np.searchsorted(lines, starts[w], side="right")) - 1 for w in (lo, hi - 1))
                found.append({"license": name, "dice": round(value, 6), "unit": "stretch", "start_line": a, "end_line": b})
        out.append(found)
    return out


def licenses(documents: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST, result: str = "licenses") -> DataFrame:
    """``documents`` with an array column ``result``: the lines, paragraphs, whole texts and stretches of words that match a licence template.

    Texts are cut into words without case and punctuation; a unit matches the template of
    the largest Dice coefficient over bags of word bigrams, if it is ``least`` or more. Only
    templates of a size that can reach it are compared. A notice of several paragraphs, or
    within a line of other words, or next to another licence, is found as a stretch: of all windows
    of a text's words, disjoint ones are taken by how far they pass the threshold. A stretch is left out
    if a matching unit of the same licence has over half of its words, or any unit that is over half in it.
    Null and empty texts and an empty table match nothing; a very long text is one row's work, whole.
    Rows are scanned one by one, so repeated rows and null ids need no rule. A column already
    named ``result`` is replaced. Templates are a parameter that goes to all tasks; without it
    they are the notices and grants above and the full texts.
    """
    index = Templates(TEMPLATES + full_texts() if templates is None else templates, least)
    return documents.withColumn(result, on_text_batches(lambda texts: scan(texts, index), MATCHES)(F.col("text").cast("string")))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    found = licenses(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_sort(F.array_distinct("licenses.license")).alias("names"), "licenses")

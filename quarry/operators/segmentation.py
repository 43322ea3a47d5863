"""Segmentation of runs of ideographs: a trie of known words, and the best path over unigram weights.

Weights are logarithms of shares, as whole numbers, so that sums are exact. Of all ways to cut a run
into known words and single characters the one with the greatest sum is taken; of equal ones that
whose first words are longest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.sources.tables import written

#: Bounds of a dictionary: its words, and their characters.
MOST, LONGEST = 100_000, 8
#: A weight's unit.
UNIT = 1 << 20
NONE = np.int64(-(1 << 60))
#: Characters of runs that are worked on together.
TOGETHER = 1 << 18
IDEOGRAPHS = re.compile("[一-鿿]+")


class Segmenter:
    """Words with counts as a trie in arrays; ``total`` is the count of all words, also of those that are not given."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = max(total or 0, sum(counts.values()), 1)
        self.unknown = self.weight(1, 2 * total)  # a character that is no word
        self.longest = max(map(len, counts), default=1)
        nodes, edges, ends = 1, {}, {}
        for word, n in counts.items():
            node = 0
            for c in word:
                key = node << 21 | ord(c)
                if key not in edges:
                    edges[key], nodes = nodes, nodes + 1
                node = edges[key]
            ends[node] = self.weight(n, total)
        keys = np.fromiter(edges, np.int64, len(edges))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.to, self.probes = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int32), 0
        left = np.arange(len(keys))
        while len(left):  # an edge takes the first of its places that is free
            place = self.place(keys[left], self.probes)
            free = self.keys[place] == -1
            place, at = np.unique(place[free], return_index=True)
            taken = left[free][at]
            self.keys[place], self.to[place] = keys[taken], taken + 1  # nodes are numbered as their edges were made
            left, self.probes = left[~np.isin(left, taken)], self.probes + 1
        self.of_node = np.full(nodes, NONE)
        self.of_node[list(ends)] = list(ends.values())

    @staticmethod
    def weight(n: int, total: int) -> int:
        return round(np.log(n / total) * UNIT)

    def place(self, key: np.ndarray, probe: int) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def follow(self, key: np.ndarray) -> np.ndarray:
        """The node at the end of each edge; 0 where there is none."""
        node, left = np.zeros(len(key), np.int64), np.arange(len(key))
        for probe in range(self.probes):
            place = self.place(key[left], probe)
            held = self.keys[place]
            found = held == key[left]
            node[left[found]] = self.to[place[found]]
            left = left[~found & (held != -1)]
            if not len(left):
                break
        return node

    def weights(self, points: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each place and length the weight of the word there; ``left`` is how many characters its run has from it on."""
        out = np.full((len(points), self.longest), NONE)
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for n in range(self.longest):
            inside = left[at] > n
            at, node = at[inside], node[inside]
            if not len(at):
                break
            node = self.follow(node << 21 | points[at + n])
            at, node = at[node > 0], node[node > 0]
            out[at, n] = self.of_node[node]
        out[:, 0] = np.where(out[:, 0] == NONE, self.unknown, out[:, 0])
        return out

    def cuts(self, runs: list[str]) -> np.ndarray:
        """Where words start in the runs, one after the other."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        ends = np.cumsum(size)
        points = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.int64)
        weight = self.weights(points, np.repeat(ends, size) - np.arange(len(points)))
        # from the end of all runs at once: best sum from each place on, and the length of the word there
        order = np.argsort(-size, kind="stable")
        longest_first, sizes = ends[order], size[order]
        best = np.zeros(len(points) + len(runs) + self.longest, np.int64)
        after = np.lib.stride_tricks.sliding_window_view(best, self.longest)  # the sums after words of 1, 2, ... characters
        length = np.zeros(len(points), np.int64)
        slot = order  # each run's end has a place of its own
        first = longest_first + slot
        active = np.searchsorted(-sizes, -np.arange(1, int(size.max(initial=0)) + 1), side="right").tolist()
        for back, n in enumerate(active, 1):
            place, at = longest_first[:n] - back, first[:n] - back
            total = (weight[place] + after[at + 1])[:, ::-1]  # no word passes its run's end; of equal sums the longest word is met first
            chosen = total.argmax(1)
            best[at], length[place] = total[np.arange(n), chosen], self.longest - chosen
        start = np.zeros(len(points), bool)
        at, stop = (ends - size)[size > 0], ends[size > 0]
        while len(at):
            start[at] = True
            at = at + length[at]
            on = at < stop
            at, stop = at[on], stop[on]
        return np.flatnonzero(start)

    def segment(self, runs: list[str]) -> list[list[str]]:
        """The words of each run."""
        out: list[list[str]] = []
        a = 0
        while a < len(runs):
            b, held = a, 0
            while b < len(runs) and (b == a or held + len(runs[b]) <= TOGETHER):
                held += len(runs[b])
                b += 1
            joined, cuts = "".join(runs[a:b]), self.cuts(runs[a:b])
            edges = np.r_[cuts, len(joined)].tolist()
            words = [joined[x:y] for x, y in zip(edges, edges[1:])]
            ends = np.searchsorted(cuts, np.cumsum([len(r) for r in runs[a:b]])).tolist()
            out += [words[x:y] for x, y in zip([0, *ends], ends)]
            a = b
        return out


def fit(words: DataFrame, column: str = "word", most: int = MOST, longest: int = LONGEST) -> Segmenter:
    """A segmenter by the words' counts over all rows: the ``most`` most frequent words of ideographs (ties: the smaller first) of up to ``longest`` characters; as many reach the driver."""
    w = F.col(column)
    counts = written(words.where(w.rlike("^[一-鿿]+$")).groupBy(w.alias("word")).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0]
    kept = counts.where(F.length("word") <= longest).orderBy(F.desc("n"), "word").limit(most).collect()
    return Segmenter({r["word"]: r["n"] for r in kept}, total)


def pieces_of(tokens: pa.Array, most: int = TOGETHER) -> Iterator[pa.Array]:
    """Slices of an array of token lists with about ``most`` bytes of tokens each (a longer list stays whole), so that few are Python strings at a time."""
    size = np.asarray(pc.fill_null(pc.binary_length(tokens.flatten()), 0), np.int64)
    count = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
    total = np.r_[0, np.cumsum(size)][np.cumsum(count)]
    at = 0
    while at < len(tokens):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield tokens.slice(at, end - at)
        at = end


def word_splitter(segmenter: Segmenter, spark) -> Callable[[Column], Column]:
    """As ``text.words``, with runs of ideographs cut into words: stop words and words of one character go. Null and empty texts have none."""
    shared = spark.sparkContext.broadcast(segmenter)

    def of(tokens: pa.Array) -> pa.Array:
        rows = tokens.to_pylist()
        runs = [t for r in rows for t in r if IDEOGRAPHS.match(t)]
        found = iter(shared.value.segment(runs))
        return pa.array([[w for t in r for w in (next(found) if IDEOGRAPHS.match(t) else [t])] for r in rows], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def split(tokens: pa.Array) -> pa.Array:
        return pa.concat_arrays([of(part) for part in pieces_of(tokens)] or [pa.array([], pa.list_(pa.string()))])

    def words(column: Column) -> Column:
        pieces = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(text.TOKEN), 1)
        return F.filter(split(pieces), lambda t: (F.length(t) >= 2) & ~t.isin(text.STOP_WORDS))

    return words

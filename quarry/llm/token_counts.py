"""Token counts that follow edits: a segment tree over each document's pre-token runs.

A text is cut into leaves where white space follows other text; byte-level BPE never joins
across such a place, so leaves count apart. The tree holds the sums of tokens and of
characters over leaves, as a heap: node i has the children 2i and 2i + 1. An edit touches
its leaves, and neighbours only where the border is no such place any more; touched leaves
are cut anew if they have grown, encoded once after all edits, and the sums on their way to the root updated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quarry.llm import pseudonyms, quality
from quarry.llm.common import load, slices
from quarry.llm.tokens import encoder, vocabulary_path

#: Characters of a leaf before the next cut.
LEAF = 256
EDITS = "array<struct<start:int,end:int,text:string>>"
COUNTS = (
    "struct<n_tokens:long,chars:array<int>,tokens:array<int>,"
    "after:struct<n_tokens:long,chars:array<int>,tokens:array<int>,n_leaves:int,n_edits:int,n_reencoded:int,text:string>>"
)

_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def leaves_of(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + LEAF) if at + LEAF < len(text) else None
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def heap(values: list[int]) -> list[int]:
    """Sums of 2, 4, 8 ... neighbouring values; the values themselves are the second half, padded with 0."""
    size = 1 << max(0, len(values) - 1).bit_length()
    level = [*values, *[0] * (size - len(values))]
    levels = [level]
    while len(level) > 1:
        level = [a + b for a, b in zip(level[::2], level[1::2])]
        levels.append(level)
    return [0, *(x for each in reversed(levels) for x in each)]


class Tree:
    """A text's leaves with the heaps of their characters and tokens."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.reencoded = 0
        self._build(leaves, tokens, [False] * len(leaves))

    def _build(self, leaves: list[str], tokens: list[int], open_: list[bool]) -> None:
        self.tokens, self.chars = heap(tokens), heap([len(x) for x in leaves])
        self.size = len(self.tokens) // 2
        rest = self.size - len(leaves)
        #: ``open`` leaves are those whose tokens are still to be counted.
        self.leaves, self.open = [*leaves, *[""] * rest], [*open_, *[False] * rest]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with the character at ``place`` (the last one with any, if there is none), and the place within it."""
        node = 1
        place = min(place, max(0, self.chars[1] - 1))
        while node < self.size:
            node *= 2
            if place >= self.chars[node]:
                place -= self.chars[node]
                node += 1
        return node - self.size, place

    def _set(self, leaf: int, text: str) -> None:
        """A leaf's new text; its tokens are counted by ``settle``."""
        node = leaf + self.size
        more = len(text) - self.chars[node]
        self.leaves[leaf], self.open[leaf] = text, True
        while node:
            self.chars[node] += more
            node //= 2

    def edit(self, start: int, end: int, text: str) -> None:
        """Characters from ``start`` up to ``end`` give way to ``text``."""
        first, before = self.leaf_at(start)
        if start >= self.chars[1]:  # at the end of the text
            before = len(self.leaves[first])
        last, stop = first, before
        if end > start:
            last, stop = self.leaf_at(end - 1)
            stop += 1
        new = self.leaves[first][:before] + text + self.leaves[last][stop:]
        while (left := self._neighbour(first, -1)) is not None and not (new and new[0] in " \n" and not self.leaves[left][-1].isspace()):
            new, first = self.leaves[left] + new, left
        while (right := self._neighbour(last, 1)) is not None and not (new and not new[-1].isspace() and self.leaves[right][0] in " \n"):
            new, last = new + self.leaves[right], right
        pieces = leaves_of(new) if len(new) > 2 * LEAF else [new]
        room = last - first + 1
        if len(pieces) <= room:
            for leaf, piece in zip(range(first, last + 1), [*pieces, *[""] * (room - len(pieces))]):
                if piece or self.leaves[leaf]:
                    self._set(leaf, piece)
        else:  # more leaves than before: the heaps are built anew, from the counts that stay
            kept = self.tokens[self.size :]
            n = len(pieces)
            self._build(self.leaves[:first] + pieces + self.leaves[last + 1 :], kept[:first] + [0] * n + kept[last + 1 :], self.open[:first] + [True] * n + self.open[last + 1 :])

    def _neighbour(self, leaf: int, step: int) -> int | None:
        """The next leaf on that side that has characters."""
        leaf += step
        while 0 <= leaf < self.size and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.size else None

    def pending(self) -> list[str]:
        return [x for x, o in zip(self.leaves, self.open) if o]

    def settle(self, counts: Iterator[int]) -> None:
        """The tokens of the ``pending`` leaves, in order; sums above them follow."""
        for leaf, o in enumerate(self.open):
            if o:
                node = leaf + self.size
                more = next(counts) - self.tokens[node]
                self.reencoded += len(self.leaves[leaf])
                while node:
                    self.tokens[node] += more
                    node //= 2
        self.open = [False] * self.size

    def text(self) -> str:
        return "".join(self.leaves)


def counted(texts: list[str], path: str) -> list[int]:
    return np.diff(encoder(path).encode(pa.array(texts, pa.string()))[1]).tolist()


def recount(texts: list[str | None], edits: list[list[dict | None] | None], path: str) -> list[dict]:
    """For each text its tree's counts, and under ``after`` those after the edits with the new text.

    All leaves of all texts are encoded at once, then all leaves that edits have touched.
    """
    leaves = [leaves_of(t or "") for t in texts]
    counts = iter(counted([x for each in leaves for x in each], path))
    trees = [Tree(each, [next(counts) for _ in each]) for each in leaves]
    out = [{"n_tokens": t.tokens[1], "chars": t.chars, "tokens": t.tokens} for t in trees]
    done = []
    for row, t, old, todo in zip(out, trees, texts, edits):
        n, applied = len(old or ""), 0
        if todo:
            row |= {"chars": list(t.chars), "tokens": list(t.tokens)}
        free = n + 1
        for e in sorted((e for e in todo or [] if e and e["start"] is not None and e["end"] is not None), key=lambda e: (-e["start"], -e["end"])):
            start, end = max(0, min(e["start"], n)), min(max(e["start"], e["end"], 0), n)
            if end > free:
                continue
            t.edit(start, end, e["text"] or "")
            free, applied = start, applied + 1
        done.append(applied)
    counts = iter(counted([x for t in trees for x in t.pending()], path))
    for row, t, n in zip(out, trees, done):
        t.settle(counts)
        row["after"] = {"n_tokens": t.tokens[1], "chars": t.chars, "tokens": t.tokens, "n_leaves": t.size, "n_edits": n, "n_reencoded": t.reencoded, "text": t.text()}
    return out


def cleaning_edits(text: str | None) -> list[dict]:
    """What cleaning does to a text, as edits: lines that fail the quality rules go with their line feed, personal data gets pseudonyms."""
    out, at = [], 0
    phrases = quality.may_have_phrases(text or "")
    for line in (text or "").split("\n"):
        n = len(line.encode().split())
        if n and quality.bad_line(line, n, phrases):
            out.append({"start": at, "end": min(at + len(line) + 1, len(text)), "text": ""})
        else:
            out += [{"start": at + a, "end": at + b, "text": new} for a, b, _, new in pseudonyms.replacements(line)]
        at += len(line) + 1
    return out


def recounted(documents: DataFrame, edits: Column | Callable[[str | None], list[dict]], result: str = "counts", vocabulary: str | None = None) -> DataFrame:
    """``documents`` with a struct column ``result``: a text's n_tokens and its tree, and ``after``, the same after the edits with the new text.

    ``edits`` is a column of (start, end, text), or a function that gives a text's. Places are
    characters of the old text. Edits apply from the last to the first; one that overlaps a
    later one, or is null or has no place, is left out; places beyond the text count as its end. A null text counts
    as empty; null edits are none. Leaves that no edit touches keep their counts, and
    ``n_reencoded`` says how many characters were encoded again. Rows are handled one by one, so
    repeated rows and null ids need no rule. A column already named ``result`` is replaced;
    other columns stay as they are. An empty table gives an empty table; a very long text has a
    larger tree, of which an edit touches few leaves.
    """
    path = vocabulary_path(vocabulary)
    kind = to_arrow_type(_parse_datatype_string(COUNTS))
    edits_of = None if isinstance(edits, Column) else edits

    def handle(batch: pa.RecordBatch) -> pa.Array:
        parts = []
        for b in slices(iter([batch]), "text", 1 << 19):
            texts = b.column("text").to_pylist()
            todo = b.column("edits").to_pylist() if edits_of is None else [edits_of(t) for t in texts]
            parts.append(pa.array(recount(texts, todo, path), kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    if edits_of is None:

        def run(texts: pa.Array, edits: pa.Array) -> pa.Array:
            return handle(pa.RecordBatch.from_arrays([texts, edits], names=["text", "edits"]))

        run.__annotations__ = {"texts": pa.Array, "edits": pa.Array, "return": pa.Array}
        arguments = [edits]
    else:

        def run(texts: pa.Array) -> pa.Array:
            return handle(pa.RecordBatch.from_arrays([texts], names=["text"]))

        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        arguments = []
    return documents.withColumn(result, F.arrow_udf(run, COUNTS).asNondeterministic()(F.col("text").cast("string"), *arguments))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of every document before and after cleaning, the latter from the former and the edits."""
    found = recounted(load(spark, sf_dir, "documents").select("doc_id", "text"), cleaning_edits)
    after = [F.col(f"counts.after.{c}").alias(a) for c, a in (("n_tokens", "n_tokens_after"), ("n_leaves", "n_leaves"), ("n_edits", "n_edits"), ("n_reencoded", "n_reencoded"))]
    return found.select("doc_id", F.col("counts.n_tokens").alias("n_tokens"), *after)

"""Repeated windows of a fixed length over all texts, exactly, from anchors.

Every window has one anchor gram (see ``rolling.anchors``), and equal windows have equal
anchors at equal places. So windows need comparing only within the group of one anchor
hash, the seed. A stretch of windows that share an anchor is a context:

1. Contexts are counted by (seed, context) and by seed, with map-side partial sums, so that a
   passage with a million copies is one row for each task and key. Seeds met once are dropped.
2. A context met twice or more is repeated in all its windows: no text is moved for it.
3. The other contexts, one of each, go to the operator's own method: ``by_levels`` counts ever
   longer stretches, with nothing but sums by key; ``by_blocks`` brings the contexts of a
   seed together for an operator that compares them, if there are at most ``HOT``; those of a
   seed with more are counted by levels, so that no task holds a group of any size.
4. Repeated windows return to their documents and become removed elements.

Contexts, longer stretches and windows are known by 64 bits of BLAKE2b of their own bytes,
within one seed; the polynomial hashes only choose anchors and group. Two different
stretches of one seed count as equal with a chance of 2**-64.

No step pairs documents, collects a group on the driver or limits a group's size. A hot key
of a join is one side's single row; Spark splits the other side (adaptive skew join).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import joined_bytes, mixed, slices, stash, text_key
from quarry.llm.rolling import Stretches, anchors, byte_values, word_values

#: Contexts of one seed that a task compares together at most.
HOT = 1000
#: Bytes of text that a task handles at once.
SLICE = 1 << 20

OCCURRENCE = "doc_id long, tk long, first int, lead int, runs int, seed long, context long"
BODY = "seed long, context long, lead int, runs int, body binary"
LEVELS = "seed long, context long, split int, left long, right long, windows array<long>"
MASK = "seed long, context long, lo int, mask binary"


class Kind:
    """How a text becomes elements: its words or its bytes."""

    def __init__(self, words: bool, window: int, gram: int):
        self.words, self.window, self.gram = words, window, gram
        #: Length of a stretch around the gram, one of two (its left or its right) in each window
        self.longer = min((window + gram) // 2, 2 * gram) if words else (window + gram) // 2

    def elements(self, texts: pa.Array) -> Elements:
        return Elements(self, texts)

    def split(self, lead: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Windows before it hold the stretch that ends with the gram, the others the one that starts with it."""
        return np.clip(lead - (self.longer - self.gram) + 1, 0, runs)


class Elements:
    """The elements of a batch: their values, each text's offsets, and the bytes they stand for, words one space apart."""

    def __init__(self, kind: Kind, texts: pa.Array):
        data, offsets = joined_bytes(texts)
        if kind.words:
            self.values, starts, ends, self.offsets = word_values(data, offsets)
            size = ends - starts + 1
            self.at = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(size, out=self.at[1:])
            spaced = np.full(int(self.at[-1]), 32, np.uint8)
            inside = np.ones(len(spaced), bool)
            inside[self.at[1:] - 1] = False
            taken = np.zeros(len(data) + 1, np.int8)
            np.add.at(taken, starts, 1)
            np.add.at(taken, ends, -1)
            spaced[inside] = data[np.cumsum(taken[:-1], dtype=np.int8) > 0]
            self.raw, self.gap = spaced.tobytes(), 1
        else:
            self.values, self.offsets, self.at, self.gap = byte_values()[data], offsets, None, 0
            self.raw = data.tobytes()

    def digests(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits of BLAKE2b of the bytes of each stretch of elements."""
        if self.at is not None:
            begin, end = self.at[begin], self.at[end] - 1
        raw, blake2b = self.raw, hashlib.blake2b
        return np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), end.tolist())]), np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def occurrences(docs: DataFrame, kind: Kind) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            e = kind.elements(batch.column("text"))
            doc_id, tk = batch.column("doc_id"), batch.column("tk")
            for first, lead, runs, seed in anchors(e.values, e.offsets, kind.window, kind.gram):
                doc = np.searchsorted(e.offsets, first, side="right") - 1
                context = e.digests(first, first + runs - 1 + kind.window) ^ mixed((lead * 4096 + runs).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(pa.array(doc)), tk.take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in (first - e.offsets[doc], lead, runs)), _signed(seed), _signed(context)],
                    names=["doc_id", "tk", "first", "lead", "runs", "seed", "context"],
                )

    return docs.mapInArrow(find, OCCURRENCE)


def repeated_contexts(docs: DataFrame, kind: Kind, tag: str) -> DataFrame:
    """Occurrences in seeds met twice or more, with how often their context (n) and how many contexts the seed (k) has."""
    found = occurrences(docs, kind)
    counted = stash(found.groupBy("seed", "context").agg(F.count("*").alias("n")), f"{tag}-counts")
    seeds = counted.groupBy("seed").agg(F.count("*").alias("k"), F.sum("n").alias("met")).where("met > 1").drop("met")
    return found.join(counted.join(seeds, "seed"), ["seed", "context"])


def _cut(docs: DataFrame, hits: DataFrame, kind: Kind, each: Callable, schema: str) -> DataFrame:
    """``each`` over the elements of one occurrence of every different context in ``hits``."""
    one = hits.groupBy("seed", "context").agg(F.min(F.struct("doc_id", "tk", "first", "lead", "runs")).alias("at"))
    wanted = one.select("at.doc_id", "at.tk", F.struct("seed", "context", "at.first", "at.lead", "at.runs").alias("c")).groupBy("doc_id", "tk").agg(F.collect_list("c").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            e = kind.elements(batch.column("text"))
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(wanted)))
            seed, context, first, lead, runs = (np.asarray(flat.field(i)) for i in range(5))
            for at in range(0, len(seed), 4096):
                part = slice(at, at + 4096)
                yield each(e, seed[part], context[part], e.offsets[doc[part]] + first[part], lead[part], runs[part])

    wanted = wanted.withColumnsRenamed({"doc_id": "w_id", "tk": "w_tk"})
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["w_id"]) & (docs["tk"] == wanted["w_tk"])).select("text", "wanted").mapInArrow(run, schema)


def by_levels(docs: DataFrame, hits: DataFrame, kind: Kind, tag: str) -> DataFrame:
    """(seed, context, at): the windows, by their place in the context, that are repeated among the contexts of ``hits``.

    Level-wise: seeds are repeated grams. Of each context, the stretches of ``longer`` elements
    to the left and right of the gram are counted; windows around one met once are dropped.
    Those left are counted at their full length. Each level is a sum by key.
    """

    def each(e: Elements, seed, context, begin, lead, runs) -> pa.RecordBatch:
        place, n = begin + lead, len(e.values)
        split = kind.split(lead, runs)
        left = e.digests(np.maximum(place - (kind.longer - kind.gram), 0), place + kind.gram)
        right = e.digests(place, np.minimum(place + kind.longer, n)) ^ np.uint64(1)
        ends = np.cumsum(runs, dtype=np.int64)
        start = np.repeat(begin - (ends - runs), runs) + np.arange(ends[-1] if len(ends) else 0)
        windows = e.digests(start, start + kind.window)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), _signed(windows))
        return pa.RecordBatch.from_arrays([pa.array(seed), pa.array(context), pa.array(split.astype(np.int32)), _signed(left), _signed(right), lists], names=["seed", "context", "split", "left", "right", "windows"])

    levels = stash(_cut(docs, hits, kind, each, LEVELS), f"{tag}-levels")
    sides = F.array(
        F.struct(F.col("left").alias("stretch"), F.lit(0).alias("lo"), F.expr("slice(windows, 1, split)").alias("windows")),
        F.struct(F.col("right").alias("stretch"), F.col("split").alias("lo"), F.expr("slice(windows, split + 1, size(windows) - split)").alias("windows")),
    )
    half = levels.select("seed", "context", F.explode(sides).alias("s")).select("seed", "context", "s.*").where(F.size("windows") > 0)
    again = half.groupBy("seed", "stretch").agg(F.count("*").alias("met")).where("met > 1").select("seed", "stretch")
    full = half.join(again, ["seed", "stretch"], "left_semi").select("seed", "context", "lo", F.posexplode("windows").alias("i", "window"))
    again = full.groupBy("seed", "window").agg(F.count("*").alias("met")).where("met > 1").select("seed", "window")
    found = full.join(again, ["seed", "window"], "left_semi")
    return stash(found.groupBy("seed", "context").agg(F.collect_list(F.col("lo") + F.col("i")).alias("at")), f"{tag}-masks")


def by_blocks(compare: Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray]], block_bytes: int) -> Callable[[DataFrame, DataFrame, Kind, str], DataFrame]:
    """Contexts of whole seeds side by side in one task, for ``compare``; seeds with more than HOT contexts by levels."""

    def found(docs: DataFrame, hits: DataFrame, kind: Kind, tag: str) -> DataFrame:
        def each(e: Elements, seed, context, begin, lead, runs) -> pa.RecordBatch:
            size = runs - 1 + kind.window
            body = pa.array([e.raw[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist())], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(seed), pa.array(context), pa.array(lead), pa.array(runs), body], names=["seed", "context", "lead", "runs", "body"])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_seeds(batches, block_bytes):
                block = Block(table, kind)
                block.survivors()
                yield block.verdict(*compare(block))

        cut = _cut(docs, hits.where(f"k <= {HOT}"), kind, each, BODY)
        masks = stash(cut.repartition("seed").sortWithinPartitions("seed", "context").mapInArrow(judge, MASK), f"{tag}-masks")
        hot = hits.where(f"k > {HOT}")
        if hot.isEmpty():
            return masks
        return masks.unionByName(by_levels(docs, hot, kind, f"{tag}-hot"), allowMissingColumns=True)

    return found


def whole_seeds(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """From rows sorted by seed, tables of whole seeds with about so many bytes of body (more only for one larger seed)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, "body", least // 2):
        held.append(batch)
        size += sum(np.asarray(pa.compute.binary_length(batch.column("body"))).tolist())
        if size < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        seed = table.column("seed").to_numpy()
        last = int(np.searchsorted(seed, seed[-1], side="left"))
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
        size = sum(sum(np.asarray(pa.compute.binary_length(b.column("body"))).tolist()) for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Block:
    """Different contexts of whole seeds, as one array of bytes."""

    def __init__(self, table: pa.Table, kind: Kind):
        seed, context = (table.column(c).to_numpy() for c in ("seed", "context"))
        # a document row that occurs twice sends its contexts twice
        first = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (context[1:] != context[:-1])])
        table = table.take(pa.array(first)).combine_chunks()
        self.seed, self.context = seed[first], context[first]
        self.lead, self.hi = (table.column(c).to_numpy().astype(np.int64) for c in ("lead", "runs"))
        self.lo = np.zeros(len(self.hi), np.int64)
        self.elements, self.start = joined_bytes(table.column("body").chunk(0))
        self.kind = kind
        self.sums = Stretches(byte_values()[self.elements])

    def survivors(self) -> None:
        """Drops the windows of a side whose longer stretch is met once: they cannot be repeated."""
        kind = self.kind
        place = self.start[:-1] + self.lead
        n = len(self.elements)
        split = kind.split(self.lead, self.hi)
        left = self.sums.at(np.maximum(place - (kind.longer - kind.gram), 0), np.minimum(place + kind.gram, n))
        right = self.sums.at(place, np.minimum(place + kind.longer, n))
        left_alone = ~met_twice(self.seed, left, split > 0)
        right_alone = ~met_twice(self.seed, right, split < self.hi)
        self.lo, self.hi = np.where(left_alone, split, 0), np.where(right_alone, split, self.hi)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and element of each window still in question."""
        count = np.maximum(self.hi - self.lo, 0)
        row = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return row, self.start[row] + self.lo[row] + within

    def verdict(self, row: np.ndarray, at: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
        """Rows of MASK for the contexts that have repeated windows."""
        count = np.bincount(row, minlength=len(self.lo))
        ends = np.cumsum(count)
        rows = np.unique(row[repeated])
        masks = [np.packbits(repeated[ends[r] - count[r] : ends[r]]).tobytes() for r in rows.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(self.seed[rows]), pa.array(self.context[rows]), pa.array(self.lo[rows].astype(np.int32)), pa.array(masks, pa.binary())], names=["seed", "context", "lo", "mask"])


def met_twice(key: np.ndarray, value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each place whether its (key, value) is at another place too, among those that count."""
    both = mixed(value + mixed(key.view(np.uint64)))
    order = np.argsort(both[counts], kind="stable")
    v = both[counts][order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = v[1:] == v[:-1]
    out = np.zeros(len(both), bool)
    out[np.flatnonzero(counts)[order]] = same[1:] | same[:-1]
    return out


def removed_spans(documents: DataFrame, kind: Kind, method: Callable[[DataFrame, DataFrame, Kind, str], DataFrame], tag: str) -> DataFrame:
    """doc_id, text, tk and ``spans``: array of repeated windows (see ``covered``); null if none."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tk", text_key())
    hits = stash(repeated_contexts(docs, kind, tag), f"{tag}-hits")
    masks = method(docs, hits.where("k > 1"), kind, tag)
    none = {"lo": "int", "mask": "binary", "at": "array<int>"}
    masks = masks.select("seed", "context", *[F.col(c) if c in masks.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])
    whole = hits.where("n > 1").select("doc_id", "tk", "first", "runs", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    part = hits.where("n = 1").join(masks, ["seed", "context"]).select("doc_id", "tk", "first", "runs", *none)
    spans = whole.unionByName(part).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("first", "runs", *none)).alias("spans"))  # equal rows have equal spans
    return docs.join(spans.withColumnsRenamed({"doc_id": "s_id", "tk": "s_tk"}), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tk") == F.col("s_tk")), "left").drop("s_id", "s_tk")


def covered(spans: list[dict], n: int, window: int) -> np.ndarray:
    """Which of n elements the repeated windows cover: ``runs`` windows from ``first`` on, or of these the ones in ``mask`` from ``lo`` on, or those ``at``."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        if s["mask"] is None and s["at"] is None:
            edge[s["first"]] += 1
            edge[s["first"] + s["runs"] - 1 + window] -= 1
        else:
            at = s["first"] + (np.array(s["at"], np.int64) if s["mask"] is None else s["lo"] + np.flatnonzero(np.unpackbits(np.frombuffer(s["mask"], np.uint8))))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

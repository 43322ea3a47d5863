"""Groups of near copies by true Jaccard similarity of word shingles, exactly, from prefixes.

All shingles stand in one order. Two sets of similarity ``LEAST`` or more share a shingle
among the first |A| - ceil(LEAST |A|) + 1 of each, whatever the order is; so the
first shingles of each set are its postings, and only sets with a common posting are
compared. Frequent shingles stand last, as far as a sample tells, which keeps postings short.

1. Rows with equal shingle sets are one node.
2. Nodes whose SimHash fingerprints differ in 2 bits or fewer (``simhash.py``) are compared. Fingerprints
   miss most pairs of similarity ``LEAST``, so postings give the others: those
   of up to ``PAIRS`` nodes give all their pairs that sizes allow; in
   larger ones each node is compared with the most central.
3. In the larger ones, each node outside its posting's largest component is compared with a
   few nodes of that component, which leaves fewer outside.
4. The pairs still open are those across the components so far; each node outside a
   posting's largest component is paired with those of other components that sizes, places
   and open postings allow.

Every pair within one component after step 3 is settled, so the components are those of all
pairs of similarity ``LEAST`` or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.common import free_name, joined_bytes, mixed, slices, stash, text_key, unstash
from quarry.llm.components import components
from quarry.llm.rolling import Stretches, word_values

SHINGLE, LEAST = 5, 0.8
#: Nodes of a posting up to which all pairs are compared at once.
PAIRS = 2
#: With how many nodes of a posting's largest component those outside are compared first; changes no result.
PIVOTS = 4
#: Counters for the order of shingles, and one of how many rows is counted; neither changes a result.
BITS, SAMPLE = 16, 8

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of each text's different word shingles (of all its words, if it has fewer; no words: empty)."""
    data, offsets = joined_bytes(texts)
    values, _, _, at = word_values(LOWER[data], offsets)
    s = Stretches(values)
    whole = s.all_of(shingle)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        n = min(shingle, b - a)
        if n == shingle:
            out.append(np.unique(mixed(whole[a : b - n + 1])))
        else:
            out.append(mixed(s.at(np.array([a]), np.array([b])) + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return out


def _signatures(rows: DataFrame) -> DataFrame:
    """Size and 128 bits of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text"))
            sums = np.array([[s.sum(), mixed(s + np.uint64(1)).sum()] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), batch.column("doc_id"), batch.column("tk"), pa.array(np.array([len(s) for s in sets], np.int32)), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())],
                names=["row", "doc_id", "tk", "n", "s1", "s2"],
            )

    wanted = rows.select("__row", F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(run, "row long, doc_id long, tk long, n int, s1 long, s2 long")


def _frequencies(rows: DataFrame) -> np.ndarray:
    """How many shingles of a sample fall on each counter. 2**BITS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for batch in slices(batches, "text", 1 << 20):
            for s in shingle_sets(batch.column("text")):
                np.add.at(counts, (s >> np.uint64(64 - BITS)).astype(np.int64), 1)
        i = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(counts[i])], names=["i", "v"])

    out = np.zeros(1 << BITS, np.int64)
    for r in rows.where(F.pmod(F.xxhash64("__row"), F.lit(SAMPLE)) == 0).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def prefix_size(n: int, least: float = LEAST) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1


def _postings(texts: DataFrame, frequency: np.ndarray) -> DataFrame:
    """(h, node, n, place, rare, last) of the first shingles of each node.

    ``rare`` is small for a node whose shingles are frequent, as those of a group's middle are:
    what two copies changed differs, so each is nearer to the middle than to the other. ``last`` stands for the place of the
    node's last posting in the order of all shingles; where two are equal, either may be the later.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text"))
            first, rare, last = [], np.zeros(len(sets), np.float32), np.zeros(len(sets), np.int64)
            for i, s in enumerate(sets):
                often = shared.value[(s >> np.uint64(64 - BITS)).astype(np.int64)]
                order = np.lexsort((s, often))
                first.append(s[order[: prefix_size(len(s))]] if len(s) else s)
                if len(s):
                    end = order[len(first[i]) - 1]
                    rare[i], last[i] = -np.log1p(often).mean(), min(int(often[end]), (1 << 31) - 1) << 32 | int(s[end] >> np.uint64(32))
            size = np.array([len(p) for p in first], np.int64)
            h = np.concatenate(first) if first else np.zeros(0, np.uint64)
            node = np.repeat(np.asarray(batch.column("node"), np.int64), size)
            n = np.repeat(np.array([len(s) for s in sets], np.int32), size)
            place = (np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            columns = [h.view(np.int64), node, n, place, np.repeat(rare, size), np.repeat(last, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "node", "n", "place", "rare", "last"])

    return texts.mapInArrow(run, "h long, node long, n int, place int, rare float, last long")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose shingle sets have a Jaccard similarity of LEAST or more.

    Pairs are written first, so that their size is known before texts are joined, and only
    the texts that they name are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "one", 1 << 20):
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    keep = []
                    for x, y in zip(shingle_sets(part.column("one")), shingle_sets(part.column("two"))):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(both >= LEAST * (len(x) + len(y) - both) - 1e-9)
                    yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stash(pairs.distinct(), "near-pairs")
    named = stash(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-named", small=True)
    used = stash(texts.join(named, "node", "left_semi"), "near-used", compression="zstd")
    one, two = (used.select(F.col("node").alias(k), F.col("text").alias(t)) for k, t in (("a", "one"), ("b", "two")))
    found = stash(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long"), "near-similar")
    unstash(used)
    return found


#: Whether the sizes of two sets allow LEAST.
SIZES = f"least(x.n, y.n) >= {LEAST} * greatest(x.n, y.n) - 1e-6"


def by_fingerprint(texts: DataFrame) -> DataFrame:
    """(a, b): nodes of equal fingerprints with the smallest of them, and the smallest of fingerprints that SimHash links."""
    own = stash(simhash.fingerprints(texts.withColumnRenamed("node", "doc_id")), "near-fingerprints").withColumnRenamed("doc_id", "node")
    least = stash(own.groupBy("fp").agg(F.min("node").alias("least")), "near-least")
    equal = own.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda fp, name: least.select(F.col("fp").alias(fp), F.col("least").alias(name))
    near = simhash.links(least.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb")).distinct().join(of("fa", "na"), "fa").join(of("fb", "nb"), "fb")
    return equal.unionByName(near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")))


def links(texts: DataFrame, frequency: np.ndarray) -> DataFrame:
    """(a, b) between nodes; their components are those of all pairs of similarity LEAST or more."""
    alike = stash(by_fingerprint(texts), "near-alike")
    postings = _postings(texts, frequency)
    met = postings.groupBy("h").agg(F.count("*").alias("met")).where("met > 1")
    shared = stash(postings.join(met, "h"), "near-postings")
    small, large = shared.where(f"met <= {PAIRS}").select("h", "node", "n", "place"), shared.where(f"met > {PAIRS}")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.h") == F.col("y.h")) & F.expr("x.node < y.node") & F.expr(SIZES)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    centre = large.groupBy("h").agg(F.min(F.struct("rare", "node", "n")).alias("centre"))
    stars = large.join(centre, "h").where(f"node <> centre.node and least(n, centre.n) >= {LEAST} * greatest(n, centre.n) - 1e-6").select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))
    found = _similar(alike.unionByName(pairs).unionByName(stars), texts)
    still = _still(large, found)
    if still.isEmpty():
        return found
    found = found.unionByName(_similar(_to_pivots(still), texts))
    still = _still(large, found)
    if still.isEmpty():
        return found
    return found.unionByName(_similar(_crossing(still), texts))


def _still(large: DataFrame, found: DataFrame) -> DataFrame:
    """The postings whose nodes lie in several components, with each node's root and the posting's largest component."""
    roots = components(found, "near-components")
    placed = stash(large.select("h", "node", "n", "place", "rare", "last").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-placed")
    main = placed.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main")).where("roots > 1").drop("roots")
    still = stash(placed.join(main, "h"), "near-still")
    unstash(placed)
    return still


def _crossing(still: DataFrame) -> DataFrame:
    """The pairs across components that sizes, places, and the open postings of each node allow.

    Take the list of first shingles that ends first in the order of all shingles. What it has in
    common with the other set is in the other's list too, hence in an open posting; so from a common
    posting on, the two sets share at most the node's open postings from there on, and what
    stands behind its list. They also share at most what is left of either set from that place
    on. A row of the join is made only if that is enough; the first common posting of similar
    sets always is. Both bounds fall with the place, so up to the last row of a pair none is
    missing, and the rows and what can follow them bound the pair once more.
    """
    later = Window.partitionBy("node").orderBy(F.desc("place"))  # at most the postings of one text
    rows = still.withColumn("open", F.row_number().over(later)).withColumn("behind", F.expr(f"ceil({LEAST} * n - 1e-9) - 1").cast("int"))
    rows = stash(rows.drop("rare"), "near-open")
    needed = f"{LEAST / (1 + LEAST)} * (x.n + y.n) - 1e-6"
    left = "least(x.n - x.place, y.n - y.place, case when x.last < y.last then x.open + x.behind when y.last < x.last then y.open + y.behind else greatest(x.open + x.behind, y.open + y.behind) end)"
    met = rows.where("root <> main").alias("x").join(
        rows.alias("y"), (F.col("x.h") == F.col("y.h")) & F.expr("x.root <> y.root and (y.root = y.main or x.node < y.node)") & F.expr(SIZES) & F.expr(f"{left} >= {needed}")
    )
    pair = F.struct(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    pairs = met.select(pair.alias("p"), F.expr(left).alias("left"), F.expr(needed).alias("needed")).groupBy("p").agg(F.count("*").alias("c"), F.min("left").alias("left"), F.min("needed").alias("needed"))
    return pairs.where("c - 1 + left >= needed").select("p.a", "p.b")


def _to_pivots(still: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Each node outside its posting's largest component with up to ``pivots`` nodes of that component.

    A pivot is the most central of its part, so that postings with nearly the same nodes have the same ones.
    """
    order = F.struct("rare", "node", "n", "place")
    part = F.pmod(F.xxhash64(F.lit(pivots), "node"), F.lit(pivots)).alias("part")
    chosen = still.where("root = main").groupBy("h", part).agg(F.min(order).alias("p")).select("h", "p.node", "p.n", "p.place")
    return (
        still.where("root <> main").alias("x").join(chosen.alias("y"), (F.col("x.h") == F.col("y.h")) & F.expr(SIZES))
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns as they are.

    Candidates are pairs that SimHash links, each then checked, and pairs with common rare shingles.
    Texts are lower-cased in A-Z and cut into words; rows link if the sets of their 5-word
    shingles have a Jaccard similarity of 0.8 or more, and groups are what links reach. The
    row of the smallest doc_id stays (ties: by text, then by a row number that is written
    first); rows without an id stay only if their group has no id. Texts without words, null
    ones too, are one group. An empty table gives an empty table; a very long text counts with all
    its shingles.
    """
    row = free_name(documents, "row")
    rows = stash(documents.withColumn(row, F.monotonically_increasing_id()), "near-rows", compression="zstd")
    own = rows.select(F.col(row).alias("__row"), "doc_id", "text")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk", "row")
    nodes = stash(_signatures(own).groupBy("n", "s1", "s2").agg(F.min("row").alias("node"), F.min(best).alias("best")), "near-nodes")
    texts = stash(own.select(F.col("__row").alias("node"), F.col("text").cast("string").alias("text")).join(nodes.where("n > 0").select("node"), "node", "left_semi"), "near-texts", compression="zstd")
    roots = components(links(texts, _frequencies(own)), "near-roots")
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])

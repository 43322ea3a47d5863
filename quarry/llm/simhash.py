"""SimHash near-dedup: fingerprints, generalised pigeonhole search, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import load, slices, stash
from quarry.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Members of a bucket up to which pairs are compared; larger ones link through shared neighbours, as exactly.
PAIRS = 32


def fingerprint_of(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of all word shingles of a text (of all its words, if it has fewer)."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    return np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64, len(starts))


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, a long whose bit is 1 where over half the shingles' hashes have it (no words: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                hashes = fingerprint_of((text or "").encode().lower().split(), shingle)
                n = len(hashes)
                if not n:
                    continue
                ones = np.zeros(64, np.int64)
                for at in range(0, n, 1 << 16):
                    ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def agreement(fps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of the 64 bits over all fingerprints, and each bit's share of ones. 64 x 65 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        i, j = np.indices((64, 64)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, -1].astype(np.int32)), pa.array(np.r_[j, -1].astype(np.int32)), pa.array(np.r_[total.ravel(), n])], names=["i", "j", "v"])

    rows = fps.select("fp").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    both, n = np.zeros((64, 64)), 1.0
    for r in rows:
        if r["i"] < 0:
            n = max(1.0, r["v"])
        else:
            both[r["i"], r["j"]] = r["v"]
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return (both / n - np.outer(p, p)) / np.outer(spread, spread), p


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64/m bits, each grown by the bit most correlated with those it has."""
    strength, left, groups = np.abs(correlation), set(range(64)), []
    for g in range(m):
        size = 64 // m + (g < 64 % m)
        start = max(left, key=lambda b: (strength[b, list(left)].sum(), -b))
        group = [start]
        left.discard(start)
        while len(group) < size:
            best = max(left, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, one for each partition, that add up to ``total`` at the least cost: dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for (have, (so_far, chosen)), (t, c) in product(best.items(), cost.items()):
            if have + t not in after or so_far + c < after[have + t][0]:
                after[have + t] = (so_far + c, [*chosen, t])
        best = after
    return best[total]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _plan(fps: DataFrame, distance: int) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of the partitions to probe: unequal thresholds that sum to distance - m + 1."""
    correlation, p = agreement(fps)
    choices = {m: group_bits(correlation, m) for m in (2, 3, 4)}
    # candidates that agree in a whole partition, from the sizes of all its buckets: pairs in small ones, a row for each bit and member in large ones
    masks = [(m, g, _mask(bits)) for m, groups in choices.items() for g, bits in enumerate(groups)]
    sizes = (
        fps.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for m, g, mask in masks])).alias("x"))
        .groupBy("x.m", "x.g", "x.v").count().groupBy("m", "g").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("count") <= PAIRS, F.col("count") * F.col("count")).otherwise(F.col("count") * 64)).alias("pairs"))
    )
    known = {(r["m"], r["g"]): (r["n"], r["pairs"]) for r in sizes.collect()}
    same = p**2 + (1 - p) ** 2
    best = None
    for m, groups in choices.items():
        costs = []
        for g, bits in enumerate(groups):
            n, pairs = known.get((m, g), (0, 0))
            near = 1 + float(((1 - same[bits]) / same[bits]).sum())  # neighbours of a value, for each of its own
            costs.append({-1: 0.0, 0: n + pairs, 1: n * (1 + len(bits)) + pairs * near})
        cost, chosen = thresholds(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(_mask(bits), bits, t) for bits, t in zip(groups, chosen) if t >= 0])
    return best[1]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links a, b between different fingerprints that give the components of all pairs within ``distance`` = 2 bits.

    Pairs are candidates if they agree within a partition's threshold. Small buckets compare
    pairs. In a large bucket a member also stands under each value that differs from it in one
    bit outside the partition (a prober that has spent its one bit inside: under its own
    only), and each value links to the smallest that stands there: two fingerprints that
    share a value differ in 2 bits at most, and all that differ in 2 or fewer share one.
    """
    flips = lambda bits: F.array(*[F.lit(_mask([b])) for b in bits])
    found = None
    for k, (mask, bits, t) in enumerate(_plan(fps, distance)):
        rest = [b for b in range(64) if b not in bits]
        own = fps.select("fp", F.col("fp").bitwiseAND(F.lit(mask)).alias("v"))
        sizes = own.groupBy("v").count().where("count > 1" if t == 0 else "count > 0")
        probes = own.withColumn("spent", F.lit(False))
        if t:
            near = own.select("fp", F.explode(F.transform(flips(bits), lambda f: F.col("v").bitwiseXOR(f))).alias("v"))
            probes = probes.unionByName(near.withColumn("spent", F.lit(True)))
        probes = probes.join(sizes, "v")
        small, large = probes.where(f"count <= {PAIRS}"), probes.where(f"count > {PAIRS}")
        pairs = (
            small.select(F.col("fp").alias("a"), "v", "spent").join(own.select(F.col("fp").alias("b"), "v"), "v")
            .where((F.col("a") < F.col("b")) | F.col("spent"))
            .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
            .select("a", "b")
        )
        reach = F.when(F.col("spent"), F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.array(F.lit(0).cast("long")), flips(rest)))
        outside = F.col("fp").bitwiseAND(F.lit(~mask if mask >= 0 else ~mask))
        stands = large.select("fp", "v", F.explode(F.transform(reach, lambda f: outside.bitwiseXOR(f))).alias("z"))
        # fingerprints are different, so a value has at most one row for each bit outside the partition, and its own
        stars = stands.withColumn("b", F.min("fp").over(W.partitionBy("v", "z"))).where("fp <> b").select(F.col("fp").alias("a"), "b")
        both = pairs.unionByName(stars)
        found = both if found is None else found.unionByName(both)
    return found


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of every row.

    Texts are lower-cased in A-Z and cut into words; the fingerprint is over word shingles,
    repeats included. Fingerprints link at 2 or fewer differing bits; component_id is the
    smallest doc_id reachable. Null and empty texts have fingerprint 0 and link as any other.
    Null doc_ids stay null and give no component_id (null if a component has no other). Rows
    with equal doc_id stay separate rows. An empty table gives an empty table. Other columns
    are ignored. Equal fingerprints are one node, so copies cost no pairs.
    """
    own = stash(fingerprints(documents, shingle), "simhash")
    fps = stash(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(fps), "simhash-links")
    known = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose doc_id is the smallest of its component, all columns as they are.

    Of rows with equal doc_id that all count as the smallest, all stay. Rows with a null
    doc_id stay only if their component has no other.
    """
    found = near_duplicates(documents)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return documents.join(first, documents["doc_id"].cast("long").eqNullSafe(first["__kept"]), "left_semi")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

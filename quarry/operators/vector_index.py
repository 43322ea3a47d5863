"""A persisted vector index: every vector in the cell of its nearest centre, with tombstones and compaction.

Centres are fitted once, on a bounded sample; all vectors are indexed. A search reads the cells
nearest to each query, or, in exact mode, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import numeric
from quarry.operators.keyword_index import without_dead
from quarry.operators.retrieval import cosine_top, sliced, top
from quarry.sources.store import Commit, Store
from quarry.sources.tables import written

#: Cells; vectors for each of them that centres are fitted on (those of the smallest id hashes); rounds of fitting.
CELLS, SAMPLE, ROUNDS = 64, 128, 10
#: Cells that a search reads for each query. Vectors without much structure need most cells for a recall of 0.9; with clear clusters a few do.
PROBES = 40
#: Queries that pass the driver together.
BLOCK = 1024

SCHEMAS = {"centres": "cell int, centre array<double>", "vectors": "chunk_id long, segment long, embedding array<float>, cell int"}


def fit_centres(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Unit centres of unit vectors: starts spread over the sample, then means of the nearest."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _units(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dim`` finite components that have a length, as unit vectors, and which those are."""
    fits = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), -1)) == dim
    v = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    size = np.linalg.norm(v, axis=1)
    good = np.isfinite(size) & (size > 0)
    fits[np.flatnonzero(fits)] = good
    return v[good] / size[good, None], fits


class VectorIndex:
    """Add, remove, search and compact. Every change is one commit; a search sees one state as a whole."""

    def __init__(self, store: Store, cells: int = CELLS):
        self.store, self.cells = store, cells

    def add(self, vectors: DataFrame) -> None:
        """Indexes vectors (chunk_id, not null and unique, and embedding, kept in single precision); those whose id is there already are replaced.

        A vector without length, or of another dimension than the first ones, matches nothing; it is kept in no cell.
        """
        commit = self.store.begin()
        own = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        centres = self._centres(commit.state)
        if not len(centres):
            centres = self._fit(own)
            if not len(centres):
                return
            rows = [(i, c.tolist()) for i, c in enumerate(centres)]
            commit.append("centres", self.store.spark.createDataFrame(rows, SCHEMAS["centres"]).coalesce(1))
        self._bury(commit, own.select("chunk_id"))
        self._write(commit, own, centres)
        commit.finish()

    def remove(self, ids: DataFrame) -> None:
        """Takes vectors out; ids that the index doesn't have are passed over."""
        commit = self.store.begin()
        self._bury(commit, ids.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct())
        commit.finish()

    def compact(self) -> None:
        """One segment of what lives, without tombstones."""
        commit = self.store.begin()
        if "vectors" not in commit.state["tables"]:
            return
        living = self._living(commit.state).select("chunk_id", "embedding")
        commit.tables.pop("vectors")
        commit.tables.pop("dead", None)
        self._write(commit, living, self._centres(commit.state))
        commit.finish()

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = PROBES, keep: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank: the k nearest by cosine among the cells nearest to each query (query_id, embedding); with ``probes`` None among all, exactly. ``keep`` (chunk_id) cuts hits."""
        state = self.store.manifest()
        living = self._living(state)
        if keep is not None:
            living = living.join(keep.select("chunk_id").distinct(), "chunk_id", "left_semi")
        centres = self._centres(state)
        if probes is None or not len(centres):
            return top(cosine_top(queries, living, k), k)
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).where(F.col("q").isNotNull() & (numeric.norm(F.col("q")) > 0) & (F.size("q") == centres.shape[1]))
        found, held = None, []

        def flush() -> None:
            nonlocal found, held
            if held:
                q = np.array([r["q"] for r in held])
                part = self._near(living, np.array([r["query_id"] for r in held], np.int64), q / np.linalg.norm(q, axis=1, keepdims=True), centres, k, probes)
                found = part if found is None else found.unionByName(part)
                held = []

        for r in asked.toLocalIterator():
            held.append(r)
            if len(held) == BLOCK:
                flush()
        flush()
        return top(cosine_top(queries.limit(0), living, k) if found is None else found, k)

    @staticmethod
    def _near(living: DataFrame, ids: np.ndarray, q: np.ndarray, centres: np.ndarray, k: int, probes: int) -> DataFrame:
        nearest = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        wanted = {c: np.flatnonzero((nearest == c).any(1)) for c in np.unique(nearest).tolist()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in sliced(batches, len(q)):
                unit, fits = _units(batch.column("embedding"), q.shape[1])
                cell, id_ = (batch.column(c).to_numpy(zero_copy_only=False)[fits] for c in ("cell", "chunk_id"))
                parts = [best]
                for c in np.unique(cell).tolist():
                    mine, asking = np.flatnonzero(cell == c), wanted[c]
                    scores = q[asking] @ unit[mine].T
                    parts.append((np.repeat(asking, len(mine)), np.tile(id_[mine], len(asking)), scores.ravel()))
                who, which, score = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((which, -np.round(score, 6), who))
                who, which, score = who[order], which[order], score[order]
                start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)])
                rank = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
                best = tuple(x[rank < k] for x in (who, which, score))
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "chunk_id", "score"])

        return living.where(F.col("cell").isin(list(wanted))).select("cell", "chunk_id", "embedding").mapInArrow(run, "query_id long, chunk_id long, score double")

    def _centres(self, state: dict) -> np.ndarray:
        rows = sorted(self.store.read("centres", SCHEMAS["centres"], state).collect())
        return np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))

    def _fit(self, own: DataFrame) -> np.ndarray:
        """Of the sample's dimensions the most frequent counts."""
        sample = [r["embedding"] for r in own.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE * self.cells).collect()]
        sizes = [len(v) for v in sample if v]
        if not sizes:
            return np.zeros((0, 0))
        unit, _ = _units(pa.array(sample, pa.list_(pa.float32())), max(sorted(set(sizes)), key=sizes.count))
        return fit_centres(unit, self.cells, ROUNDS) if len(unit) else np.zeros((0, 0))

    def _write(self, commit: Commit, own: DataFrame, centres: np.ndarray) -> None:
        shared = own.sparkSession.sparkContext.broadcast(centres)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, fits = _units(batch.column("embedding"), shared.value.shape[1])
                cell = np.full(batch.num_rows, -1, np.int32)
                if len(unit):
                    cell[fits] = np.argmax(unit @ shared.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        placed = own.select("chunk_id", F.lit(commit.state["version"] + 1).cast("long").alias("segment"), "embedding").mapInArrow(cells, SCHEMAS["vectors"])
        folder = placed.repartitionByRange("cell", F.xxhash64("chunk_id"))  # a large cell is several files
        commit.append("vectors", folder, by="cell")

    def _bury(self, commit: Commit, ids: DataFrame) -> None:
        old = written(self._living(commit.state).select("chunk_id").join(ids, "chunk_id", "left_semi"), "index-dead")
        if not old.isEmpty():
            commit.append("dead", old.select("chunk_id", F.lit(commit.state["version"]).cast("long").alias("upto")))

    def _living(self, state: dict) -> DataFrame:
        return without_dead(self.store, self.store.read("vectors", SCHEMAS["vectors"], state), state)

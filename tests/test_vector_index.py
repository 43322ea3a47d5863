"""The persisted vector index against the plain search, after changes in any order, and its recall."""

from __future__ import annotations

import random

from quarry.operators import retrieval as R
from quarry.operators.vector_index import VectorIndex
from quarry.plans import catalog
from quarry.sources.store import Store


def found(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


def test_changes_in_any_order_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    vector = lambda: [float(rng.randrange(-4, 5)) for _ in range(6)]
    index, held = VectorIndex(Store(spark, f"file://{tmp_path}/v"), cells=5), {}
    queries = spark.createDataFrame([(1, vector()), (2, [0.0] * 6), (3, None), (4, [1.0] * 5), (5, [1.0] * 6)], "query_id long, embedding array<double>")
    schema = "chunk_id long, embedding array<float>"
    assert index.search(queries, 3).collect() == []
    for step in ["add", "remove", "add", "compact", "add", "remove"]:
        ids = rng.sample(range(90), 45)
        if step == "add":
            new = {i: rng.choice([vector(), vector(), vector(), [0.0] * 6, None, [1.0]]) for i in ids}
            held |= new
            index.add(spark.createDataFrame(list(new.items()), schema))
        elif step == "remove":
            held = {i: v for i, v in held.items() if i not in ids}
            index.remove(spark.createDataFrame([(i,) for i in ids + [999]], "chunk_id long"))
        else:
            index.compact()
    plain = spark.createDataFrame(list(held.items()), schema)
    want = found(R.top(R.cosine_top(queries, plain, 6), 6))
    assert len(want) == 12
    assert found(index.search(queries, 6, probes=None)) == want and found(index.search(queries, 6, probes=5)) == want
    some = found(index.search(queries, 6, probes=1))
    assert some and {(q, c) for q, _, c, _ in some} <= {(q, c) for q, _, c, _ in found(R.top(R.cosine_top(queries, plain, 99), 99))}
    keep = plain.where("chunk_id % 2 = 0")
    assert found(index.search(queries, 6, None, keep)) == found(R.top(R.cosine_top(queries, keep, 6), 6))


def test_recall_of_the_nearest_cells(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        rows = catalog.QUERIES["x01_recall"](spark, folder).collect()
        share = sum(r["n_found"] for r in rows) / sum(r["n_wanted"] for r in rows)
        print(folder, "recall at 20", share)
        assert share >= 0.9


def test_tasks_hold_a_bounded_number_of_scores():
    import pyarrow as pa

    from quarry.operators import retrieval

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["x"])
    parts = list(retrieval.sliced(iter([batch]), 1024))
    assert max(p.num_rows for p in parts) * 1024 <= retrieval.HELD and [x for p in parts for x in p.column(0).to_pylist()] == list(range(10_000))

"""The whole pipeline over tables with nulls, repeats, clashing columns, a very long text, and over empty ones."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import near_copies

FOLDER = "/root/testdata/sf0.001"
#: Names that stages use themselves, as a table may have them.
CLASH = {"__row": 1, "__ROWS": "a", "h": 2, "tk": 3, "quality": "b", "mix": 4, "__mix_t": 5, "sampled": True, "leaks": 6, "n_tokens": 7, "item_id": 8, "component_id": 9, "topic": "c", "w": 1.5}


def test_run_over_an_awkward_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, FOLDER).orderBy("doc_id")
    one = good.limit(1).select("text").first()[0]
    texts = [r["text"] for r in good.select("text").collect()]
    odd = [
        (9001, None, "en", "s"), (9002, "", "en", "s"), (9003, " \n\t", None, None),
        (9004, "\n".join(t.replace("\n", " ") for t in texts), None, "s"),  # very long
        (9005, texts[3] + " and a word more", None, None), (None, texts[4] + " and some words more", "en", None),
    ]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    repeated = docs.where(F.col("text") == one)
    table = docs.unionByName(odd).unionByName(repeated).unionByName(repeated)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    nothing = spark.createDataFrame([(None, None), (-1, ""), (-1, None)], bench.schema)
    folder = f"file://{tmp_path}/odd"
    table.withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(5).write.parquet(f"{folder}/documents.parquet")
    bench.unionByName(nothing).withColumns({"text_key": F.lit(1), "doc_id": F.lit(2), "h": F.lit(3)}).write.parquet(f"{folder}/benchmark.parquet")

    rows = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = rows.columns, [rows.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder).cache()
        assert rows.columns == columns
        for name, value in CLASH.items():
            assert {r[0] for r in rows.select(F.col(f"`{name}`")).distinct().collect()} == {value}
        sizes.append(rows.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 20
    ids = [r["doc_id"] for r in rows.select("doc_id").collect()]
    assert not {9001, 9002, 9003} & set(ids) and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    kept = near_copies.keep_one(corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    assert kept.where(F.col("text") == one).count() == 1
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in found) == sorted((i is None, i) for i in ids)
    assert all(r["n_tokens"] > 0 for r in found)


def test_run_over_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/empty"
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0

"""Many equal rows, and columns named as operators' own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import near_copies, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(300)}" for _ in range(n))


@pytest.mark.parametrize("operator, size", [(substring_dedup.remove_repeated_windows, "n_words"), (suffix_dedup.remove_repeated_strings, "n_bytes")])
def test_equal_rows_without_id(spark, operator, size):
    """Their spans are held once, not once for each row."""
    n = 20_000
    df = spark.range(n, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(prose(1, 60)).alias("text"))
    got = operator(df.unionByName(spark.createDataFrame([(1, prose(2, 60))], "doc_id long, text string")))
    r = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_removed").alias("least"), F.max("n_removed").alias("most"), F.max(size).alias("size"), F.max(F.length("kept")).alias("left")).collect()
    found = {x["doc_id"]: x for x in r}
    assert found[None]["n"] == n and found[None]["least"] == found[None]["most"] == found[None]["size"] and found[None]["left"] == 0
    assert found[1]["n"] == 1 and found[1]["most"] == 0


@pytest.mark.parametrize("name", ["__row", "__rows", "node"])
def test_near_copies_with_clashing_columns(spark, name):
    a, b = prose(3, 200), prose(4, 200)
    df = spark.createDataFrame([(1, a, "en", "s", 1), (2, a + " one more", "en", "s", 1), (3, b, "en", "s", 1), (None, b, "en", "s", 1)], SCHEMA).withColumn(name, F.lit("x"))
    got = near_copies.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r[name]) for r in got.collect()) == [(1, "x"), (3, "x")]
    assert near_copies.keep_one(df.limit(0)).collect() == []

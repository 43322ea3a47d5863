"""The merge of pieces into chunks gets their lengths, not their texts."""

from __future__ import annotations

from quarry.operators import ingestion as I


def test_merge_by_lengths(spark):
    pieces = [(50, 1, "text", False, False), (60, 1, "text", False, False), (900, 1, "text", False, False), (10, 2, "text", False, False)]
    df = spark.createDataFrame([(pieces,)], "pieces array<struct<n int, page_no int, kind string, heading boolean, exam boolean>>")
    assert df.select(I._merger(1000, 100)("pieces")).first()[0] == I.merge_groups([50, 60, 900, 10], [1, 1, 1, 2], ["text"] * 4, [False] * 4, 1000, 100)

"""What goes with the pairs of blocks and tables."""

from __future__ import annotations

from quarry.operators import ingestion as I


def test_contents_do_not_go_with_pairs(spark):
    box = [0.0, 0.0, 1.0, 1.0]
    blocks = spark.createDataFrame([(1, 1, n, "text", "x", box, 1.0) for n in range(3)], "document_id long, page_no int, reading_order int, block_type string, content string, bbox array<double>, confidence double")
    ts = spark.createDataFrame([(1, 1, 2, "b", box), (1, 1, 1, "a", box)], "document_id long, page_no int, table_no int, content string, bbox array<double>")
    found = I.with_tables(blocks, ts)
    assert sorted((r["reading_order"], r["block_type"], r["content"]) for r in found.collect()) == [(0, "table", "a"), (1, "text", "x"), (2, "text", "x")]
    assert "min_by" not in found._jdf.queryExecution().executedPlan().toString()

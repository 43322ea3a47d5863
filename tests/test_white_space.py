"""White space at the ends of texts, against Java's own class, and what stripping costs on long runs of it."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import ingestion as I


def test_white_space_is_that_of_unicode(spark):
    points = spark.range(1, 0x10000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    t = F.concat(F.col("c"), F.lit(" a"), F.col("c"), F.lit("b "), F.col("c"))
    found = points.select("id", text.stripped(t).alias("got"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "").alias("want"))
    assert found.where("got <> want").collect() == []
    assert found.where("got like 'a%b'").count() == len(text.WHITE)


def test_runs_of_white_space_inside_a_line_cost_their_length(spark):
    """A pattern anchored at the end looks at a run again from each of its places."""
    line = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 400_000), F.lit("b")).alias("t"))
    began = time.time()
    assert line.select(F.length(text.stripped(F.col("t")))).first()[0] == 400_002
    assert time.time() - began < 10


def test_lines_of_a_text_are_found_once(spark):
    docs = spark.createDataFrame([(1, 1, " a \n\n b"), (2, 1, None), (3, 1, " \n")], "document_id long, page_no int, text string")
    found = I.layout_of(docs)
    assert [tuple(r) for r in found.select("document_id", "reading_order", "content").collect()] == [(1, 0, "a"), (1, 1, "b")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1

"""Scores and grades as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import numeric, text
from quarry.plans.registry import query
from quarry.sources.tables import read


@query("m03_rank_shares", "SELECT p_partkey, 1.0::DOUBLE / (60 + p_size) AS share FROM part")
def rank_shares(spark, d):
    return read(spark, d, "part").select("p_partkey", numeric.rrf(F.col("p_size")).alias("share"))


@query("m04_costs", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN round_even(c_custkey / 1000.0::DOUBLE * 0.015 + 0.06, 9) ELSE -1.0 END AS cost FROM customer".replace("0.015", "0.015::DOUBLE").replace("0.06,", "0.06::DOUBLE,").replace("-1.0", "-1.0::DOUBLE"))
def costs(spark, d):
    model = F.when(F.col("c_mktsegment") == "BUILDING", "gpt-4o").otherwise("other")
    return read(spark, d, "customer").select("c_custkey", F.bround(numeric.cost(model, F.col("c_custkey"), F.lit(1000)), 9).alias("cost"))


@query("m05_backoff", "SELECT l_linenumber AS attempt, 0.8::DOUBLE * 2 ** l_linenumber AS seconds, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def backoff(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("attempt")).agg(F.count("*").alias("n")).withColumn("seconds", numeric.backoff(F.col("attempt")))


@query("m06_bands", "SELECT event_id, CASE WHEN value / 5 >= 80 THEN 'good' WHEN value / 5 >= 60 THEN 'pass' ELSE 'weak' END AS band FROM events")
def bands(spark, d):
    return read(spark, d, "events").select("event_id", numeric.grade_band(F.col("value") / 5).alias("band"))


@query("f06_choice_grades", "SELECT o_orderkey, CASE WHEN upper(trim(o_orderstatus)) = 'F' THEN 4.0 ELSE 0.0 END::DOUBLE AS score FROM orders")
def choice(spark, d):
    answer = F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit("\t"))
    return read(spark, d, "orders").select("o_orderkey", F.when(text.choice_is_right(answer, F.lit("f")), 4.0).otherwise(0.0).alias("score"))


@query("f07_blank_grades", "SELECT l_orderkey, l_linenumber, (l_quantity - 20) / 20 BETWEEN -0.0099999 AND 0.0099999 OR l_returnflag = 'A' AS is_right FROM lineitem")
def blank(spark, d):
    """A number within one in a hundred of 20, or an accepted form."""
    answer = F.when(F.col("l_returnflag") == "A", "Ａ  x").otherwise(F.concat(F.col("l_quantity").cast("string"), F.lit(" kg")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.blank_is_right(answer, F.lit("20"), F.array(F.lit("a X"))).alias("is_right"))


@query("m08_statuses", "SELECT event_id, CASE WHEN value / 500 >= 0.9 THEN 'met' WHEN value / 500 >= 0.3 THEN 'partial' ELSE 'not_met' END AS status FROM events")
def statuses(spark, d):
    r = F.col("value") / 500
    return read(spark, d, "events").select("event_id", F.when(r >= 0.9, "met").when(r >= 0.3, "partial").otherwise("not_met").alias("status"))


@query("a32_rubric_max", "SELECT l_orderkey, coalesce(sum(p_size), 1)::DOUBLE AS max_score FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def rubric_max(spark, d):
    sizes = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(sizes, "l_partkey", "left").groupBy("l_orderkey").agg(F.coalesce(F.sum("p_size"), F.lit(1)).cast("double").alias("max_score"))


@query("f31_refusals", "SELECT event_type AS reason, '未找到相关内容' AS label FROM (SELECT DISTINCT event_type FROM events)")
def refusals(spark, d):
    """Unknown reasons get the text for no results."""
    return read(spark, d, "events").select(F.col("event_type").alias("reason")).distinct().select("reason", text.refusal(F.col("reason"))["label"].alias("label"))


@query("f38_references", "SELECT source, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) AS refs FROM (SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 8) GROUP BY 1")
def references(spark, d):
    """The first eight of each source."""
    from pyspark.sql import Window as W

    first = read(spark, d, "documents").select("source", "doc_id").withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("n <= 8")
    return first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ", ").alias("refs"))

"""Question texts, built from parts, taken apart again; and small rules over cases, users and grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import numeric, text
from quarry.operators import evaluation, ingestion, learning, reports, retrieval
from quarry.plans.registry import query
from quarry.sources import tables
from quarry.sources.tables import read


def exam(spark, d):
    """A question of two options with its answer, score and knowledge point for each part; of every third, the answer is missing."""
    asked = F.concat(F.col("p_partkey").cast("string"), F.lit(". 选择 "), "p_name", F.lit(" A. "), "p_brand", F.lit(" B. "), "p_type")
    tail = F.concat(F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("\n答案："), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B"))).otherwise(""), F.lit("\n（"), F.col("p_size").cast("string"), F.lit("分） 知识点："), "p_brand")
    return read(spark, d, "part").select("p_partkey", asked.alias("asked"), F.concat(asked, tail).alias("t"))


@query("f15_question_starts", "SELECT p_partkey, TRUE AS starts, p_partkey::VARCHAR AS number FROM part")
def starts(spark, d):
    t = F.col("t")
    return exam(spark, d).select("p_partkey", t.rlike(text.QUESTION_START).alias("starts"), F.regexp_extract(t, text.QUESTION_NUMBER, 1).alias("number"))


@query("f17_options", "SELECT p_partkey, 'A=' || p_brand || '|B=' || p_type AS options FROM part")
def options(spark, d):
    each = F.transform(text.options(F.col("asked")), lambda o: F.concat(o["id"], F.lit("="), o["text"]))
    return exam(spark, d).select("p_partkey", F.array_join(each, "|").alias("options"))


@query("f18_stems", "SELECT p_partkey, p_partkey || '. 选择 ' || p_name AS stem FROM part")
def stems(spark, d):
    return exam(spark, d).select("p_partkey", text.clean_stem(F.col("asked")).alias("stem"))


@query("f19_answers", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS answer, CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0.95 END::DOUBLE AS confidence FROM part")
def answers(spark, d):
    t = F.col("t")
    return exam(spark, d).select("p_partkey", text.answer(t).alias("answer"), text.answer_confidence(t).alias("confidence"))


@query("p20_answer_reviews", "SELECT p_partkey, 'missing_answer' AS kind FROM part WHERE p_partkey % 3 = 0")
def answer_reviews(spark, d):
    t = F.col("t")
    found = exam(spark, d).select("p_partkey", ingestion.answer_review(text.answer(t), text.answer_confidence(t)).alias("kind"))
    return found.where("kind IS NOT NULL")


@query("f20_scores", "SELECT p_partkey, p_size::DOUBLE AS score FROM part")
def scores(spark, d):
    return exam(spark, d).select("p_partkey", text.score(F.col("t")).alias("score"))


@query("f21_hints", "SELECT p_partkey, p_brand AS hints FROM part")
def hints(spark, d):
    return exam(spark, d).select("p_partkey", F.array_join(text.hints(F.col("t")), ",").alias("hints"))


@query("f23_markdown_tables", "SELECT o_orderkey, '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_custkey || ' | ' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END || ' |' AS md FROM orders")
def markdown(spark, d):
    rows = F.array(F.array(F.lit("key"), F.lit("status")), F.array(F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))))
    return read(spark, d, "orders").select("o_orderkey", text.markdown_table(rows).alias("md"))


@query("f26_explicit_pages", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1,2' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '' END AS pages FROM orders")
def explicit_pages(spark, d):
    k = F.col("o_orderkey") % 4
    asked = F.concat(F.lit("请看"), F.when(k == 0, "前两页").when(k == 1, "第1页").when(k == 2, "第二页").otherwise("全文"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(retrieval.explicit_pages(asked), lambda p: p.cast("string")), ",").alias("pages"))


@query("f24_block_types", "SELECT event_id, CASE event_type WHEN 'view' THEN 'table' WHEN 'click' THEN 'formula' WHEN 'signup' THEN 'figure' ELSE 'text' END AS block_type FROM events")
def block_types(spark, d):
    raw = F.when(F.col("event_type") == "view", "table").when(F.col("event_type") == "click", "formula").when(F.col("event_type") == "signup", "image").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", ingestion.ocr_type(raw).alias("block_type"))


@query("m02_bm25_weights", "SELECT p_partkey, round_even(ln((1000 - p_size + 0.5::DOUBLE) / (p_size + 0.5::DOUBLE) + 1) * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * (p_size + 1.0::DOUBLE) / 20)), 9) AS score FROM part")
def bm25_weights(spark, d):
    n = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", F.bround(numeric.bm25(F.lit(3), n + 1, F.lit(20), numeric.bm25_weight(F.lit(1000), n)), 9).alias("score"))


@query("s22_upload_kinds", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'FILE_UNSUPPORTED_TYPE' END AS error FROM orders")
def upload_kinds(spark, d):
    """Names of five kinds, of which one is not taken; some files have no bytes, and some another declared type."""
    k = F.col("o_orderkey")
    content = F.when(k % 3 == 0, F.lit("").cast("binary")).otherwise(F.unhex(F.lit("255044462D")))
    name = F.concat(F.lit("a.b."), F.when(k % 5 == 4, "txt").otherwise("pdf"))
    declared = F.when(k % 7 == 0, "image/png").when(k % 7 == 1, "").otherwise("application/pdf")
    return read(spark, d, "orders").select("o_orderkey", tables.upload_error(name, content, declared).alias("error"))


@query("p23_evidence_marks", "SELECT doc_id, doc_id % 3 = 0 AS staff, doc_id % 2 = 0 AS denies, doc_id % 5 = 0 AS computes, doc_id % 7 = 0 AS looks FROM documents")
def evidence_marks(spark, d):
    k = F.col("doc_id")
    excerpt = F.concat(F.when(k % 3 == 0, "[答案] ").otherwise(""), F.when(k % 2 == 0, "并非如此").otherwise("x"))
    asked = F.concat(F.when(k % 5 == 0, "Compute it").otherwise("说"), F.when(k % 7 == 0, " 如图").otherwise(""))
    marks = [text.any_of(excerpt, retrieval.STAFF).alias("staff"), text.any_of(excerpt, retrieval.DENY).alias("denies"), text.any_of(F.lower(asked), retrieval.COMPUTE).alias("computes"), text.any_of(asked, retrieval.LOOK).alias("looks")]
    return read(spark, d, "documents").select("doc_id", *marks)


@query("p24_conflicts", "SELECT source, CASE WHEN count(*) >= 3 AND count_if(doc_id % 2 = 0) >= 2 AND count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN lang END) >= 2 THEN 'conflicting' ELSE 'sufficient' END AS reason FROM documents GROUP BY source")
def conflicts(spark, d):
    """A source as a query, its documents as evidence of a document for each language."""
    docs = read(spark, d, "documents")
    refs = docs.select(F.col("source").alias("query_id"), F.col("lang").alias("document_id"), F.when(F.col("doc_id") % 2 == 0, "相反").otherwise("x").alias("excerpt"), F.lit(1.0).alias("score"))
    asked = docs.select(F.col("source").alias("query_id"), F.lit("q").alias("query")).distinct()
    return retrieval.sufficiency(asked, refs).select(F.col("query_id").alias("source"), "reason")


@query("a31_step_totals", "SELECT l_orderkey, least(sum(least(greatest(l_quantity - 10, 0), p_size)), 60)::DOUBLE AS total, (count_if(l_quantity < 10 OR l_quantity - 10 > p_size) + CASE WHEN sum(least(greatest(l_quantity - 10, 0), p_size)) > 60 THEN 1 ELSE 0 END)::BIGINT AS violations FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def step_totals(spark, d):
    """An order as a paper, its lines as steps, a part's size as the step's maximum."""
    steps = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity") - 10).alias("score"))
    rubric = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("max_score"))
    return reports.step_totals(steps, rubric, ["l_orderkey"], "l_partkey", 60.0)


@query("a04_ratios", "SELECT n_nationkey, count_if(c_acctbal > 0 AND c_mktsegment = 'BUILDING') / nullif(count_if(c_mktsegment = 'BUILDING'), 0)::DOUBLE AS ratio FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def ratios(spark, d):
    """Null where a nation has no such customer."""
    building = F.col("c_mktsegment") == "BUILDING"
    joined = read(spark, d, "nation").join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_nationkey").agg(F.try_divide(F.count_if(building & (F.col("c_acctbal") > 0)), F.count_if(building)).alias("ratio"))


@query("a08_critical_cases", "SELECT lang, count_if(n_chars % 2 = 0)::BIGINT AS n, count_if(n_chars % 2 = 0) >= 20 AS enough FROM documents GROUP BY 1")
def critical(spark, d):
    n = F.count_if(F.col("n_chars") % 2 == 0)
    return read(spark, d, "documents").groupBy("lang").agg(n.alias("n"), (n >= 20).alias("enough"))


@query("f37_case_checks", r"SELECT doc_id, doc_id < 1000 AS good_id, length(text) BETWEEN 4 AND 300 AS good_length, regexp_matches(text, '[A-Za-z]:[\\/]') AS local_path FROM documents")
def case_checks(spark, d):
    t = F.col("text")
    case_id = F.concat(F.lit("db-"), F.lpad(F.col("doc_id").cast("string"), 3, "0"))
    whole = F.when(F.col("doc_id") < 1000, case_id).otherwise(F.concat(F.lit("db-"), F.col("doc_id").cast("string")))
    good_id, good_length, local_path = evaluation.case_format(whole, t)
    return read(spark, d, "documents").select("doc_id", good_id.alias("good_id"), good_length.alias("good_length"), local_path.alias("local_path"))


@query("d03_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('us', ts)::BIGINT % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS at FROM events")
def iso_times(spark, d):
    return read(spark, d, "events").select("event_id", text.iso_time(F.col("ts")).alias("at"))


@query("p11_lookups", "SELECT conv_id, count(*)::BIGINT AS turns, min(c_custkey)::BIGINT AS user_id FROM conversations JOIN customer ON c_custkey = conv_id AND c_acctbal > 0 WHERE role = 'user' GROUP BY 1")
def lookups(spark, d):
    """Sessions whose token hash is that of an active user: a customer with a balance."""
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("token_hash"), (F.col("c_acctbal") > 0).alias("active"))
    sessions = read(spark, d, "conversations").where("role = 'user'").select("conv_id", F.sha2(F.col("conv_id").cast("string"), 256).alias("token_hash"))
    return learning.active_sessions(sessions, users).groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("user_id").alias("user_id"))


@query("j24_graded_changes", "SELECT c.event_id, e.value / 500 AS ratio FROM (SELECT event_id, event_id * 2 AS source FROM events) c JOIN events e ON e.event_id = c.source WHERE e.event_type <> 'error'")
def graded_changes(spark, d):
    """A change log whose source grade is the event of twice the number; errors have no score."""
    events = read(spark, d, "events")
    log = events.select("event_id", (F.col("event_id") * 2).alias("source_grade_id"))
    grades = events.select(F.col("event_id").alias("grade_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("total_score"), F.lit(500.0).alias("max_score"))
    return learning.score_ratios(log, grades).select("event_id", "ratio")


@query("x12_trainings", "SELECT o_custkey, count(*)::BIGINT AS n_questions FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 3")
def trainings(spark, d):
    return learning.trainings(read(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_custkey"]).select("o_custkey", "n_questions")


@query("k09_retries", "SELECT o_orderkey, 'queued' AS status, o_custkey % 4 AS attempts FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 < 3")
def retries(spark, d):
    """Orders as jobs: finished ones count as failed, with up to three attempts."""
    jobs = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("running").alias("status"), (F.col("o_custkey") % 4).alias("attempts"))
    return reports.retried(jobs, most=3).where("status = 'queued'").select("o_orderkey", "status", "attempts")


@query("p15_mistakes", "SELECT event_id, value / 500 < 0.8 OR event_type = 'error' AS mistake FROM events")
def mistakes(spark, d):
    return read(spark, d, "events").select("event_id", learning.is_mistake(F.col("value") / 500, F.col("event_type") == "error").alias("mistake"))

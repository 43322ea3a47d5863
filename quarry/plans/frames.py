"""Frames that the registered queries derive from the fixture tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import STOP_WORDS
from quarry.operators import evaluation
from quarry.sources.tables import read


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


TOKEN_SQL = r"'([\x{4e00}-\x{9fff}]{2,}|[a-zA-Z0-9]+)'"


def sql_tokens(column: str) -> str:
    stop = sql_list(list(dict.fromkeys(STOP_WORDS)))
    return f"list_transform(list_filter(regexp_extract_all({column}, {TOKEN_SQL}, 1), lambda t: length(t) >= 2 AND NOT list_contains({stop}, t)), lambda t: lower(t))"


# ---- retrieval: a document is a chunk, a benchmark item a query


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("text").alias("content"), "lang", "n_chars")
    toxic = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"), F.lit("staff_only").alias("visibility"))
    return docs.join(toxic, "chunk_id", "left").withColumn("visibility", F.coalesce("visibility", F.lit("public")))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark item; its embedding is that with the same id."""
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(vectors, "query_id", "left")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of chunks: those with the id of a document."""
    ids = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(ids, "chunk_id", "left_semi")


CHUNKS_SQL = "chunks AS (SELECT d.doc_id AS chunk_id, d.source AS document_id, d.text AS content, d.lang, d.n_chars, CASE WHEN l.toxic = 1 THEN 'staff_only' ELSE 'public' END AS visibility FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id)"
BM25_SQL = f"""
{CHUNKS_SQL},
toks AS (SELECT chunk_id, {sql_tokens('content')} AS ts FROM chunks),
stats AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len(ts)), 1.0) AS mean FROM toks),
post AS (SELECT chunk_id, token, count(*)::DOUBLE AS tf, any_value(dl)::DOUBLE AS dl FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS token FROM toks) GROUP BY chunk_id, token),
df AS (SELECT token, count(*)::DOUBLE AS df FROM post GROUP BY token),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS token FROM benchmark) GROUP BY query_id, token),
bm25 AS (SELECT query_id, chunk_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score
  FROM qt JOIN post USING (token) JOIN df USING (token), stats GROUP BY query_id, chunk_id HAVING score > 0),
words AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score, 6) DESC, chunk_id) AS rank FROM bm25 QUALIFY rank <= 20)
"""
COSINE_SQL = """
cosine AS (SELECT q.item_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents)),
near AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score, 6) DESC, chunk_id) AS rank FROM cosine QUALIFY rank <= 20)
"""
FUSED_SQL = "fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM near UNION ALL SELECT query_id, chunk_id, rank FROM words) GROUP BY query_id, chunk_id)"


# ---- evaluation: a document is a case, a label its result, a conversation's turns its annotations


def cases(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    behavior = F.when(n % 7 == 0, "refuse").when(n % 7 == 1, "grade").otherwise("answer")
    pages = F.when(n % 3 > 0, F.array(F.struct(F.col("source").alias("document_id"), F.sequence(F.lit(1), (n % 3).cast("int")).alias("pages")))).otherwise(F.array().cast("array<struct<document_id:string,pages:array<int>>>"))
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("category"), behavior.alias("expected_behavior"), (n % 2 == 0).alias("critical"), behavior.alias("scoring_policy"),
        pages.alias("expected_evidence"), "source", "text", n.alias("n_chars"),
    )


def results(spark: SparkSession, d: str) -> DataFrame:
    source = read(spark, d, "documents").select("doc_id", "source")
    hit = F.array(F.struct(F.col("source").alias("document_id"), (F.col("quality") + 1).alias("page")), F.struct(F.lit(None).cast("string").alias("document_id"), F.lit(1).alias("page")), F.struct(F.lit("src0").alias("document_id"), F.lit(2).alias("page")))
    return read(spark, d, "labels").join(source, "doc_id").select(
        F.col("doc_id").alias("case_id"), F.when(F.col("toxic") == 1, "refuse").otherwise("answer").alias("actual_behavior"), hit.alias("retrieved_evidence"),
        (F.col("quality") * 100 + F.col("doc_id") % 97).cast("double").alias("latency_ms"),
    )


def annotations(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    one = lambda k: F.when((n + k) % 5 == 0, "fail").when((n + k) % 5 == 1, "na").otherwise("pass")
    judged = F.create_map(F.lit("answer"), one(0), F.lit("citation"), one(1), F.lit("refusal"), one(2), F.lit("grading"), one(3))
    return read(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("role").alias("annotator_id"), F.col("turn").alias("seq"), judged.alias("judgments"))


def arbitrations(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.length("text") % 2 == 0, "pass").otherwise("fail")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.lit("answer").alias("metric"), verdict.alias("judgment"), F.lit(0).alias("seq"))


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(evaluation.POLICY_DIMENSIONS.items()), "scoring_policy string, dimensions array<string>")


def hits(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evidence_hits(cases(spark, d), results(spark, d))


def states(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.annotation_states(cases(spark, d), results(spark, d), annotations(spark, d), arbitrations(spark, d), policies(spark))


_PASS = lambda k: f"CASE (length(text) + {k}) % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'na' ELSE 'pass' END"
EVALUATION_SQL = f"""
cases AS (SELECT doc_id AS case_id, lang AS category, CASE n_chars % 7 WHEN 0 THEN 'refuse' WHEN 1 THEN 'grade' ELSE 'answer' END AS expected_behavior, n_chars % 2 = 0 AS critical, source, n_chars FROM documents),
expected AS (SELECT case_id, source AS document_id, unnest(generate_series(1, n_chars % 3)) AS page FROM cases),
results AS (SELECT l.doc_id AS case_id, CASE WHEN toxic = 1 THEN 'refuse' ELSE 'answer' END AS actual_behavior, source, quality, (quality * 100 + l.doc_id % 97)::DOUBLE AS latency_ms FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
retrieved AS (SELECT DISTINCT case_id, document_id, page FROM (SELECT case_id, source AS document_id, quality + 1 AS page FROM results UNION ALL SELECT case_id, 'src0', 2 FROM results)),
matched AS (SELECT case_id, count(*) AS n FROM (SELECT DISTINCT * FROM expected) JOIN retrieved USING (case_id, document_id, page) GROUP BY case_id),
hits AS (SELECT c.case_id, category, expected_behavior, actual_behavior, (n_chars % 3)::INT AS n_expected, coalesce(m.n, 0)::INT AS n_matched, expected_behavior = actual_behavior AS behaves
  FROM cases c JOIN results r ON r.case_id = c.case_id LEFT JOIN matched m ON m.case_id = c.case_id),
ann AS (SELECT conv_id AS case_id, role AS annotator_id, turn AS seq, unnest([{{'metric': 'answer', 'j': {_PASS(0)}}}, {{'metric': 'citation', 'j': {_PASS(1)}}}, {{'metric': 'grading', 'j': {_PASS(3)}}}]) AS x FROM conversations),
votes AS (SELECT case_id, metric, count(*) AS voters, min(j) AS low, max(j) AS high FROM
  (SELECT case_id, annotator_id, x.metric AS metric, arg_max(x.j, seq) AS j FROM ann WHERE x.j IN ('pass', 'fail') GROUP BY ALL) GROUP BY ALL),
arb AS (SELECT item_id AS case_id, 'answer' AS metric, CASE length(text) % 2 WHEN 0 THEN 'pass' ELSE 'fail' END AS settled FROM benchmark),
pol AS (SELECT * FROM (VALUES ('answer', 'answer'), ('answer', 'citation'), ('grade', 'grading')) t(expected_behavior, metric)),
states AS (SELECT case_id, metric, critical, CASE WHEN actual_behavior <> expected_behavior THEN 'misbehaved'
    WHEN coalesce(voters, 0) < CASE WHEN critical THEN 2 ELSE 1 END THEN 'incomplete' WHEN low <> high AND settled IS NULL THEN 'disagreement'
    WHEN low <> high THEN 'arbitrated_' || settled ELSE low END AS state
  FROM cases c JOIN pol USING (expected_behavior) LEFT JOIN (SELECT case_id, actual_behavior FROM results) r USING (case_id)
  LEFT JOIN votes USING (case_id, metric) LEFT JOIN arb USING (case_id, metric))
"""
_NAMES = "CASE metric WHEN 'answer' THEN 'answer_accuracy' WHEN 'citation' THEN 'citation_accuracy' ELSE 'grading_agreement' END"
METRICS_SQL = f"""
metrics AS (SELECT {_NAMES} AS metric, count_if(state IN ('pass', 'arbitrated_pass'))::DOUBLE AS numerator, count_if(state <> 'incomplete')::BIGINT AS denominator FROM states GROUP BY metric
  UNION ALL SELECT 'recall_at_5', coalesce(sum(CASE WHEN n_expected > 0 THEN n_matched / n_expected::DOUBLE END), 0), count_if(n_expected > 0) FROM hits
  UNION ALL SELECT 'refusal_accuracy', count_if(expected_behavior = 'refuse' AND behaves), count_if(expected_behavior = 'refuse') FROM hits),
few AS (SELECT c.case_id FROM cases c LEFT JOIN (SELECT conv_id AS case_id, count(DISTINCT role) AS n FROM conversations GROUP BY 1) a USING (case_id) WHERE critical AND coalesce(n, 0) < 2),
missing_ann AS (SELECT case_id FROM states WHERE state = 'incomplete' UNION SELECT case_id FROM few),
missing_res AS (SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM results))
"""


# ---- learning: an event is a graded submission, its type the knowledge point


def submissions(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.least(F.lit(1.0), F.col("value") / 500)
    return read(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("point"), ratio.alias("ratio"), "value")


SUBMISSIONS_SQL = "sub AS (SELECT event_id, user_id, ts, event_type AS point, least(1.0::DOUBLE, value / 500) AS ratio, value FROM events)"

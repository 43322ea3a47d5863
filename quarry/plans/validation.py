"""Rules and JSON as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import jsons
from quarry.operators import validation as V
from quarry.plans import frames
from quarry.plans.registry import query
from quarry.sources.tables import read


@query("d12_case_rules", """SELECT case_id, unnest(list_filter([
  CASE WHEN NOT regexp_matches(case_id, '^db-\\d{3}$') THEN 'invalid_case_id' END, CASE WHEN length(text) < 4 OR length(text) > 300 THEN 'query_length' END,
  CASE WHEN regexp_matches(text, '[A-Za-z]:[\\\\/]') THEN 'query_has_path' END, CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'unknown_source' END,
  CASE WHEN n = 0 THEN 'evidence_missing' END, CASE WHEN n = 2 AND source IN ('src0', 'src1') THEN 'page_beyond_limit' END,
  CASE WHEN n_chars % 7 = 1 THEN 'unknown_policy' END], lambda x: x IS NOT NULL)) AS error FROM (SELECT 'db-' || doc_id AS case_id, *, n_chars % 3 AS n FROM documents)""")
def case_rules(spark, d):
    """Documents as cases; policies for answers and refusals only."""
    from pyspark.sql import types as T

    cases = frames.cases(spark, d).select(
        F.concat(F.lit("db-"), F.col("case_id").cast("string")).alias("case_id"), F.col("text").alias("query"), F.array("category").alias("tags"), F.array("source").alias("source_scope"), "expected_evidence",
        F.lit("any").alias("evidence_match"), "scoring_policy", "expected_behavior", F.lit("qa").alias("mode"), F.lit(None).cast(T.StringType()).alias("student_answer"),
    )
    policies = spark.createDataFrame([("answer", ["answer"]), ("refuse", ["refuse"])], "scoring_policy string, applies_to array<string>")
    return V.case_errors(cases, policies, {"src0": 1, "src1": 1, "src2": 10})


@query("a06_distribution", "WITH g AS (SELECT lang AS category, count(*) AS got FROM documents GROUP BY 1), w AS (SELECT * FROM (VALUES ('en', 100), ('xx', 3)) t(category, want)) SELECT category AS detail FROM g FULL JOIN w USING (category) WHERE coalesce(want, 0) <> coalesce(got, 0)")
def distribution(spark, d):
    cases = frames.cases(spark, d).withColumn("tags", F.array("source"))
    return V.set_errors(cases, {"en": 100, "xx": 3}, []).where("error = 'distribution'").select("detail")


@query("a07_tag_coverage", "SELECT t AS detail FROM (VALUES ('src0'), ('nowhere')) v(t) WHERE t NOT IN (SELECT source FROM documents)")
def coverage(spark, d):
    cases = frames.cases(spark, d).withColumn("tags", F.array("source"))
    return V.set_errors(cases, {}, ["src0", "nowhere"]).where("error = 'missing_tag'").select("detail")


@query("d13_result_rules", "SELECT doc_id AS case_id, 'unknown_case' AS error FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def result_rules(spark, d):
    cases = read(spark, d, "benchmark").select(F.col("item_id").alias("case_id"))
    return V.result_errors(frames.results(spark, d), cases)


@query("d13_annotation_rules", "SELECT conv_id AS case_id, 'duplicate_annotation' AS error FROM conversations GROUP BY conv_id, role HAVING count(*) > 1 UNION ALL SELECT conv_id, 'unknown_case' FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents)")
def annotation_rules(spark, d):
    return V.annotation_errors(frames.annotations(spark, d), frames.cases(spark, d))


@query("p18_event_guards", "SELECT doc_id, unnest(list_filter([CASE WHEN length(text) > 2000 THEN 'summary_too_long' END, CASE WHEN length(text) > 300 THEN 'excerpt_too_long' END, CASE WHEN lang <> 'en' THEN 'unknown_type' END], lambda x: x IS NOT NULL)) AS error FROM documents")
def event_guards(spark, d):
    refs = F.array(F.struct(F.col("text").alias("excerpt")))
    return read(spark, d, "documents").select("doc_id", F.explode(V.event_errors(F.col("text"), refs, F.col("lang"), ["en"])).alias("error"))


_REPLY = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'It is ' || props || ' so' ELSE 'none {' END"


def _replies(spark, d):
    p, n = F.col("props"), F.col("event_id") % 4
    reply = F.when(n == 0, p).when(n == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(n == 2, F.concat(F.lit("It is "), p, F.lit(" so"))).otherwise("none {")
    return read(spark, d, "events").select("event_id", reply.alias("reply"))


@query("d09_json_repair", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props->>'k')::BIGINT END AS k FROM events")
def json_repair(spark, d):
    return _replies(spark, d).select("event_id", jsons.at_path(jsons.repaired(F.col("reply")), "$.k", "long").alias("k"))


@query("d10_json_path", "SELECT event_id, (props->>'k')::BIGINT AS k, 'none' AS missing FROM events")
def json_path(spark, d):
    return read(spark, d, "events").select("event_id", jsons.at_path(F.col("props"), "$.k", "long").alias("k"), jsons.at_path(F.col("props"), "$.a.b", "string", "none").alias("missing"))


_PUBLIC = "json_object('id', event_id, 'data', json_object('type', event_type, CASE WHEN event_type = 'error' THEN 'Rubric' ELSE 'note' END, 'a \"rubric\": b'))"


def _public(spark, d):
    key = F.when(F.col("event_type") == "error", "Rubric").otherwise("note")
    data = F.map_from_arrays(F.array(F.lit("type"), key), F.array(F.col("event_type"), F.lit('a "rubric": b')))
    return read(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), data.alias("data"))).alias("body"))


@query("d05_forbidden_keys", "SELECT event_id, event_type = 'error' AS forbidden FROM events")
def forbidden(spark, d):
    return _public(spark, d).select("event_id", jsons.has_key(F.col("body")).alias("forbidden"))


@query("d07_privacy_leaks", "SELECT event_id, CASE WHEN event_type = 'error' THEN '$.data.Rubric' ELSE '' END AS paths FROM events")
def privacy(spark, d):
    return _public(spark, d).select("event_id", F.array_join(jsons.leaks(F.col("body")), ",").alias("paths"))


SCHEMA = {"type": "object", "required": ["k", "z"], "properties": {"k": {"type": ["integer", "null"], "minimum": 10, "maximum": 90}}}


@query("d08_schema_errors", "SELECT event_id, unnest(list_filter(['$: z is missing', CASE WHEN (props->>'k')::INT < 10 THEN '$.k: breaks minimum' END, CASE WHEN (props->>'k')::INT > 90 THEN '$.k: breaks maximum' END], lambda x: x IS NOT NULL)) AS error FROM events")
def schema_errors(spark, d):
    return read(spark, d, "events").select("event_id", F.explode(jsons.schema_errors(F.col("props"), SCHEMA)).alias("error"))


@query("f35_canonical_keys", "SELECT event_id, sha256('{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}') AS cache_key FROM events")
def canonical(spark, d):
    return read(spark, d, "events").select("event_id", F.sha2(jsons.canonical(F.col("event_type").alias("kind"), F.col("user_id").alias("user")), 256).alias("cache_key"))


@query("s04_damaged_packets", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE conv_id::VARCHAR END AS case_id, turn % 3 = 1 AS recovered FROM conversations")
def damaged(spark, d):
    """Packets as JSON lines, of which some are damaged before their judgments, some throughout."""
    from quarry.sources.tables import parsed_packet

    head = F.format_string('{"case_id": "%d", "annotator_id": "%s", ', "conv_id", "role")
    tail = F.lit('"judgments": {"answer": "pass"}, "notes": ""}')
    n = F.col("turn") % 3
    line = F.when(n == 0, F.concat(head, tail)).when(n == 1, F.concat(head, F.lit('"context": "broken ", '), F.lit('x", '), tail)).otherwise("{no packet")
    got = read(spark, d, "conversations").select("conv_id", "turn", parsed_packet(line).alias("p"))
    return got.select("conv_id", "turn", F.col("p.packet.case_id").alias("case_id"), F.col("p.recovered").alias("recovered"))


@query("a34_packet_summary", "SELECT count(*)::BIGINT AS n, count_if(turn % 3 = 1)::BIGINT AS recovered FROM conversations")
def packet_summary(spark, d):
    return damaged(spark, d).agg(F.count("*").alias("n"), F.count_if("recovered").alias("recovered"))

"""Evaluation queries over derived cases, results and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import evaluation as V
from quarry.operators import ordered, reports
from quarry.plans import frames
from quarry.plans.frames import EVALUATION_SQL, METRICS_SQL
from quarry.plans.registry import query
from quarry.sources.tables import read

W = f"WITH {EVALUATION_SQL}"


@query("d14_expected_refs", f"{W} SELECT case_id, document_id, page::INT AS page FROM expected")
def expected_refs(spark, d):
    return frames.cases(spark, d).select("case_id", F.explode(V.expected_refs(F.col("expected_evidence"))).alias("r")).select("case_id", "r.document_id", "r.page")


@query("j06_evidence_hits", f"{W} SELECT * FROM hits")
def evidence_hits(spark, d):
    return frames.hits(spark, d)


@query("a01_recall", f"{W} SELECT round_even(sum(CASE WHEN n_expected > 0 THEN n_matched / n_expected::DOUBLE END), 6) AS numerator, count_if(n_expected > 0)::BIGINT AS denominator FROM hits")
def recall(spark, d):
    return V.recall(frames.hits(spark, d)).select(F.bround("numerator", 6).alias("numerator"), "denominator")


@query("a02_behavior", f"{W} SELECT expected_behavior, count_if(behaves)::BIGINT AS numerator, count(*)::BIGINT AS denominator FROM hits GROUP BY 1")
def behavior(spark, d):
    return frames.hits(spark, d).groupBy("expected_behavior").agg(F.count_if("behaves").alias("numerator"), F.count("*").alias("denominator"))


@query("a03_annotation_states", f"{W} SELECT * FROM states")
def annotation_states(spark, d):
    return frames.states(spark, d)


@query("a03_annotation_metrics", f"{W} SELECT metric, count_if(state IN ('pass', 'arbitrated_pass'))::DOUBLE AS numerator, count_if(state <> 'incomplete')::BIGINT AS denominator, count_if(state = 'incomplete')::BIGINT AS incomplete, count_if(state = 'disagreement')::BIGINT AS disagreements, count_if(state LIKE 'arbitrated%')::BIGINT AS resolved FROM states GROUP BY metric")
def annotation_metrics(spark, d):
    return V.annotation_metrics(frames.states(spark, d))


@query("a11_by_category", f"{W} SELECT category, round_even(coalesce(sum(CASE WHEN n_expected > 0 THEN n_matched / n_expected::DOUBLE END), 0), 6) AS numerator, count_if(n_expected > 0)::BIGINT AS denominator, count_if(behaves)::BIGINT AS behaves, count(*)::BIGINT AS completed FROM hits GROUP BY ROLLUP (category)")
def by_category(spark, d):
    return V.recall_by_category(frames.hits(spark, d)).withColumn("numerator", F.bround("numerator", 6))


_GATE = "CASE metric WHEN 'recall_at_5' THEN 0.85 WHEN 'citation_accuracy' THEN 0.9 ELSE 0.8 END::DOUBLE"


@query("a13_gates", f"{W}, {METRICS_SQL} SELECT metric, round_even(numerator, 6) AS numerator, denominator::BIGINT AS denominator, round_even(numerator / nullif(denominator, 0), 6) AS value, {_GATE} AS threshold, numerator / nullif(denominator, 0) >= {_GATE} AS passed FROM metrics")
def gates(spark, d):
    found = V.gates(V.metrics(frames.hits(spark, d), frames.states(spark, d)))
    return found.withColumns({"numerator": F.bround("numerator", 6), "value": F.bround("value", 6)})


@query("a13_status", f"{W}, {METRICS_SQL} SELECT CASE WHEN (SELECT count(*) FROM missing_res) + (SELECT count(*) FROM missing_ann) + (SELECT count(*) FROM states WHERE state = 'disagreement') > 0 THEN 'INCOMPLETE' WHEN (SELECT bool_and(coalesce(numerator / nullif(denominator, 0) >= {_GATE}, false)) FROM metrics) THEN 'PASS' ELSE 'FAIL' END AS status")
def status(spark, d):
    states = frames.states(spark, d)
    return V.status(frames.cases(spark, d), frames.results(spark, d), frames.annotations(spark, d), states, V.gates(V.metrics(frames.hits(spark, d), states)))


@query("a14_critical_annotators", f"{W}, {METRICS_SQL} SELECT case_id FROM few")
def critical(spark, d):
    n = frames.annotations(spark, d).groupBy("case_id").agg(F.count_distinct("annotator_id").alias("n"))
    return frames.cases(spark, d).where("critical").join(n, "case_id", "left").where(F.coalesce("n", F.lit(0)) < 2).select("case_id")


@query("u04_missing_annotations", f"{W}, {METRICS_SQL} SELECT case_id FROM missing_ann")
def missing_annotations(spark, d):
    return V.missing_annotations(frames.cases(spark, d), frames.annotations(spark, d), frames.states(spark, d))


@query("j25_missing_results", f"{W}, {METRICS_SQL} SELECT case_id FROM missing_res")
def missing_results(spark, d):
    return V.missing_results(frames.cases(spark, d), frames.results(spark, d))


_RULES = f"""rules AS (SELECT 1 AS rule, case_id, 'missing_result' AS metric FROM missing_res UNION ALL SELECT 2, case_id, 'annotation' FROM missing_ann
  UNION ALL SELECT DISTINCT 3, case_id, 'annotation' FROM states WHERE state = 'disagreement'
  UNION ALL SELECT CASE metric WHEN 'answer' THEN 4 WHEN 'citation' THEN 5 ELSE 6 END, case_id, {frames._NAMES} FROM states WHERE state IN ('fail', 'arbitrated_fail', 'misbehaved')
  UNION ALL SELECT 7, case_id, 'recall_at_5' FROM hits WHERE n_expected > 0 AND n_matched = 0 UNION ALL SELECT 8, case_id, 'behavior' FROM hits WHERE NOT behaves)"""


def _defects(spark, d):
    return V.defects(frames.cases(spark, d), frames.results(spark, d), frames.annotations(spark, d), frames.states(spark, d), frames.hits(spark, d))


@query("a15_defects", f"{W}, {METRICS_SQL}, {_RULES} SELECT printf('EVAL-%03d', row_number() OVER (ORDER BY rule, case_id)) AS defect_id, case_id, metric, CASE WHEN rule <= 3 THEN 'blocker' ELSE 'major' END AS severity FROM rules")
def defects(spark, d):
    found = ordered.numbered(_defects(spark, d), ["rule", "case_id"], "n")
    return found.select(F.format_string("EVAL-%03d", "n").alias("defect_id"), "case_id", "metric", "severity")


@query("a12_defect_counts", f"{W}, {METRICS_SQL}, {_RULES} SELECT metric, count(*)::BIGINT AS n FROM rules GROUP BY metric")
def defect_counts(spark, d):
    return _defects(spark, d).groupBy("metric").agg(F.count("*").alias("n"))


@query("f36_metric_text", f"{W}, {METRICS_SQL} SELECT metric, CASE WHEN denominator = 0 THEN '—' ELSE printf('%.1f', round_even(100 * numerator / denominator, 1)) || '% (' || regexp_replace(printf('%.6f', numerator), '\\.?0+$', '') || '/' || denominator || ')' END AS shown FROM metrics WHERE metric <> 'recall_at_5'")
def metric_text(spark, d):
    found = V.metrics(frames.hits(spark, d), frames.states(spark, d)).where("metric <> 'recall_at_5'")
    return found.select("metric", text.metric_text(F.col("numerator"), F.col("denominator")).alias("shown"))


@query("a09_latency", "SELECT count(*)::BIGINT AS n, quantile_cont(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, list_sort(list(value))[1 + least((95 * count(*)) // 100, count(*) - 1)] AS p95_floor, max(value) AS most FROM events")
def latency(spark, d):
    return V.latency(read(spark, d, "events"), "value")


@query("a05_duplicate_keys", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL HAVING n > 1")
def duplicates(spark, d):
    from quarry.operators.validation import duplicate_keys

    return duplicate_keys(read(spark, d, "events"), "user_id", "event_type")


_PAIRS = "CASE WHEN lang IN ('en', 'fr') THEN ['B', 'E'] WHEN lang = 'de' THEN ['C', 'E'] ELSE CASE WHEN n_chars % 7 = 1 THEN ['C', 'B'] ELSE ['C', 'E'] END END"
_KIND = lambda c: F.create_map(*[F.lit(x) for x in ("en", "fact_qa", "fr", "visual", "de", "refusal", "es", "computation_short_answer")])[c]


def _assignments(spark, d):
    cases = frames.cases(spark, d)
    mode = F.when(F.col("expected_behavior") == "grade", "training").otherwise("qa")
    return cases.select("case_id", F.explode(reports.assigned(_KIND(F.col("category")), mode)).alias("annotator_id"))


@query("j08_assignments", f"SELECT doc_id AS case_id, unnest({_PAIRS}) AS annotator_id FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')")
def assignments(spark, d):
    return _assignments(spark, d)


@query("j09_assignment_gaps", f"""WITH e AS (SELECT doc_id AS case_id, unnest({_PAIRS}) AS annotator_id FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')),
g AS (SELECT conv_id AS case_id, CASE role WHEN 'user' THEN 'B' WHEN 'assistant' THEN 'E' ELSE 'C' END AS annotator_id, count(*) AS n FROM conversations GROUP BY ALL)
SELECT case_id, annotator_id, 'missing' AS problem FROM e ANTI JOIN g USING (case_id, annotator_id) UNION ALL SELECT case_id, annotator_id, 'unexpected' FROM g ANTI JOIN e USING (case_id, annotator_id)
UNION ALL SELECT case_id, annotator_id, 'duplicate' FROM g WHERE n > 1""")
def assignment_gaps(spark, d):
    who = F.when(F.col("role") == "user", "B").when(F.col("role") == "assistant", "E").otherwise("C")
    got = read(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), who.alias("annotator_id"))
    return reports.assignment_gaps(_assignments(spark, d), got, ["case_id", "annotator_id"])


def _percentiles_sql(key: str) -> str:
    return f"SELECT {key}, count(*)::BIGINT AS n, (v[(n0 - 1) // 2 + 1] + v[n0 // 2 + 1]) / 2 AS p50, v[greatest(1, (95 * n0 + 99) // 100)] AS p95, v[least(95 * n0 // 100, n0 - 1) + 1] AS p95_floor, v[n0] AS most FROM (SELECT {key}, list(value ORDER BY value) AS v, count(*) AS n0, unnest(list(value)) AS each FROM events WHERE value IS NOT NULL GROUP BY {key}) GROUP BY {key}, v, n0"


@query("a10_percentiles_by_type", _percentiles_sql("event_type"))
def percentiles_by_type(spark, d):
    return V.latency_by(read(spark, d, "events"), ["event_type"], "value")


@query("a10_percentiles_by_user", _percentiles_sql("user_id"))
def percentiles_by_user(spark, d):
    return V.latency_by(read(spark, d, "events"), ["user_id"], "value")

"""Quality metrics of annotated runs: recall, behaviour, annotations with arbitration, gates, defects.

Frames: cases (case_id, category, expected_behavior, critical, scoring_policy, expected_evidence
array<struct<document_id, pages>>), results (case_id, actual_behavior, retrieved_evidence
array<struct<document_id, page>>, latency_ms), annotations (case_id, annotator_id, seq,
judgments map<string, string>), arbitrations (case_id, metric, judgment, seq) and policies
(scoring_policy, dimensions). Of repeated keys the row with the largest seq counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import order_statistic, order_statistics

JUDGED = ("answer", "citation", "grading")
#: Metric names in reports and the annotated dimension behind each.
METRIC_OF = {"answer_accuracy": "answer", "citation_accuracy": "citation", "grading_agreement": "grading"}
GATES = {"recall_at_5": 0.85, "answer_accuracy": 0.80, "citation_accuracy": 0.90, "refusal_accuracy": 0.80, "grading_agreement": 0.80}
POLICY_DIMENSIONS = {"answer": ["answer", "citation"], "clarify": ["answer"], "flag_conflict": ["answer", "citation"], "refuse": ["refusal"], "grade": ["grading"]}


def last(frame: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: that with the largest seq."""
    others = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.max_by(F.struct(*others), "seq").alias("x")).select(*keys, "x.*")


def expected_refs(evidence: Column) -> Column:
    """Distinct document and page pairs of an evidence column."""
    each = F.transform(evidence, lambda e: F.transform(e["pages"], lambda p: F.struct(e["document_id"].alias("document_id"), p.cast("int").alias("page"))))
    return F.array_distinct(F.flatten(each))


def retrieved_refs(evidence: Column, k: int = 5) -> Column:
    """The first k hits; those without document or page are dropped after the cut."""
    return F.filter(F.slice(F.coalesce(evidence, F.array().cast("array<struct<document_id:string,page:int>>")), 1, k), lambda r: r["document_id"].isNotNull() & r["page"].isNotNull())


def evidence_hits(cases: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """Of each case with a result: n_expected, n_matched pages and whether the behaviour is the expected one."""
    found = results.select("case_id", "actual_behavior", retrieved_refs(F.col("retrieved_evidence"), k).alias("got"))
    pair = lambda a: F.transform(a, lambda r: F.struct(r["document_id"].alias("document_id"), r["page"].cast("int").alias("page")))
    joined = cases.withColumn("want", expected_refs(F.col("expected_evidence"))).join(found, "case_id")
    return joined.select(
        "case_id", "category", "expected_behavior", "actual_behavior", F.size("want").alias("n_expected"),
        F.size(F.array_intersect("want", pair(F.col("got")))).alias("n_matched"), F.col("expected_behavior").eqNullSafe(F.col("actual_behavior")).alias("behaves"),
    )


def _recall() -> list[Column]:
    has = F.col("n_expected") > 0
    return [F.coalesce(F.sum(F.when(has, F.col("n_matched") / F.col("n_expected"))), F.lit(0.0)).alias("numerator"), F.count_if(has).alias("denominator")]


def recall(hits: DataFrame) -> DataFrame:
    """One row: sum of the cases' shares of expected pages found, and the number of cases with any."""
    return hits.agg(*_recall())


def recall_by_category(hits: DataFrame) -> DataFrame:
    """Recall and behaviour for each category and, with a null category, overall: one pass."""
    behaves = [F.count_if("behaves").alias("behaves"), F.count("*").alias("completed")]
    return hits.rollup("category").agg(*_recall(), *behaves)


def behavior(hits: DataFrame, expected: str) -> DataFrame:
    of = F.col("expected_behavior") == expected
    return hits.agg(F.count_if(of & F.col("behaves")).cast("double").alias("numerator"), F.count_if(of).alias("denominator"))


def annotation_states(cases: DataFrame, results: DataFrame, annotations: DataFrame, arbitrations: DataFrame, policies: DataFrame) -> DataFrame:
    """case_id, metric, state of each case and judged dimension of its policy.

    States: misbehaved (the behaviour is wrong: fails first), incomplete (too few
    annotators: two for critical cases, else one), pass, fail, disagreement (not
    arbitrated), arbitrated_pass, arbitrated_fail.
    """
    asked = cases.join(F.broadcast(policies), "scoring_policy").select("case_id", "critical", "expected_behavior", F.explode("dimensions").alias("metric")).where(F.col("metric").isin(*JUDGED))
    judged = annotations.select("case_id", "annotator_id", "seq", F.explode("judgments").alias("metric", "judgment")).where(F.col("judgment").isin("pass", "fail") & F.col("annotator_id").isNotNull())
    votes = last(judged, "case_id", "metric", "annotator_id").groupBy("case_id", "metric").agg(F.count("*").alias("voters"), F.min("judgment").alias("low"), F.max("judgment").alias("high"))
    settled = last(arbitrations, "case_id", "metric").select("case_id", "metric", F.col("judgment").alias("settled"))
    all_ = asked.join(results.select("case_id", "actual_behavior"), "case_id", "left").join(votes, ["case_id", "metric"], "left").join(settled, ["case_id", "metric"], "left")
    state = (
        F.when(F.col("actual_behavior").isNotNull() & (F.col("actual_behavior") != F.col("expected_behavior")), "misbehaved")
        .when(F.coalesce("voters", F.lit(0)) < F.when(F.col("critical"), 2).otherwise(1), "incomplete")
        .when((F.col("low") != F.col("high")) & F.col("settled").isNull(), "disagreement")
        .when(F.col("low") != F.col("high"), F.concat(F.lit("arbitrated_"), F.col("settled")))
        .otherwise(F.col("low"))
    )
    return all_.select("case_id", "metric", "critical", state.alias("state"))


def annotation_metrics(states: DataFrame) -> DataFrame:
    """metric, numerator, denominator, and how many cases are incomplete, in disagreement or resolved by arbitration.

    Disagreements count in the denominator, incomplete cases don't.
    """
    s = F.col("state")
    return states.groupBy("metric").agg(
        F.count_if(s.isin("pass", "arbitrated_pass")).cast("double").alias("numerator"), F.count_if(s != "incomplete").alias("denominator"),
        F.count_if(s == "incomplete").alias("incomplete"), F.count_if(s == "disagreement").alias("disagreements"), F.count_if(s.startswith("arbitrated")).alias("resolved"),
    )


def metrics(hits: DataFrame, states: DataFrame) -> DataFrame:
    """metric, numerator, denominator of the five quality metrics."""
    name = F.create_map(*[F.lit(x) for pair in ((v, k) for k, v in METRIC_OF.items()) for x in pair])
    annotated = annotation_metrics(states).select(name[F.col("metric")].alias("metric"), "numerator", "denominator")
    own = [recall(hits).select(F.lit("recall_at_5").alias("metric"), "*"), behavior(hits, "refuse").select(F.lit("refusal_accuracy").alias("metric"), "*")]
    return reduce(DataFrame.unionByName, own, annotated)


def gates(found: DataFrame, thresholds: dict[str, float] = GATES) -> DataFrame:
    """metric, value (null without cases), threshold, passed (null counts as not passed in the status)."""
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("metric")]
    value = F.try_divide("numerator", "denominator")
    return found.select("metric", "numerator", "denominator", value.alias("value"), limit.alias("threshold"), (value >= limit).alias("passed"))


def missing_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    return cases.select("case_id").join(results.select("case_id"), "case_id", "left_anti")


def missing_annotations(cases: DataFrame, annotations: DataFrame, states: DataFrame) -> DataFrame:
    """Cases incomplete in any dimension, and critical cases with fewer than two annotators."""
    annotators = annotations.groupBy("case_id").agg(F.count_distinct("annotator_id").alias("n"))
    few = cases.where("critical").select("case_id").join(annotators, "case_id", "left").where(F.coalesce("n", F.lit(0)) < 2).select("case_id")
    return states.where("state = 'incomplete'").select("case_id").union(few).distinct()


def status(cases: DataFrame, results: DataFrame, annotations: DataFrame, states: DataFrame, gated: DataFrame) -> DataFrame:
    """One row: INCOMPLETE, PASS or FAIL."""
    missing = missing_results(cases, results).select(F.lit(1).alias("x")).unionAll(missing_annotations(cases, annotations, states).select(F.lit(1))).unionAll(states.where("state = 'disagreement'").select(F.lit(1)))
    gaps = missing.agg(F.count("*").alias("gaps"))
    passed = gated.agg(F.coalesce(F.min(F.coalesce(F.col("passed"), F.lit(False)).cast("int")), F.lit(0)).alias("ok"))
    return gaps.join(passed).select(F.when(F.col("gaps") > 0, "INCOMPLETE").when(F.col("ok") == 1, "PASS").otherwise("FAIL").alias("status"))  # two single rows


def defects(cases: DataFrame, results: DataFrame, annotations: DataFrame, states: DataFrame, hits: DataFrame) -> DataFrame:
    """rule, case_id, metric, severity: missing results and annotations, disagreements, failures, recall misses, misbehaviour; not yet numbered."""
    failed = F.col("state").isin("fail", "arbitrated_fail", "misbehaved")
    names = {v: k for k, v in METRIC_OF.items()}
    parts = [
        missing_results(cases, results).select(F.lit(1).alias("rule"), "case_id", F.lit("missing_result").alias("metric")),
        missing_annotations(cases, annotations, states).select(F.lit(2).alias("rule"), "case_id", F.lit("annotation").alias("metric")),
        states.where("state = 'disagreement'").select("case_id").distinct().select(F.lit(3).alias("rule"), "case_id", F.lit("annotation").alias("metric")),
        *[states.where(failed & (F.col("metric") == m)).select(F.lit(4 + i).alias("rule"), "case_id", F.lit(names[m]).alias("metric")) for i, m in enumerate(JUDGED)],
        hits.where("n_expected > 0 and n_matched = 0").select(F.lit(7).alias("rule"), "case_id", F.lit("recall_at_5").alias("metric")),
        hits.where(~F.col("behaves")).select(F.lit(8).alias("rule"), "case_id", F.lit("behavior").alias("metric")),
    ]
    severity = F.when(F.col("metric").isin("missing_result", "annotation"), "blocker").otherwise("major")
    return reduce(DataFrame.unionByName, parts).withColumn("severity", severity)


def latency(results: DataFrame, column: str = "latency_ms") -> DataFrame:
    """One row: n, p50 (median), p95 by nearest rank, p95_floor (the value at index int(0.95 n)), and the largest."""
    x = results.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, most = x.agg(F.count("*"), F.max("v")).first()
    schema = "n long, p50 double, p95 double, p95_floor double, most double"
    if not n:
        return x.sparkSession.createDataFrame([(0, None, None, None, None)], schema)
    at = lambda k: order_statistic(x, "v", k)
    p50 = (at((n - 1) // 2) + at(n // 2)) / 2
    return x.sparkSession.createDataFrame([(n, p50, at(max(0, -(-95 * n // 100) - 1)), at(min(95 * n // 100, n - 1)), most)], schema)


def latency_by(results: DataFrame, keys: list[str], column: str = "latency_ms") -> DataFrame:
    """keys, n, p50 (median), p95 by nearest rank, p95_floor (the value at index int(0.95 n)), and the largest, for each key at once."""
    places = {
        "low": (0.5, "(n - 1) div 2"), "high": (0.5, "n div 2"), "p95": (0.95, "greatest(0, (95 * n + 99) div 100 - 1)"), "p95_floor": (0.95, "least(95 * n div 100, n - 1)"), "most": (1.0, "n - 1"),
    }
    found = order_statistics(results, keys, column, places)
    return found.select(*keys, "n", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95", "p95_floor", "most")


def case_format(case_id: Column, query: Column) -> tuple[Column, Column, Column]:
    """Whether an id is db- with three digits, a query has 4 to 300 characters, and it holds a local absolute path."""
    return case_id.rlike(r"^db-\d{3}$"), F.length(query).between(4, 300), query.rlike(r"[A-Za-z]:[\\/]")

"""Rules over evaluation frames, each row's errors as an array and table-wide ones as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEHAVIORS = ["answer", "refuse", "clarify", "flag_conflict", "grade", "error"]
JUDGMENTS = ["pass", "fail", "na"]
DIMENSIONS = ["answer", "citation", "grading", "refusal"]


def broken(**rules: Column) -> Column:
    """Array of the names of the rules that hold (null: doesn't)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))


def case_errors(cases: DataFrame, policies: DataFrame, page_limits: dict[str, int], id_pattern: str = r"^db-\d{3}$") -> DataFrame:
    """case_id, error: the rules that single cases break."""
    scope, evidence = F.coalesce("source_scope", F.array().cast("array<string>")), F.coalesce("expected_evidence", F.array().cast("array<struct<document_id:string,pages:array<int>>>"))
    limits = F.create_map(*[F.lit(x) for kv in page_limits.items() for x in kv])
    twice = lambda a: F.size(F.array_distinct(a)) != F.size(a)
    n = F.length("query")
    judged = cases.join(F.broadcast(policies.select("scoring_policy", "applies_to")), "scoring_policy", "left")
    found = broken(
        invalid_case_id=~F.coalesce(F.col("case_id").rlike(id_pattern), F.lit(False)),
        query_length=F.coalesce((n < 4) | (n > 300), F.lit(True)),
        query_has_path=F.col("query").rlike(r"[A-Za-z]:[\\/]"),
        tags_not_unique=F.col("tags").isNull() | (F.size("tags") == 0) | twice(F.col("tags")),
        scope_not_unique=F.col("source_scope").isNull() | twice(F.col("source_scope")),
        unknown_source=F.size(F.array_except(scope, F.array(*map(F.lit, page_limits)))) > 0,
        evidence_not_none=(F.col("evidence_match") == "none") & (F.size(evidence) > 0),
        evidence_missing=F.col("evidence_match").isin("any", "all") & (F.size(evidence) == 0),
        invalid_match=~F.coalesce(F.col("evidence_match").isin("any", "all", "none"), F.lit(False)),
        evidence_outside_scope=F.exists(evidence, lambda e: ~F.array_contains(scope, e["document_id"])),
        invalid_pages=F.exists(evidence, lambda e: e["pages"].isNull() | (F.size(e["pages"]) == 0) | twice(e["pages"]) | F.exists(e["pages"], lambda p: p < 1)),
        page_beyond_limit=F.exists(evidence, lambda e: F.coalesce(F.exists(e["pages"], lambda p: p > limits[e["document_id"]]), F.lit(False))),
        unknown_policy=F.col("applies_to").isNull(),
        policy_does_not_apply=~F.array_contains("applies_to", F.col("expected_behavior")),
        training_needs_answer=(F.col("mode") == "training") & ((F.col("expected_behavior") != "grade") | F.col("student_answer").isNull()),
        qa_has_answer=(F.coalesce("mode", F.lit("")) != "training") & F.col("student_answer").isNotNull(),
    )
    return judged.select("case_id", F.explode(found).alias("error"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_errors(cases: DataFrame, expected: dict[str, int], tags: list[str], critical: int = 20) -> DataFrame:
    """error, detail: duplicate ids, categories whose number is not the expected one, missing tags, too few critical cases."""
    spark = cases.sparkSession
    wanted = spark.createDataFrame(list(expected.items()) or [], "category string, want long")
    counts = cases.groupBy("category").agg(F.count("*").alias("got"))
    distribution = counts.join(wanted, "category", "full").where(F.coalesce("want", F.lit(0)) != F.coalesce("got", F.lit(0))).select(F.lit("distribution").alias("error"), F.col("category").alias("detail"))
    twice = duplicate_keys(cases, "case_id").select(F.lit("duplicate_id").alias("error"), F.col("case_id").cast("string").alias("detail"))
    have = cases.select(F.explode("tags").alias("tag")).distinct()
    missing = spark.createDataFrame([(t,) for t in tags], "tag string").join(have, "tag", "left_anti").select(F.lit("missing_tag").alias("error"), F.col("tag").alias("detail"))
    few = cases.agg(F.count_if("critical").alias("n")).where(F.col("n") < critical).select(F.lit("few_critical").alias("error"), F.col("n").cast("string").alias("detail"))
    return distribution.unionByName(twice).unionByName(missing).unionByName(few)


def _unknown(df: DataFrame, cases: DataFrame, name: str) -> DataFrame:
    return df.join(cases.select("case_id").distinct(), "case_id", "left_anti").select("case_id", F.lit(name).alias("error"))


def result_errors(results: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, error."""
    own = results.select("case_id", F.explode(broken(invalid_behavior=~F.coalesce(F.col("actual_behavior").isin(BEHAVIORS), F.lit(False)))).alias("error"))
    twice = duplicate_keys(results, "case_id").select("case_id", F.lit("duplicate_result").alias("error"))
    return own.unionByName(twice).unionByName(_unknown(results, cases, "unknown_case"))


def annotation_errors(annotations: DataFrame, cases: DataFrame) -> DataFrame:
    keys, values = F.map_keys("judgments"), F.map_values("judgments")
    blank = F.trim(F.coalesce("annotator_id", F.lit(""))) == ""
    own = annotations.select("case_id", F.explode(broken(
        annotator_missing=blank,
        judgments_missing=~blank & F.col("judgments").isNull(),
        wrong_dimensions=~blank & (F.array_sort(keys) != F.array(*map(F.lit, DIMENSIONS))),
        invalid_judgment=~blank & F.exists(values, lambda v: ~F.coalesce(v.isin(JUDGMENTS), F.lit(False))),
    )).alias("error"))
    twice = duplicate_keys(annotations.where(~blank), "case_id", "annotator_id").select("case_id", F.lit("duplicate_annotation").alias("error"))
    return own.unionByName(twice).unionByName(_unknown(annotations, cases, "unknown_case"))


def arbitration_errors(arbitrations: DataFrame, cases: DataFrame) -> DataFrame:
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    own = arbitrations.select("case_id", F.explode(broken(
        invalid_metric=~F.coalesce(F.col("metric").isin("answer", "citation", "grading"), F.lit(False)), arbiter_missing=empty("arbiter_id"),
        invalid_judgment=~F.coalesce(F.col("judgment").isin("pass", "fail"), F.lit(False)), reason_missing=empty("reason"),
    )).alias("error"))
    twice = duplicate_keys(arbitrations, "case_id", "metric").select("case_id", F.lit("duplicate_arbitration").alias("error"))
    return own.unionByName(twice).unionByName(_unknown(arbitrations, cases, "unknown_case"))


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """run_id, error, of manifests with string and map columns."""
    text = {f"{c}_missing": F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("run_id", "created_at", "code_commit", "material_commit")}
    maps = {f"{c}_missing": F.col(c).isNull() for c in ("models", "prompt_versions", "retrieval_parameters", "environment")}
    return manifests.select("run_id", F.explode(broken(**text, **maps)).alias("error"))


# Kinds of events.
EVENT_TYPES = ["run.started", "agent.started", "agent.summary", "agent.completed", "run.waiting_user", "run.completed", "run.failed", "heartbeat"]


def event_errors(summary: Column, refs: Column, kind: Column, kinds: list[str] = EVENT_TYPES) -> Column:
    """What an event breaks of the size bounds: summary up to 2,000 characters, 20 references, excerpts up to 300, a known type."""
    return broken(
        summary_too_long=F.length(summary) > 2000, too_many_refs=F.size(refs) > 20, excerpt_too_long=F.exists(refs, lambda r: F.length(r["excerpt"]) > 300),
        unknown_type=~F.coalesce(kind.isin(kinds), F.lit(False)),
    )

"""Relational reports: sessions, progress, mistakes, jobs, references, pages of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import newest

FULL_SCORE = 10.0


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a list; ``order`` ends with a key, so that pages don't overlap."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, size: int = 20, *by: str) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*by).agg(n.alias("total"), F.greatest(F.lit(1).cast("long"), F.ceil(n / size)).alias("total_pages"))


def first_unanswered(items: DataFrame, answers: DataFrame, session: str, item: str, order: str) -> DataFrame:
    """Each session's first item without an answer."""
    open_ = items.join(answers.select(session, item).distinct(), [session, item], "left_anti")
    return open_.groupBy(session).agg(F.min_by(item, F.struct(order, item)).alias(item), F.min(order).alias(order))


def dangling(references: DataFrame, targets: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose reference has no target; rows without a reference are fine."""
    return references.where(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def session_totals(graded: DataFrame, session: str, score: Column, full: float = FULL_SCORE) -> DataFrame:
    """Items, total and largest possible score, and the ratio (0 without items) of each session."""
    total, most = F.sum(score), F.count("*") * full
    return graded.groupBy(session).agg(F.count("*").alias("items"), total.alias("total"), most.alias("max_total"), F.coalesce(F.try_divide(total, most), F.lit(0.0)).alias("ratio"))


def progress(items: DataFrame, session: str, done: Column, target: Column | None = None) -> DataFrame:
    """completed of total, the next item's place from 0, and whether the session is finished."""
    n = F.count("*") if target is None else F.max(target)
    return items.groupBy(session).agg(n.alias("total"), F.count_if(done).alias("completed")).withColumns({"pointer": F.least("completed", "total"), "finished": F.col("completed") >= F.col("total")})


def mastery_change(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Level before the first and after the last change of each key."""
    return log.groupBy(*keys).agg(F.min_by("before_level", order).alias("first_before"), F.max_by("after_level", order).alias("last_after"))


def mistakes(graded: DataFrame, keys: list[str], order: list[str], ratio: str, uncertain: Column | None = None, high: float = 0.8) -> DataFrame:
    """The mistake book: of rows below ``high`` or uncertain, the count, first and last time, and last ratio of each key. Later good scores leave entries pending."""
    wrong = F.col(ratio) < high
    bad = graded.where(wrong if uncertain is None else wrong | F.coalesce(uncertain, F.lit(False)))
    place = F.struct(*order)
    return bad.groupBy(*keys).agg(F.count("*").alias("error_count"), F.min(place)[order[0]].alias("first_error_at"), F.max(place)[order[0]].alias("last_error_at"), F.max_by(ratio, place).alias("last_ratio"))


def with_latest(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each left row with the newest right row of its key, if any."""
    return left.join(newest(right, [key], order), key, "left")


def step_totals(steps: DataFrame, rubric: DataFrame, paper: list[str], item: str, cap: float) -> DataFrame:
    """For each paper the total of step scores, each within its rubric's bounds, the total within ``cap``; and how many steps break a bound or have no rubric."""
    joined = steps.join(rubric, item, "left")
    known = F.col("max_score").isNotNull()
    bounded = F.when(known, F.least(F.greatest(F.col("score"), F.lit(0.0)), F.col("max_score")))
    total = F.coalesce(F.sum(bounded), F.lit(0.0))
    bad = ~known | (F.col("score") < 0) | (F.col("score") > F.col("max_score"))
    return joined.groupBy(*paper).agg(F.least(total, F.lit(cap)).alias("total"), (F.count_if(bad) + (total > cap).cast("long")).alias("violations"))


def fake_grade(rubric: Column, score: Column) -> Column:
    """Step scores that share a score evenly over a rubric, with a status by the score's share of the whole."""
    most = F.aggregate(rubric, F.lit(0.0), lambda s, r: s + r["max_score"])
    status = F.when(most == 0, "not_met").when(score / most >= 0.9, "met").when(score / most >= 0.3, "partial").otherwise("not_met")
    return F.transform(rubric, lambda r: F.struct(r["id"].alias("rubric_item_id"), status.alias("status"), (score / F.size(rubric)).alias("score")))


def fake_questions(sessions: DataFrame, stems: list[str], kinds: list[str], least: int = 3) -> DataFrame:
    """``count`` rows for each session, with stems and kinds in turn; sessions with fewer than ``least`` get none."""
    nth = sessions.where(F.col("count") >= least).withColumn("order_no", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    turn = lambda xs: F.element_at(F.array(*map(F.lit, xs)), ((F.col("order_no") - 1) % len(xs) + 1).cast("int"))
    return nth.withColumns({"stem": turn(stems), "question_type": turn(kinds), "item_id": F.concat(F.lit("q-"), F.left(F.col("session_id").cast("string"), F.lit(8)), F.lit("-"), F.col("order_no").cast("string"))})


# Which status may follow which.
JOB_MOVES = {"pending": ["running"], "running": ["succeeded", "failed_retryable", "failed_permanent"], "failed_retryable": ["pending"], "failed_permanent": [], "succeeded": []}
RUN_MOVES = {"queued": ["running"], "running": ["completed", "failed", "cancelled"], "failed": ["queued"], "completed": [], "cancelled": []}


def bad_moves(log: DataFrame, keys: list[str], order: list[str], status: str = "status", moves: dict[str, list[str]] = JOB_MOVES, stay: bool = True) -> DataFrame:
    """Steps of a status log that the table of moves doesn't have; with ``stay`` a repeated status is fine."""
    from pyspark.sql import Window as W

    allowed = F.create_map(*[x for k, v in moves.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    before = F.lag(status).over(W.partitionBy(*keys).orderBy(*order))
    steps = log.withColumn("before", before).where("before is not null")
    fine = F.coalesce(F.array_contains(allowed[F.col("before")], F.col(status)), F.lit(False))
    return steps.where(~(fine | (F.col("before") == F.col(status)) if stay else fine))


def bad_progress(log: DataFrame, keys: list[str], order: list[str], value: str = "progress") -> DataFrame:
    """Steps that go back or leave 0 to 100."""
    from pyspark.sql import Window as W

    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return log.withColumn("before", before).where((F.col(value) < 0) | (F.col(value) > 100) | (F.col(value) < F.col("before")))


def error_kind(name: Column, message: Column) -> Column:
    """Whether a job's error may be retried."""
    m = F.lower(F.coalesce(message, F.lit("")))
    lasting = name.isin("ValueError", "FileNotFoundError", "FileValidationError") | m.contains("unsupported") | m.contains("corrupt") | m.contains("format")
    return F.when(F.coalesce(lasting, F.lit(False)), "failed_permanent").otherwise("failed_retryable")


def after_failure(kind: Column, attempts: Column, most_retries: int = 2) -> Column:
    return F.when(attempts > most_retries, "failed_permanent").otherwise(kind)


def recovered_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has run out are pending again."""
    stale = (F.col("status") == "running") & (F.col("lease_until") < now)
    return jobs.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "lease_until": F.when(~stale, F.col("lease_until"))})


def claimable(jobs: DataFrame, most: int = 1) -> DataFrame:
    """The oldest pending jobs."""
    return jobs.where("status = 'pending'").orderBy("created_at", "job_id").limit(most)


def first_requests(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Idempotent requests: the first of each key is carried out; ``replays`` counts the others."""
    others = [c for c in log.columns if c not in (*keys, *order)]
    return log.groupBy(*keys).agg(F.min(F.struct(*order, *others)).alias("__r"), (F.count("*") - 1).alias("replays")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in [*order, *others]], "replays")


def assigned(category: Column, mode: Column) -> Column:
    """The two annotators of a case."""
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return (
        F.when(category.isin("fact_qa", "visual"), pair("B", "E")).when(category == "refusal", pair("C", "E")).when(category == "cross_knowledge", pair("B", "C"))
        .when(category == "computation_short_answer", F.when(mode == "training", pair("C", "B")).otherwise(pair("C", "E")))
    )


def assignment_gaps(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: missing, unexpected or duplicate, from one full aggregation."""
    both = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("g")).unionByName(got.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("g")))
    sums = both.groupBy(*keys).agg(F.max("e").alias("e"), F.sum("g").alias("g"))
    problem = F.array_compact(F.array(F.when((F.col("e") == 1) & (F.col("g") == 0), "missing"), F.when((F.col("e") == 0) & (F.col("g") > 0), "unexpected"), F.when(F.col("g") > 1, "duplicate")))
    return sums.select(*keys, F.explode(problem).alias("problem"))


def snapshot_checksums(df: DataFrame, *by: str) -> DataFrame:
    """Rows and an order-free checksum of a table, to compare a copy with."""
    names = [f.name for f in df.schema if not f.dataType.simpleString().startswith("map")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*names)).alias("checksum"))


def retried(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Jobs after a manual retry: failed ones are queued again, without a lease, or given up after ``most`` attempts; others stay."""
    failed = F.col("status") == "failed"
    out = jobs.withColumn("status", F.when(failed & (F.col("attempts") >= most), "failed_permanent").when(failed, "queued").otherwise(F.col("status")))
    leased = [c for c in ("lease_until", "lease_holder") if c in jobs.columns]
    return out.withColumns({c: F.when(F.col("status") != "queued", F.col(c)) for c in leased})

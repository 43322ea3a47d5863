"""The grading transaction: submissions, grades, mastery, its log and the mistake book change together or not at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import half_up
from quarry.operators.learning import is_mistake
from quarry.operators.ordered import LEVELS, START, difficulty, next_level, status
from quarry.sources.store import Store
from quarry.sources.tables import written

HIGH = 0.8
DIFFICULTY = 2

REQUEST = "user_id long, request_key string, item_id string, point string, at timestamp, seq long, answer string, score double, max_score double, confidence double, review_required boolean"
SCHEMAS = {
    "requests": "user_id long, request_key string, item_id string",
    "submissions": "submission_id string, user_id long, item_id string, answer string, at timestamp, seq long",
    "grades": "grade_id string, submission_id string, user_id long, score double, max_score double, confidence double, review_required boolean",
    "mastery": "user_id long, point string, level double, streak long, attempts long, correct long, last_ratio double, last_practiced_at timestamp",
    "log": "grade_id string, user_id long, point string, place int, reason string, before_level double, after_level double, before_streak long, after_streak long",
    "mistakes": "user_id long, item_id string, point string, status string, first_error_at timestamp, last_error_at timestamp, last_seq long, error_count long, last_score double, last_max_score double, wrong_answer string, grade_id string",
}


def running_mastery(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with before_level, after_level, before_streak, after_streak and before_ratio, key by key in order.

    rows: keys, order, ratio, counts (whether it moves mastery), and for a key's state from earlier
    (which sorts first and is not given back) is_state with level, streak and last_ratio. A key begins
    at 0.5 without one. Rows are sorted by range of key and order. Only a part's first key can have
    begun in another part; what that run does to a state is passed on, as a step function of levels, so
    no task needs all rows of a key. One row for each part reaches the driver.
    """
    sorted_ = rows.repartitionByRange(*keys, F.desc("is_state"), *order).sortWithinPartitions(*keys, F.desc("is_state"), *order)
    sorted_ = sorted_.withColumn("__at", F.monotonically_increasing_id())
    fixed = written(sorted_.withColumns({"part": F.shiftright("__at", 33).cast("int"), "place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at"), "graded-rows")
    columns = [*keys, "part", "is_state", "level", "streak", "last_ratio", "ratio", "counts"]
    in_order = lambda df: df.repartition("part").sortWithinPartitions("part", "place")

    def listed(batch: pa.RecordBatch) -> Iterator[tuple]:
        cols = {c: batch.column(c).to_pylist() for c in columns}
        return zip(zip(*(cols[k] for k in keys)), *(cols[c] for c in columns[len(keys) :]))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for key, part, is_state, level, streak, last, ratio, counts in listed(batch):
                if now is None or now["part"] != part:
                    now = {"part": part, "first": key, "key": key, "levels": np.arange(LEVELS + 1), "streak": 0, "reset": False, "ratio": None, "runs": 1}
                    out.append(now)
                elif now["key"] != key:
                    now |= {"key": key, "levels": np.full(1, round(START * LEVELS)), "streak": 0, "reset": True, "ratio": None, "runs": 2}
                if is_state:
                    now |= {"levels": np.full(len(now["levels"]), round(level * LEVELS)), "streak": streak, "reset": True, "ratio": last}
                elif counts:
                    now["levels"] = next_level(now["levels"], ratio)
                    good = ratio >= HIGH
                    now |= {"streak": now["streak"] + 1 if good else 0, "reset": now["reset"] or not good, "ratio": ratio}
        if out:
            steps = [np.unique(r["levels"], return_index=True) for r in out]
            as_text = lambda name: pa.array([repr(r[name]) for r in out])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["part"] for r in out], pa.int32()), as_text("first"), as_text("key"), pa.array([r["runs"] > 1 for r in out]),
                    pa.array([s[1].tolist() for s in steps], pa.list_(pa.int32())), pa.array([s[0].tolist() for s in steps], pa.list_(pa.int32())),
                    pa.array([r["streak"] for r in out], pa.int64()), pa.array([r["reset"] for r in out]), pa.array([r["ratio"] for r in out], pa.float64()),
                ],
                names=["part", "first", "key", "several", "starts", "values", "streak", "reset", "ratio"],
            )

    told = in_order(fixed.select(*columns, "place")).mapInArrow(summary, "part int, first string, key string, several boolean, starts array<int>, values array<int>, streak long, reset boolean, ratio double")
    fresh = (round(START * LEVELS), 0, None)
    begin, key, now = {}, None, fresh
    for r in sorted(told.collect(), key=lambda r: r["part"]):
        begin[r["part"]] = old = now if r["first"] == key else fresh
        level, streak, ratio = (fresh if r["several"] else old)
        now = (r["values"][int(np.searchsorted(r["starts"], level, side="right")) - 1], r["streak"] + (0 if r["reset"] else streak), r["ratio"] if r["ratio"] is not None else ratio)
        key = r["key"]
    shared = rows.sparkSession.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, state = None, None, None
        for batch in batches:
            made = []
            for key, part, is_state, level, streak, last, ratio, counts in listed(batch):
                if part != at:
                    at, now, state = part, key, shared.value[part]
                elif key != now:
                    now, state = key, fresh
                if is_state:
                    state = (round(level * LEVELS), streak, last)
                before = state
                if counts and not is_state:
                    state = (int(next_level(np.int64(state[0]), ratio)), state[1] + 1 if ratio >= HIGH else 0, ratio)
                made.append((before[0] / LEVELS, state[0] / LEVELS, before[1], state[1], before[2]))
            extra = [pa.array(c, t) for c, t in zip(zip(*made), [pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()])] if made else [pa.array([], t) for t in [pa.float64()] * 2 + [pa.int64()] * 2 + [pa.float64()]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *RUNNING])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema) + ", before_level double, after_level double, before_streak long, after_streak long, before_ratio double"
    return in_order(fixed).mapInArrow(run, schema).where(~F.col("is_state")).drop("is_state", "level", "streak", "last_ratio", "part", "place")


RUNNING = ["before_level", "after_level", "before_streak", "after_streak", "before_ratio"]


def decided(requests: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is decided on a batch: (user_id, request_key, first, __failed) of the keys not done yet, and (user_id, request_key, __won) of the accepted requests.

    Of the requests with a key, or for an item, the first by time and seq counts. Only keys, items and
    places are shuffled, as minima, so no key is held as a whole.
    """
    place = F.struct("at", "seq", "item_id", F.col("score").isNull().alias("failed"))
    keys = requests.groupBy("user_id", "request_key").agg(F.min(place).alias("first"))
    open_ = written(keys.join(done.select("user_id", "request_key").distinct(), ["user_id", "request_key"], "left_anti"), "grading-keys")
    first_item = open_.where("not first.failed").groupBy("user_id", F.col("first.item_id").alias("item_id")).agg(F.min(F.struct("first.at", "first.seq", "request_key")).alias("w"))
    won = first_item.join(done.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti").select("user_id", "w.request_key", F.struct("w.at", "w.seq").alias("__won"))
    return open_.select("user_id", "request_key", F.struct("first.at", "first.seq").alias("__first")), written(won, "grading-accepted")


def outcomes(requests: DataFrame, first: DataFrame, won: DataFrame) -> DataFrame:
    """``requests`` with outcome: replayed (its key is done, or is an earlier one's of the batch), failed (no grade), already_graded (its item has a grade), or accepted."""
    place = F.struct("at", "seq")
    r = requests.join(first, ["user_id", "request_key"], "left").join(won, ["user_id", "request_key"], "left")
    outcome = F.when(F.col("__first").isNull() | (place != F.col("__first")), "replayed").when(F.col("score").isNull(), "failed").when(place == F.col("__won"), "accepted").otherwise("already_graded")
    return r.withColumn("outcome", outcome).drop("__first", "__won")


def submit(store: Store, requests: DataFrame, high: float = HIGH) -> DataFrame:
    """Grades a batch of requests in one commit; gives each request's outcome.

    requests: the columns of ``REQUEST``; seq tells requests of one time apart, user, key and item are
    not null. Accepted ones enter submissions and grades, move mastery of user and point where they are
    gradable (confident, no review), are logged with what they changed, and enter the mistake book
    where the ratio is low or a review is due. A batch sent again changes nothing, not even the
    version. Raises ``Conflict`` if another writer was first; the batch can then be sent again.
    """
    commit = store.begin()
    requests = written(requests.select(*[c.split()[0] for c in REQUEST.split(", ")]), "grading-requests")
    first, won = decided(requests, commit.read("requests", SCHEMAS["requests"]))
    asked = outcomes(requests, first, won)
    if won.isEmpty():
        return asked
    ident = F.sha2(F.concat_ws("\x1f", F.col("user_id").cast("string"), "request_key"), 256)
    named = lambda df: df.withColumns({"submission_id": F.concat(F.lit("s-"), ident), "grade_id": F.concat(F.lit("g-"), ident)})
    ratio = half_up(F.col("score") / F.greatest("max_score", F.lit(1.0)), 2)
    counts = (F.coalesce("confidence", F.lit(0.0)) > 0) & ~F.coalesce("review_required", F.lit(False))
    new = requests.join(won, ["user_id", "request_key"]).where(F.struct("at", "seq") == F.col("__won")).drop("__won").dropDuplicates(["user_id", "request_key"])  # a request may come twice as a whole
    new = written(new.withColumns({"ratio": ratio, "counts": counts}), "grading-new")

    keys = ["user_id", "point"]
    before = commit.read("mastery", SCHEMAS["mastery"])
    steps = new.select(*keys, "at", "seq", "request_key", "ratio", "counts", F.lit(False).alias("is_state"))  # answers stay behind
    states = before.join(new.select(*keys).distinct(), keys, "left_semi").withColumns({"is_state": F.lit(True), "counts": F.lit(False)})
    graded = written(running_mastery(steps.unionByName(states.select(*keys, "is_state", "counts", "level", "streak", "last_ratio"), allowMissingColumns=True), keys, ["at", "seq"]), "graded")

    last = graded.groupBy(*keys).agg(
        F.max(F.struct("at", "seq", "after_level", "after_streak")).alias("l"), F.max(F.when(F.col("counts"), F.struct("at", "seq", "ratio"))).alias("r"),
        F.count_if("counts").alias("n"), F.count_if(F.col("counts") & (F.col("ratio") >= high)).alias("good"),
    )
    held = before.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("attempts", "correct", "last_ratio")])
    mastery = last.join(held, keys, "left").select(
        *keys, F.col("l.after_level").alias("level"), F.col("l.after_streak").alias("streak"), (F.coalesce("old_attempts", F.lit(0)) + F.col("n")).alias("attempts"),
        (F.coalesce("old_correct", F.lit(0)) + F.col("good")).alias("correct"), F.coalesce("r.ratio", "old_last_ratio").alias("last_ratio"), F.col("l.at").alias("last_practiced_at"),
    )

    moved = difficulty(F.col("ratio"), F.col("before_ratio"), F.lit(DIFFICULTY))
    entry = lambda place, reason, level, streak: F.struct(F.lit(place).alias("place"), reason.alias("reason"), F.col(level).alias("before_level"), F.col(streak).alias("before_streak"))
    entries = F.filter(
        F.array(
            entry(0, F.when(F.col("ratio") >= high, "grade_result").otherwise("wrong_answer"), "before_level", "before_streak"),
            F.when(F.col("counts") & (moved != DIFFICULTY), entry(1, F.concat(F.lit(f"difficulty {DIFFICULTY}→"), moved.cast("string")), "after_level", "after_streak")),
            F.when(F.col("counts") & (status(F.col("ratio"), F.col("before_ratio"), high) == "mastered"), entry(2, F.lit("status→mastered"), "after_level", "after_streak")),
        ),
        lambda e: e.isNotNull(),
    )
    log = named(graded).select("grade_id", *keys, "after_level", "after_streak", F.explode(entries).alias("e")).select("grade_id", *keys, "e.place", "e.reason", "e.before_level", "after_level", "e.before_streak", "after_streak")

    # an item is graded once for each user, so it enters the book once
    wrong = named(new.where(is_mistake(F.col("ratio"), F.col("review_required"), high)))
    mistakes = wrong.select(
        "user_id", "item_id", "point", F.lit("pending").alias("status"), F.col("at").alias("first_error_at"), F.col("at").alias("last_error_at"), F.col("seq").alias("last_seq"),
        F.lit(1).alias("error_count"), F.col("score").alias("last_score"), F.col("max_score").alias("last_max_score"), F.col("answer").alias("wrong_answer"), "grade_id",
    )

    fitted = lambda df, table: df.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMAS[table].split(", ")])
    for table in ("submissions", "grades"):
        commit.append(table, fitted(named(new), table))
    commit.append("log", fitted(log, "log"))
    commit.upsert("mastery", fitted(mastery, "mastery"), keys)
    commit.upsert("mistakes", fitted(mistakes, "mistakes"), ["user_id", "item_id"])
    commit.append("requests", fitted(new, "requests"))
    commit.finish()
    return asked

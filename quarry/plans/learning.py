"""Learning queries: events as graded submissions, orders and their lines as sessions and items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import numeric, text
from quarry.operators import grading as G
from quarry.operators import ordered as O
from quarry.operators import reports as R
from quarry.plans import frames
from quarry.plans.frames import SUBMISSIONS_SQL
from quarry.plans.registry import query
from quarry.sources.store import Store
from quarry.sources.tables import read, shared_dir

S = f"WITH {SUBMISSIONS_SQL}"
ORDER = ["ts", "event_id"]
#: Now, for reports over the last seven days.
NOW = "2024-01-31 00:00:00"


def sub(spark, d):
    return frames.submissions(spark, d)


@query("w04_mastery", f"{S} SELECT user_id, count(*)::BIGINT AS n, list_reduce(list_prepend(0.5::DOUBLE, list(ratio ORDER BY ts, event_id)), lambda a, x: round_even(greatest(0, least(1, 0.7::DOUBLE * a + 0.3::DOUBLE * x)), 4)) AS level FROM sub GROUP BY user_id")
def mastery(spark, d):
    return O.mastery(sub(spark, d), ["user_id"], ORDER, "ratio")


@query("w04_mastery_by_point", f"{S} SELECT user_id, point, count(*)::BIGINT AS n, list_reduce(list_prepend(0.5::DOUBLE, list(ratio ORDER BY ts, event_id)), lambda a, x: round_even(greatest(0, least(1, 0.7::DOUBLE * a + 0.3::DOUBLE * x)), 4)) AS level FROM sub GROUP BY ALL")
def mastery_by_point(spark, d):
    return O.mastery(sub(spark, d), ["user_id", "point"], ORDER, "ratio")


@query("w05_streak", f"{S}, r AS (SELECT user_id, ratio >= 0.3 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM sub) SELECT user_id, coalesce(min(CASE WHEN NOT ok THEN back END) - 1, count(*))::BIGINT AS streak FROM r GROUP BY user_id")
def streak(spark, d):
    return O.streaks(sub(spark, d).withColumn("ok", F.col("ratio") >= 0.3), ["user_id"], ORDER, "ok")


_LAST = f"{S}, r AS (SELECT user_id, ratio, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM sub), t AS (SELECT user_id, max(CASE WHEN back = 1 THEN ratio END) AS last, max(CASE WHEN back = 2 THEN ratio END) AS before FROM r WHERE back <= 2 GROUP BY user_id)"


@query("w06_status", f"{_LAST} SELECT user_id, CASE WHEN last >= 0.5 AND before >= 0.5 THEN 'mastered' ELSE 'pending' END AS status FROM t")
def status(spark, d):
    return O.last_two(sub(spark, d), ["user_id"], ORDER, "ratio").select("user_id", O.status(F.col("last"), F.col("before"), 0.5).alias("status"))


@query("w07_difficulty", f"{_LAST} SELECT user_id, greatest(1, least(3, 2 + CASE WHEN last >= 0.8 AND before >= 0.8 THEN 1 WHEN last < 0.5 AND before < 0.5 THEN -1 ELSE 0 END))::INT AS difficulty FROM t")
def difficulty(spark, d):
    return O.last_two(sub(spark, d), ["user_id"], ORDER, "ratio").select("user_id", O.difficulty(F.col("last"), F.col("before"), F.lit(2)).alias("difficulty"))


@query("w08_recent_ratios", f"{S}, r AS (SELECT user_id, ratio, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM sub) SELECT user_id, 6 - back AS place, round_even(ratio, 2) AS ratio FROM r WHERE back BETWEEN 2 AND 5")
def recent(spark, d):
    """The ratios before the current one among the last five, oldest first."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return sub(spark, d).withColumn("back", back).where("back between 2 and 5").select("user_id", (6 - F.col("back")).cast("long").alias("place"), F.bround("ratio", 2).alias("ratio"))


@query("w09_mastery_change", f"{S} SELECT user_id, point, arg_min(ratio, (ts, event_id)) AS first_before, arg_max(ratio, (ts, event_id)) AS last_after FROM sub GROUP BY ALL")
def change(spark, d):
    log = sub(spark, d).select("user_id", "point", F.col("ratio").alias("before_level"), F.col("ratio").alias("after_level"), F.struct("ts", "event_id").alias("at"))
    return R.mastery_change(log, ["user_id", "point"], "at")


@query("w15_attempt_numbers", f"{S} SELECT event_id, user_id, point, row_number() OVER (PARTITION BY user_id, point ORDER BY ts, event_id)::INT AS attempt FROM sub")
def attempts(spark, d):
    return O.sequence(sub(spark, d), ["user_id", "point"], ORDER, "attempt", 1).select("event_id", "user_id", "point", "attempt")


@query("w14_recent_counts", f"{S} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 299 PRECEDING AND 1 PRECEDING)::BIGINT AS recent FROM sub")
def recent_counts(spark, d):
    return O.in_window(sub(spark, d), ["user_id"], F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).select("event_id", "recent")


_ALLOWED = """a AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 * 1000000000 + event_id AS e FROM sub),
held AS (SELECT user_id, list_reduce(list_prepend([]::BIGINT[], list([e] ORDER BY e)), lambda h, x: CASE WHEN len(list_filter(h, lambda y: y // 1000000000 > x[1] // 1000000000 - 3600)) < 5 THEN list_append(h, x[1]) ELSE h END) AS h FROM a GROUP BY user_id)"""


@query("w14_rate_limit", f"{S}, {_ALLOWED} SELECT event_id, user_id, list_contains(h, e) AS accepted FROM a JOIN held USING (user_id)")
def rate_limit(spark, d):
    """Attempts of each user, at most 5 accepted in an hour."""
    timed = sub(spark, d).withColumn("seconds", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    return O.allowed_attempts(timed, ["user_id"], "seconds", ["event_id"], 5, 3600).select("event_id", "user_id", "accepted")


@query("k15_mistake_book", f"{S} SELECT user_id, point, count(*)::BIGINT AS error_count, min(ts) AS first_error_at, max(ts) AS last_error_at, arg_max(ratio, (ts, event_id)) AS last_ratio FROM sub WHERE ratio < 0.8 OR point = 'error' GROUP BY ALL")
def mistakes(spark, d):
    return R.mistakes(sub(spark, d), ["user_id", "point"], ORDER, "ratio", F.col("point") == "error")


@query("p14_gradable", f"{S} SELECT point, count_if(value > 0 AND point <> 'error')::BIGINT AS gradable, count(*)::BIGINT AS n FROM sub GROUP BY point")
def gradable(spark, d):
    ok = (F.col("value") > 0) & (F.col("point") != "error")
    return sub(spark, d).groupBy("point").agg(F.count_if(ok).alias("gradable"), F.count("*").alias("n"))


_RECENT = f"{S}, g AS (SELECT * FROM sub WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND value IS NOT NULL AND value > 0 AND point <> 'error')"


@query("a21_learning_summary", f"""{_RECENT}, a AS (SELECT user_id, round_even(avg(ratio), 4) AS accuracy, count(*)::BIGINT AS recent FROM g GROUP BY user_id),
c AS (SELECT user_id, count(DISTINCT point)::BIGINT AS points, count_if(ratio < 0.2)::BIGINT AS pending, count_if(ratio >= 0.2 AND ratio < 0.8)::BIGINT AS reviewing FROM sub GROUP BY user_id)
SELECT c.user_id, points, pending, reviewing, accuracy, recent FROM c LEFT JOIN a USING (user_id)""")
def summary(spark, d):
    """Both mistake counts in one pass; accuracy over the last seven days, null without scores."""
    s = sub(spark, d)
    recent = s.where((F.col("ts") >= F.lit(NOW).cast("timestamp") - F.expr("interval 7 days")) & F.col("value").isNotNull() & (F.col("value") > 0) & (F.col("point") != "error"))
    accuracy = recent.groupBy("user_id").agg(F.bround(F.avg("ratio"), 4).alias("accuracy"), F.nullif(F.count("*"), F.lit(0)).alias("recent"))
    counts = s.groupBy("user_id").agg(F.count_distinct("point").alias("points"), F.count_if(F.col("ratio") < 0.2).alias("pending"), F.count_if((F.col("ratio") >= 0.2) & (F.col("ratio") < 0.8)).alias("reviewing"))
    return counts.join(accuracy, "user_id", "left")


@query("f30_summary_text")
def summary_text(spark, d):
    return summary(spark, d).select("user_id", text.summary_text(F.col("points"), F.col("pending"), F.col("reviewing"), F.col("accuracy")).alias("summary"))


@query("a30_overall_mastery", f"{S} SELECT user_id, round(avg(ratio), 2) AS mastery, count_if(ratio < 0.8)::BIGINT AS mistakes FROM sub GROUP BY user_id")
def overall(spark, d):
    return sub(spark, d).groupBy("user_id").agg(numeric.half_up(F.avg("ratio"), 2).alias("mastery"), F.count_if(F.col("ratio") < 0.8).alias("mistakes"))


@query("f28_verdicts", f"{S} SELECT event_id, CASE WHEN ratio >= 0.9 THEN '优秀' WHEN ratio >= 0.7 THEN '良好' WHEN ratio >= 0.5 THEN '需改进' ELSE '需复习' END AS verdict FROM sub")
def verdicts(spark, d):
    return sub(spark, d).select("event_id", text.verdict(F.col("ratio")).alias("verdict"))


# ---- an order is a session, a line an item, its quantity of 50 the score


@query("a23_session_totals", "SELECT l_orderkey AS session_id, count(*)::BIGINT AS items, sum(least(10, l_quantity / 5)) AS total, count(*) * 10.0::DOUBLE AS max_total, sum(least(10, l_quantity / 5)) / (count(*) * 10.0::DOUBLE) AS ratio FROM lineitem GROUP BY 1".replace("sum(least(10, l_quantity / 5)) AS total", "round_even(sum(least(10, l_quantity / 5)), 6) AS total").replace("sum(least(10, l_quantity / 5)) / (count(*) * 10.0::DOUBLE) AS ratio", "round_even(sum(least(10, l_quantity / 5)) / (count(*) * 10.0::DOUBLE), 6) AS ratio"))
def totals(spark, d):
    lines = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "session_id")
    found = R.session_totals(lines, "session_id", F.least(F.lit(10.0), F.col("l_quantity") / 5))
    return found.withColumns({"total": F.bround("total", 6), "ratio": F.bround("ratio", 6)})


@query("a24_point_totals", "SELECT p_type AS point, min(p_name) AS name, round_even(sum(least(10, l_quantity / 5)), 4) AS total, count(*) * 10.0::DOUBLE AS max_total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def point_totals(spark, d):
    lines = read(spark, d, "lineitem").select("l_partkey", "l_quantity").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name"), "l_partkey")
    return lines.groupBy(F.col("p_type").alias("point")).agg(F.min("p_name").alias("name"), F.bround(F.sum(F.least(F.lit(10.0), F.col("l_quantity") / 5)), 4).alias("total"), (F.count("*") * 10.0).alias("max_total"))


@query("a25_progress", "SELECT l_orderkey AS session_id, count(*)::BIGINT AS total, count_if(l_returnflag <> 'N')::BIGINT AS completed, least(count_if(l_returnflag <> 'N'), count(*))::BIGINT AS pointer, count_if(l_returnflag <> 'N') >= count(*) AS finished FROM lineitem GROUP BY 1")
def progress(spark, d):
    return R.progress(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "session_id"), "session_id", F.col("l_returnflag") != "N")


@query("j11_session_summary", """WITH latest AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1),
w AS (SELECT DISTINCT p_partkey FROM part WHERE p_size < 10)
SELECT o_orderkey AS session_id, c_mktsegment AS segment, count(*)::BIGINT AS items, count(w.p_partkey)::BIGINT AS mistakes, sum(l_quantity) AS score FROM orders JOIN customer ON c_custkey = o_custkey JOIN latest ON l_orderkey = o_orderkey LEFT JOIN w ON w.p_partkey = l_partkey GROUP BY ALL""")
def session_summary(spark, d):
    """Session, its owner, each item's newest submission and, where there is one, its mistake entry."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    latest = O.newest(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    wrong = read(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("wrong"))
    session = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    joined = latest.select("l_orderkey", "l_partkey", "l_quantity").join(wrong, "l_partkey", "left").join(session, "l_orderkey")
    return joined.groupBy(F.col("l_orderkey").alias("session_id"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("items"), F.count("wrong").alias("mistakes"), F.sum("l_quantity").alias("score"))


@query("j12_latest_reason", "WITH r AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS change_reason FROM events GROUP BY user_id) SELECT c_custkey AS user_id, change_reason FROM customer LEFT JOIN r ON user_id = c_custkey")
def latest_reason(spark, d):
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    log = read(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("change_reason"))
    return R.with_latest(users, log, "user_id", ORDER).select("user_id", "change_reason")


@query("j13_first_unanswered", "SELECT conv_id, min(turn)::BIGINT AS turn FROM conversations u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant') GROUP BY conv_id")
def first_unanswered(spark, d):
    c = read(spark, d, "conversations")
    items = c.where("role = 'user'").select("conv_id", F.col("turn").alias("item"), "turn")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("item"))
    return R.first_unanswered(items, answers, "conv_id", "item", "turn").select("conv_id", "turn")


@query("j20_step_scores", """WITH s AS (SELECT l_orderkey AS paper, l_partkey AS item, l_quantity - 2 AS score, p_size::DOUBLE AS max_score FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 3) ON p_partkey = l_partkey)
SELECT paper, least(100.0::DOUBLE, coalesce(sum(CASE WHEN max_score IS NOT NULL THEN least(greatest(score, 0), max_score) END), 0)) AS total,
  (count_if(max_score IS NULL OR score < 0 OR score > max_score) + CASE WHEN coalesce(sum(CASE WHEN max_score IS NOT NULL THEN least(greatest(score, 0), max_score) END), 0) > 100 THEN 1 ELSE 0 END)::BIGINT AS violations FROM s GROUP BY paper""")
def step_scores(spark, d):
    steps = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("item"), (F.col("l_quantity") - 2).alias("score"))
    rubric = read(spark, d, "part").where("p_size > 3").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("max_score"))
    return R.step_totals(steps, rubric, ["paper"], "item", 100.0)


@query("w17_pointer", "SELECT l_orderkey AS session_id, least(count(*), 3)::BIGINT AS total, count_if(l_returnflag <> 'N')::BIGINT AS completed FROM lineitem GROUP BY 1")
def pointer(spark, d):
    own = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), "l_returnflag")
    n = own.groupBy("session_id").agg(F.least(F.count("*"), F.lit(3)).alias("target"))
    return R.progress(own.join(n, "session_id"), "session_id", F.col("l_returnflag") != "N", F.col("target")).select("session_id", "total", "completed")


@query("x05_generated_questions", "SELECT o_orderkey AS session_id, i::INT AS order_no, 'q-' || left(o_orderkey::VARCHAR, 8) || '-' || i AS item_id, ['choice', 'fill_blank'][(i - 1) % 2 + 1] AS question_type FROM (SELECT o_orderkey, unnest(generate_series(1, (o_orderkey % 6))) AS i FROM orders WHERE o_orderkey % 6 >= 3)")
def generated(spark, d):
    """Sessions that ask for fewer than three questions get none."""
    asked = read(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderkey") % 6).alias("count"))
    return R.fake_questions(asked, ["s1", "s2", "s3"], ["choice", "fill_blank"]).select("session_id", "order_no", "item_id", "question_type")


@query("x06_graded_steps", "SELECT event_id, unnest(['R1', 'R2']) AS rubric_item_id, CASE WHEN value / 500 >= 0.9 THEN 'met' WHEN value / 500 >= 0.3 THEN 'partial' ELSE 'not_met' END AS status, value / 100 AS score FROM events".replace("value / 100 AS", "round_even(value / 50 / 2, 6) AS"))
def graded_steps(spark, d):
    rubric = F.array(F.struct(F.lit("R1").alias("id"), F.lit(6.0).alias("max_score")), F.struct(F.lit("R2").alias("id"), F.lit(4.0).alias("max_score")))
    steps = R.fake_grade(rubric, F.col("value") / 50)
    return read(spark, d, "events").select("event_id", F.explode(steps).alias("s")).select("event_id", "s.rubric_item_id", "s.status", F.bround("s.score", 6).alias("score"))


@query("f29_suggestions", "SELECT l_orderkey AS session_id, CASE WHEN sum(l_quantity) / (count(*) * 50) < 0.6 THEN 1 WHEN sum(l_quantity) / (count(*) * 50) < 0.8 THEN 2 ELSE 3 END AS advice FROM lineitem GROUP BY 1")
def suggestions(spark, d):
    ratio = F.sum("l_quantity") / (F.count("*") * 50)
    found = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(text.suggestion(ratio).alias("s"))
    return found.select("session_id", F.when(F.col("s").contains("重新"), 1).when(F.col("s").contains("巩固"), 2).otherwise(3).alias("advice"))


def requests(spark, d):
    """An event as a request of its user for one of 90 items of a kind; an event that comes twice has one key."""
    e = read(spark, d, "events")
    return e.select(
        "user_id", F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_key"), F.concat("event_type", F.lit("-"), (F.col("event_id") % 90).cast("string")).alias("item_id"),
        F.col("event_type").alias("point"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("props").alias("answer"), F.when(F.col("event_id") % 13 != 0, F.least(F.lit(10.0), F.col("value") / 20)).alias("score"),
        F.lit(10.0).alias("max_score"), (F.col("event_id") % 11 != 0).cast("double").alias("confidence"), (F.col("event_id") % 7 == 0).alias("review_required"),
    )


def graded_store(spark, d):
    """All requests in three commits by thirds of the day; the third sends everything again, and a fourth call changes nothing."""
    store, all_ = Store(spark, f"{shared_dir(spark)}/grading-{uuid.uuid4().hex}", 8), requests(spark, d)
    hour = F.hour("at")
    for batch in (all_.where(hour < 8), all_.where(hour < 16), all_, all_):
        G.submit(store, batch)
    return store


_REQUESTS = """WITH req AS (SELECT user_id, event_type || '-' || (event_id % 90) AS item_id, event_type AS point, ts AS tm, event_id AS seq, hour(ts) // 8 AS batch, value, event_id % 11 <> 0 AND event_id % 7 <> 0 AS counts, event_id % 7 = 0 AS review,
    round(least(10.0::DOUBLE, value / 20) / 10, 2) AS ratio, least(10.0::DOUBLE, value / 20) AS score FROM events WHERE event_id % 13 <> 0 AND value IS NOT NULL),
acc AS (SELECT * FROM req QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY batch, tm, seq) = 1),
acc2 AS (SELECT *, row_number() OVER w AS nth, list(CASE WHEN counts THEN ratio END) OVER w AS upto FROM acc WINDOW w AS (PARTITION BY user_id, point ORDER BY batch, tm, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
states AS (SELECT *, list_filter(upto, lambda x: x IS NOT NULL) AS rs, list_filter(upto[:-2], lambda x: x IS NOT NULL) AS rs0 FROM acc2),
folded AS (SELECT *, list_reduce(list_prepend(0.5::DOUBLE, rs), lambda a, x: round_even(greatest(0, least(1, 0.7::DOUBLE * a + 0.3::DOUBLE * x)), 4)) AS after_level,
  list_reduce(list_prepend(0.5::DOUBLE, rs0), lambda a, x: round_even(greatest(0, least(1, 0.7::DOUBLE * a + 0.3::DOUBLE * x)), 4)) AS before_level,
  list_reduce(list_prepend(0.0::DOUBLE, rs), lambda a, x: CASE WHEN x >= 0.8 THEN a + 1 ELSE 0.0::DOUBLE END)::BIGINT AS after_streak,
  list_reduce(list_prepend(0.0::DOUBLE, rs0), lambda a, x: CASE WHEN x >= 0.8 THEN a + 1 ELSE 0.0::DOUBLE END)::BIGINT AS before_streak FROM states)"""


@query("k14_mastery", f"{_REQUESTS} SELECT user_id, point, arg_max(after_level, nth) AS level, arg_max(after_streak, nth) AS streak, count_if(counts)::BIGINT AS attempts, count_if(counts AND ratio >= 0.8)::BIGINT AS correct FROM folded GROUP BY ALL")
def transaction_mastery(spark, d):
    return graded_store(spark, d).read("mastery", G.SCHEMAS["mastery"]).select("user_id", "point", "level", "streak", "attempts", "correct")


@query(
    "k14_log",
    f"""{_REQUESTS} SELECT user_id, point, nth, e.place::INT AS place, e.reason AS reason, e.before_level AS before_level, after_level, e.before_streak AS before_streak, after_streak FROM (SELECT *, unnest([
  {{'place': 0, 'reason': CASE WHEN ratio >= 0.8 THEN 'grade_result' ELSE 'wrong_answer' END, 'before_level': before_level, 'before_streak': before_streak}},
  CASE WHEN counts AND ratio >= 0.8 AND rs0[-1] >= 0.8 THEN {{'place': 1, 'reason': 'difficulty 2→3', 'before_level': after_level, 'before_streak': after_streak}}
    WHEN counts AND ratio < 0.5 AND rs0[-1] < 0.5 THEN {{'place': 1, 'reason': 'difficulty 2→1', 'before_level': after_level, 'before_streak': after_streak}} END,
  CASE WHEN counts AND ratio >= 0.8 AND rs0[-1] >= 0.8 THEN {{'place': 2, 'reason': 'status→mastered', 'before_level': after_level, 'before_streak': after_streak}} END]) AS e FROM folded) WHERE e IS NOT NULL""",
)
def transaction_log(spark, d):
    """The log, with each change's number among its user's and point's."""
    store = graded_store(spark, d)
    when = store.read("submissions", G.SCHEMAS["submissions"]).select(F.concat(F.lit("g-"), F.substring("submission_id", F.lit(3), F.lit(64))).alias("grade_id"), F.floor(F.hour("at") / 8).alias("batch"), "at", "seq")
    log = store.read("log", G.SCHEMAS["log"]).join(when, "grade_id")
    first = O.sequence(log.where("place = 0"), ["user_id", "point"], ["batch", "at", "seq"], "nth", 1).select("grade_id", F.col("nth").cast("long").alias("nth"))
    return log.join(first, "grade_id").select("user_id", "point", "nth", "place", "reason", "before_level", "after_level", "before_streak", "after_streak")


@query("k14_mistakes", f"{_REQUESTS} SELECT user_id, item_id, point, 'pending' AS status, 1::BIGINT AS error_count, score AS last_score FROM acc WHERE ratio < 0.8 OR review")
def transaction_mistakes(spark, d):
    return graded_store(spark, d).read("mistakes", G.SCHEMAS["mistakes"]).select("user_id", "item_id", "point", "status", "error_count", "last_score")

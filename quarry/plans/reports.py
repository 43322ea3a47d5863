"""Relational queries: lists, owners, jobs, logs, duplicates, references."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import ordered as O
from quarry.operators import reports as R
from quarry.plans.registry import query
from quarry.sources import tables
from quarry.sources.tables import read

MOVES = {"view": ["click", "purchase"], "click": ["view", "purchase", "error"], "signup": ["view"], "purchase": [], "error": ["view"]}


@query("t05_page", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def page(spark, d):
    """The third page of the list, newest first: the feature is the page."""
    return R.page(read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")], 3)


@query("t06_newest", "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")
def newest(spark, d):
    return R.page(read(spark, d, "events").select("event_id", "user_id", "ts"), [F.desc("ts"), F.asc("event_id")], 1, 50)


@query("t07_transcript", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id")
def transcript(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count("*").alias("turns"))
    return turns.select("conv_id", F.array_join("t.role", ">").alias("roles"), "turns")


@query("a28_page_counts", "SELECT o_orderstatus, count(*)::BIGINT AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS total_pages FROM orders GROUP BY 1")
def page_counts(spark, d):
    return R.page_counts(read(spark, d, "orders"), 20, "o_orderstatus")


@query("a20_status_counts", "SELECT o_custkey, count_if(o_orderstatus = 'P')::BIGINT AS pending, count_if(o_orderstatus = 'O')::BIGINT AS reviewing FROM orders GROUP BY 1")
def status_counts(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("o_orderstatus") == "O").alias("reviewing"))


@query("p06_owner", "SELECT event_id, ts, event_type FROM events WHERE user_id = 7")
def owner(spark, d):
    return read(spark, d, "events").where("user_id = 7").select("event_id", "ts", "event_type")


@query("p07_list_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority ILIKE '%low%'")
def list_filter(spark, d):
    return read(spark, d, "orders").where((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").ilike("%low%")).select("o_orderkey")


@query("p08_soft_delete", "SELECT d.doc_id, lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(toxic, 0) <> 1")
def soft_delete(spark, d):
    state = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "deleted").otherwise("ready").alias("status"))
    docs = read(spark, d, "documents").select("doc_id", "lang").join(state, "doc_id", "left")
    return docs.where(F.coalesce("status", F.lit("ready")) != "deleted").select("doc_id", "lang")


@query("p09_since", "SELECT conv_id, turn, role FROM conversations WHERE turn > 2")
def since(spark, d):
    return read(spark, d, "conversations").where("turn > 2").select("conv_id", "turn", "role")


@query("p10_reply", "SELECT conv_id, turn, md5(text) AS reply FROM conversations WHERE role = 'assistant' AND turn = 1")
def reply(spark, d):
    return read(spark, d, "conversations").where("role = 'assistant' and turn = 1").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("reply"))


@query("p12_valid_sessions", "SELECT event_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'member' END AS role FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type <> 'error' AND ts + INTERVAL 8 HOUR >= TIMESTAMP '2024-01-15 00:00:00'")
def valid_sessions(spark, d):
    """Not revoked, within eight hours of their start at the given time or later; the role from the user, or member."""
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").alias("role"))
    live = read(spark, d, "events").where((F.col("event_type") != "error") & (F.col("ts") + F.expr("interval 8 hours") >= F.lit("2024-01-15 00:00:00").cast("timestamp")))
    return live.join(users, "user_id", "left").select("event_id", F.coalesce("role", F.lit("member")).alias("role"))


@query("p13_permissions", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS permissions FROM customer")
def permissions(spark, d):
    table = F.create_map(F.lit("BUILDING"), F.array(*map(F.lit, ("read", "write", "review"))), F.lit("MACHINERY"), F.array(F.lit("read")))
    return read(spark, d, "customer").select("c_custkey", F.size(F.coalesce(table[F.col("c_mktsegment")], F.array().cast("array<string>"))).alias("permissions"))


@query("p17_public_rows", "SELECT c_custkey AS id, c_name AS name FROM customer")
def public_rows(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("p25_limits", "SELECT conv_id, count_if(role = 'assistant') >= 4 OR count(*) >= 8 AS exceeded FROM conversations GROUP BY 1")
def limits(spark, d):
    calls, hops = F.count_if(F.col("role") == "assistant"), F.count("*")
    return read(spark, d, "conversations").groupBy("conv_id").agg(((calls >= 4) | (hops >= 8)).alias("exceeded"))


@query("w01_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT - 1 AS sequence_no FROM events")
def sequence(spark, d):
    return O.sequence(read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "sequence_no")


@query("w01_next_sequence", "SELECT conv_id, (max(turn) + 1)::BIGINT AS next FROM conversations GROUP BY 1")
def next_sequence(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next"))


@query("w03_latest", "SELECT conv_id, max(turn)::BIGINT AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def latest(spark, d):
    return O.newest(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])


@query("j01_jobs_of_documents", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def jobs_of_documents(spark, d):
    jobs = read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return jobs.join(read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("j14_latest_job", "WITH j AS (SELECT o_custkey, max((o_orderdate, o_orderkey)) AS m FROM orders GROUP BY 1) SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT o.* FROM orders o JOIN j ON o.o_custkey = j.o_custkey AND (o.o_orderdate, o.o_orderkey) = j.m) ON o_custkey = c_custkey")
def latest_job(spark, d):
    jobs = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    return R.with_latest(read(spark, d, "customer").select("c_custkey"), jobs, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", "o_orderstatus")


@query("j15_dangling", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)")
def dangling(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.dangling(lines, read(spark, d, "part").where("p_size > 5"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j22_names", "SELECT o_orderkey, coalesce(c_name, left(o_custkey::VARCHAR, 8)) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def names(spark, d):
    known = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.left(F.col("o_custkey").cast("string"), F.lit(8))).alias("name"))


@query("j23_owned_events", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def owned(spark, d):
    own = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return read(spark, d, "events").join(own, "user_id", "left_semi").select("event_id")


@query("s26_duplicates", "SELECT doc_id, sha256(text) AS sha256, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents")
def duplicates(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return tables.first_of_content(docs).select(F.col("document_id").alias("doc_id"), "sha256", "is_duplicate")


_LAG = "lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("k05_bad_moves", f"WITH s AS (SELECT event_id, event_type, {_LAG} AS before FROM events) SELECT event_id, before, event_type AS status FROM s WHERE before IS NOT NULL AND before <> event_type AND NOT coalesce(list_contains(CASE before WHEN 'view' THEN ['click', 'purchase'] WHEN 'click' THEN ['view', 'purchase', 'error'] WHEN 'signup' THEN ['view'] WHEN 'error' THEN ['view'] ELSE [] END, event_type), false)")
def bad_moves(spark, d):
    log = read(spark, d, "events").withColumnRenamed("event_type", "status")
    return R.bad_moves(log, ["user_id"], ["ts", "event_id"], moves=MOVES).select("event_id", "before", "status")


@query("k10_bad_run_moves", f"WITH s AS (SELECT event_id, event_type, {_LAG} AS before FROM events) SELECT before, event_type AS status, count(*)::BIGINT AS n FROM s WHERE before IS NOT NULL AND NOT coalesce(list_contains(CASE before WHEN 'view' THEN ['click', 'purchase'] WHEN 'click' THEN ['view', 'purchase', 'error'] WHEN 'signup' THEN ['view'] WHEN 'error' THEN ['view'] ELSE [] END, event_type), false) GROUP BY ALL")
def bad_run_moves(spark, d):
    """As before, but a repeated status is a wrong move, too."""
    log = read(spark, d, "events").withColumnRenamed("event_type", "status")
    return R.bad_moves(log, ["user_id"], ["ts", "event_id"], moves=MOVES, stay=False).groupBy("before", "status").agg(F.count("*").alias("n"))


@query("k06_bad_progress", "WITH s AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id FROM s WHERE before IS NOT NULL AND (value < before OR value > 100) OR value > 100 OR value < 0")
def bad_progress(spark, d):
    return R.bad_progress(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id")


@query("k07_error_kinds", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') OR contains(lower(text), 'unsupported') OR contains(lower(text), 'corrupt') OR contains(lower(text), 'format') THEN 'failed_permanent' ELSE 'failed_retryable' END AS kind FROM documents")
def error_kinds(spark, d):
    name = F.when(F.col("source").isin("src1", "src2"), "ValueError").otherwise(F.col("source"))
    return read(spark, d, "documents").select("doc_id", R.error_kind(name, F.col("text")).alias("kind"))


@query("k08_retry_outcomes", "SELECT user_id, CASE WHEN count_if(event_type = 'error') > 2 THEN 'failed_permanent' ELSE 'failed_retryable' END AS outcome FROM events GROUP BY 1")
def retry(spark, d):
    attempts = F.count_if(F.col("event_type") == "error")
    return read(spark, d, "events").groupBy("user_id").agg(R.after_failure(F.lit("failed_retryable"), attempts).alias("outcome"))


@query("k13_idempotent", "SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id))::BIGINT AS event_id, (count(*) - 1)::BIGINT AS replays FROM events GROUP BY ALL")
def idempotent(spark, d):
    return R.first_requests(read(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])


_JOBS = "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'running' ELSE 'succeeded' END AS status, o_orderdate AS created_at, o_orderdate + INTERVAL 300 SECOND AS lease_until FROM orders"


def _jobs(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("interval 300 seconds")).alias("lease_until"))


@query("k03_recovered_jobs", f"WITH j AS ({_JOBS}) SELECT job_id, CASE WHEN status = 'running' AND lease_until < TIMESTAMP '2000-01-01' THEN 'pending' ELSE status END AS status FROM j")
def recovered(spark, d):
    return R.recovered_jobs(_jobs(spark, d), F.lit("2000-01-01 00:00:00").cast("timestamp")).select("job_id", "status")


@query("t08_claim", f"WITH j AS ({_JOBS}) SELECT job_id, created_at FROM j WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 1")
def claim(spark, d):
    return R.claimable(_jobs(spark, d)).select("job_id", "created_at")


@query("a29_failure_counts", "SELECT event_type, user_id % 10 AS shard, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def failure_counts(spark, d):
    return read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("shard")).agg(F.count("*").alias("n"))


@query("a17_review_stats", "SELECT o_orderpriority AS kind, count(*)::BIGINT AS total, count_if(o_orderstatus = 'P')::BIGINT AS pending, count_if(o_orderstatus = 'F')::BIGINT AS approved FROM orders GROUP BY ROLLUP (o_orderpriority)")
def review_stats(spark, d):
    n = [F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("o_orderstatus") == "F").alias("approved")]
    return read(spark, d, "orders").withColumnRenamed("o_orderpriority", "kind").rollup("kind").agg(*n)


@query("t09_pending_reviews", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 100")
def pending_reviews(spark, d):
    return read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(100)


@query("u02_intersection", "SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def intersection(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(read(spark, d, "events").select("user_id"))


@query("u03_difference", "SELECT c_custkey AS k, 'without_orders' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT user_id, 'not_a_customer' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def difference(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    left = a.subtract(read(spark, d, "orders").select("o_custkey")).withColumn("side", F.lit("without_orders"))
    right = read(spark, d, "events").select(F.col("user_id").alias("k")).subtract(a).withColumn("side", F.lit("not_a_customer"))
    return left.unionByName(right)


@query("u07_unassigned", "SELECT doc_id, lang FROM documents EXCEPT SELECT d.doc_id, lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def unassigned(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang")
    return docs.subtract(docs.join(read(spark, d, "labels").select("doc_id"), "doc_id"))


@query("a27_item_counts", "SELECT l_orderkey, count(*)::BIGINT AS items FROM lineitem GROUP BY 1")
def item_counts(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"))


@query("d02_expiry", "SELECT event_id, ts + INTERVAL 8 HOUR AS expires_at, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def expiry(spark, d):
    return read(spark, d, "events").select("event_id", (F.col("ts") + F.expr("interval 8 hours")).alias("expires_at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("d11_map_merge", "SELECT event_id, 'k=' || CASE WHEN event_type = 'error' THEN 'fixed' ELSE event_type END || ',user=' || user_id AS merged FROM events")
def map_merge(spark, d):
    from quarry.functions.jsons import merged_map

    old = F.create_map(F.lit("k"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    new = F.when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit("fixed"))).otherwise(F.create_map().cast("map<string,string>"))
    m = merged_map(old, new)
    return read(spark, d, "events").select("event_id", F.concat(F.lit("k="), m["k"], F.lit(",user="), m["user"]).alias("merged"))


@query("s37_checksums")
def checksums(spark, d):
    return R.snapshot_checksums(read(spark, d, "orders"), "o_orderstatus")


@query("f32_source_labels", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y') || ' ' || o_orderpriority ELSE '模拟题 ' || o_orderkey END AS label FROM orders")
def source_labels(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", F.concat_ws(" ", F.date_format("o_orderdate", "yyyy"), "o_orderpriority")).otherwise(F.concat(F.lit("模拟题 "), F.col("o_orderkey").cast("string")))
    return read(spark, d, "orders").select("o_orderkey", label.alias("label"))


@query("f33_fingerprints", "SELECT event_id, left(sha256(user_id || ':' || event_id || ':' || event_type), 32) AS fingerprint FROM events")
def fingerprints(spark, d):
    return read(spark, d, "events").select("event_id", text.fingerprint(F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("event_type")).alias("fingerprint"))


@query("w02_ranked_top", "WITH s AS (SELECT c_mktsegment, c_custkey, round_even(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY s DESC, c_custkey)::INT AS rank FROM s QUALIFY rank <= 5")
def top_of_group(spark, d):
    """Top five of each group, by a window that keeps only its limit in each task."""
    spent = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bround(F.sum("o_totalprice"), 2).alias("s")).join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    rank = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.desc("s"), "c_custkey"))
    return spent.withColumn("rank", rank).where("rank <= 5").select("c_mktsegment", "c_custkey", "rank")

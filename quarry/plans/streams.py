"""Streaming queries: the event table as a stream, all there is, into a table that is then read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.plans.frames import SUBMISSIONS_SQL
from quarry.plans.learning import ORDER
from quarry.plans.registry import query
from quarry.sources.tables import read, shared_dir
from quarry.streaming import streams as T


def events(spark, d):
    # a stream reads folders or patterns, not single files
    return spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")


def _saved(spark, stream, mode="append"):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return T.to_table(stream, f"{base}/out", f"{base}/state", mode)


@query("k11_stream_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_no FROM events")
def sequence(spark, d):
    return _saved(spark, T.numbered(events(spark, d).select("event_id", "user_id", "ts"), "user_id", ORDER)).select("event_id", "user_id", "sequence_no")


@query("k13_stream_once", "SELECT DISTINCT user_id, event_type FROM events")
def once(spark, d):
    return _saved(spark, T.once(events(spark, d).select("user_id", "event_type"), ["user_id", "event_type"]))


@query("w04_stream_mastery", f"WITH {SUBMISSIONS_SQL} SELECT user_id, count(*)::BIGINT AS n, list_reduce(list_prepend(0.5::DOUBLE, list(ratio ORDER BY ts, event_id)), lambda a, x: round_even(greatest(0, least(1, 0.7::DOUBLE * a + 0.3::DOUBLE * x)), 4)) AS level FROM sub GROUP BY user_id")
def mastery(spark, d):
    """The level after the last batch of each user, equal to the batch form."""
    sub = events(spark, d).select("user_id", "ts", "event_id", F.least(F.lit(1.0), F.col("value") / 500).alias("ratio"))
    found = _saved(spark, T.running_mastery(sub, "user_id", ORDER, "ratio"), "update")
    return found.groupBy("user_id").agg(F.max_by(F.struct("n", "level"), "n").alias("x")).select("user_id", "x.n", "x.level")


@query("k19_stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round_even(sum(value), 4) AS total FROM events GROUP BY ALL")
def windows(spark, d):
    found = _saved(spark, T.windowed(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", None, ["event_type"], "1 hour", F.count("*").alias("n"), F.sum("value").alias("total")), "complete")
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.bround("total", 4).alias("total"))

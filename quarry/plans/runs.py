"""Runs that stop and go on, and table functions called from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import runs, tablefunctions
from quarry.plans import frames
from quarry.plans.frames import SUBMISSIONS_SQL
from quarry.plans.registry import query
from quarry.sources.store import Store
from quarry.sources.tables import read, shared_dir


def _stages(fails: int) -> list[runs.Stage]:
    """Three stages over documents, of which the last fails a number of times."""
    left = [fails]

    def totals(rows: DataFrame) -> DataFrame:
        if left[0]:
            left[0] -= 1
            raise OSError("a worker was lost")
        return rows.groupBy("lang", "source").agg(F.count("*").alias("texts"), F.sum("copies").alias("copies"), F.max("doc_id").alias("newest"))

    return [
        ("present", lambda rows: rows.where("text is not null").select("doc_id", "text", "lang", "source")),
        ("different", lambda rows: rows.groupBy("text", "lang", "source").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("text")),
        ("totals", totals),
    ]


def _stopped_and_resumed(spark, d) -> tuple[Store, DataFrame]:
    store, docs = Store(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"), read(spark, d, "documents")
    for until in (1, 2):  # the driver stops after each stage
        runs.run(store, "r", _stages(1)[:until], docs)
    return store, runs.run(store, "r", _stages(1), docs)


_DIFFERENT = "different AS (SELECT text, lang, source, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL), totals AS (SELECT lang, source, count(*)::BIGINT AS texts, sum(copies)::BIGINT AS copies, max(doc_id) AS newest FROM different GROUP BY ALL)"


@query("k16_resumed_run", f"WITH {_DIFFERENT} SELECT * FROM totals")
def resumed_run(spark, d):
    """The result of a run that stops after each stage and whose last stage fails once."""
    return _stopped_and_resumed(spark, d)[1]


@query(
    "k18_run_progress",
    f"WITH {_DIFFERENT} SELECT * FROM (VALUES (1::BIGINT, 'present', 1::INT, 'succeeded', (SELECT count(*) FROM documents WHERE text IS NOT NULL)::BIGINT), (2, 'different', 1, 'succeeded', (SELECT count(*) FROM different)), (3, 'totals', 1, 'failed', NULL), (4, 'totals', 2, 'succeeded', (SELECT count(*) FROM totals))) t(sequence_no, stage, attempt, status, n)",
)
def run_progress(spark, d):
    return runs.progress(_stopped_and_resumed(spark, d)[0], "r").select("sequence_no", "stage", "attempt", "status", "n")


@query("x13_table_function", f"WITH {SUBMISSIONS_SQL} SELECT point, user_id, count(*)::BIGINT AS n, list_reduce(list_prepend(0.5::DOUBLE, list(ratio ORDER BY ts, event_id)), lambda a, x: round_even(greatest(0, least(1, 0.7::DOUBLE * a + 0.3::DOUBLE * x)), 4)) AS level FROM sub GROUP BY ALL")
def table_function(spark, d):
    """Mastery of each user and point by a table function in SQL; its key is a struct, whose type the function takes from the table."""
    tablefunctions.register(spark)
    name = f"submissions_{uuid.uuid4().hex}"
    frames.submissions(spark, d).withColumn("who", F.struct("user_id", "point")).createOrReplaceTempView(name)
    return spark.sql(f"SELECT who.point, who.user_id, n, level FROM mastery_fold(TABLE({name}) PARTITION BY who ORDER BY (ts, event_id), 'who', 'ratio')")

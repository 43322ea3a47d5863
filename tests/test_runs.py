"""Runs that stop, percentiles of each key, and table functions."""

from __future__ import annotations

import random
import uuid

import pytest

from quarry.operators import evaluation, ordered, runs, tablefunctions
from quarry.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def stages(worked, fail=()):
    fail = list(fail)

    def stage(name):
        def work(rows):
            worked.append(name)
            if name in fail:
                fail.remove(name)
                raise OSError("lost")
            return rows.selectExpr(f"concat(path, '{name}') as path")

        return name, work

    return [stage(n) for n in "abc"]


def test_stop_after_each_stage(spark, store):
    source, worked = spark.createDataFrame([("",)], "path string"), []
    for until in (1, 2, 3, 3):
        out = runs.run(store, "r", stages(worked)[:until], source)
    assert [r["path"] for r in out.collect()] == ["abc"]
    assert worked == ["a", "b", "c"]
    assert [r["path"] for r in runs.run(store, "other", stages(worked), source).collect()] == ["abc"]
    assert worked == ["a", "b", "c"] * 2


def test_failures_are_noted_and_bounded(spark, store):
    source, worked = spark.createDataFrame([("",)], "path string"), []
    assert [r["path"] for r in runs.run(store, "r", stages(worked, "bb"), source).collect()] == ["abc"]
    assert worked == ["a", "b", "b", "b", "c"]
    assert [(r["sequence_no"], r["stage"], r["attempt"], r["status"]) for r in runs.progress(store, "r").collect()] == [
        (1, "a", 1, "succeeded"), (2, "b", 1, "failed"), (3, "b", 2, "failed"), (4, "b", 3, "succeeded"), (5, "c", 1, "succeeded"),
    ]
    with pytest.raises(runs.Failed):
        runs.run(store, "s", stages(worked, "aaaa"), source)
    with pytest.raises(runs.Failed):
        runs.run(store, "s", stages(worked), source)
    assert runs.progress(store, "s").count() == 3


def test_stage_whose_job_fails(spark, store):
    """A stage is lazy; that its job fails is a failure of the stage, and nothing of it stays in force."""
    bad = [("bad", lambda rows: rows.selectExpr("raise_error('no') as path"))]
    with pytest.raises(runs.Failed):
        runs.run(store, "r", bad, spark.createDataFrame([("",)], "path string"), attempts=1)
    assert [r["status"] for r in runs.progress(store, "r").collect()] == ["failed"]


@pytest.mark.parametrize("few", [1000, 3])
def test_percentiles_of_each_key(spark, monkeypatch, many_parts, few):
    monkeypatch.setattr(ordered, "FEW", few)
    r = random.Random(3)
    rows = [("hot", float(r.randrange(3000))) for _ in range(6000)] + [("tied", 7.0) for _ in range(2500)] + [("tied", 9.0)] * 140
    rows += [(k, r.random()) for k in "abc" for _ in range(r.randrange(1, 9))] + [(None, 1.0), (None, 4.0), ("none", None)]
    r.shuffle(rows)
    got = {x["k"]: tuple(x)[1:] for x in evaluation.latency_by(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        v = sorted(v for key, v in rows if key == k and v is not None)
        n = len(v)
        want[k] = (n, (v[(n - 1) // 2] + v[n // 2]) / 2, v[-(-95 * n // 100) - 1], v[min(95 * n // 100, n - 1)], v[-1])
    assert got == want
    assert evaluation.latency_by(spark.createDataFrame([], "k string, v double"), ["k"], "v").collect() == []


def test_table_function_equals_the_batch_form(spark):
    r = random.Random(4)
    rows = [(r.randrange(4), i, r.choice([None, 0.1, 0.45, 0.8, 1.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "student int, at int, ratio double").repartition(5)
    tablefunctions.register(spark)
    name = f"t_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    got = spark.sql(f"SELECT * FROM mastery_fold(TABLE({name}) PARTITION BY student ORDER BY (at), 'student', 'ratio')")
    assert got.schema.simpleString() == "struct<student:int,n:bigint,level:double>"
    want = ordered.mastery(df, ["student"], ["at"], "ratio")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="no column"):
        spark.sql(f"SELECT * FROM mastery_fold(TABLE({name}) PARTITION BY student ORDER BY (at), 'nobody', 'ratio')").collect()

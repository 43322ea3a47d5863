"""Numbering, counts and rate limits where one key has most of the rows: equal to a model, and no task has the key as a whole."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.operators import ordered as O


def attempts(n, seed, step):
    rng = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, step])
        out.append((None if i % 17 == 0 else 1 if rng.random() < 0.7 else rng.randrange(2, 9), t, i))
    return out + [(5, None, n), (1, None, n + 1)]


def model(rows, most, span):
    held, out = defaultdict(list), {}
    for k, t, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        if t is None:
            out[i] = False
            continue
        held[k] = [x for x in held[k] if x > t - span]
        out[i] = len(held[k]) < most
        if out[i]:
            held[k].append(t)
    return out


@pytest.mark.parametrize("seed, step, most, span", [(1, 3, 5, 300), (2, 40, 2, 60), (3, 1, 5, 7), (4, 500, 1, 300)])
def test_rate_limit(spark, many_parts, seed, step, most, span):
    rows = attempts(3000, seed, step)
    df = spark.createDataFrame(rows, "k long, t long, i long").repartition(4)
    got = O.allowed_attempts(df, ["k"], "t", ["i"], most, span)
    assert got.columns == ["k", "t", "i", "accepted"]
    assert {r["i"]: r["accepted"] for r in got.collect()} == model(rows, most, span)
    assert O.allowed_attempts(df.limit(0), ["k"], "t", ["i"]).collect() == []


def test_sequence(spark, many_parts):
    rows = attempts(3000, 5, 2)
    df = spark.createDataFrame(rows, "k long, t long, i long").repartition(4)
    count, want = defaultdict(int), {}
    for k, t, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i] = count[k] + 1
        count[k] += 1
    got = O.sequence(df, ["k"], ["t", "i"], "no", 1)
    assert {r["i"]: r["no"] for r in got.collect()} == want
    assert O.sequence(df.limit(0), ["k"], ["t", "i"]).collect() == []
    sizes = O.placed(df, ["k", "t", "i"]).where("k = 1").groupBy("__part").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 1000  # of some 2,000 rows of the key


def test_counts_in_a_window(spark, many_parts):
    rows = [r for r in attempts(1500, 6, 5)]
    df = spark.createDataFrame(rows, "k long, t long, i long").repartition(4)
    got = {r["i"]: r["recent"] for r in O.in_window(df, ["k"], F.col("t"), 30).where("t is not null").collect()}
    assert got == {i: sum(1 for k2, t2, _ in rows if k2 == k and t2 is not None and t - 29 <= t2 <= t - 1) for k, t, i in rows if t is not None}

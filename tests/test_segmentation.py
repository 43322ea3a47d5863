"""Best paths against all ways to cut, and what segmentation does for keyword search."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from quarry.operators import segmentation as S
from quarry.plans import catalog


def brute(run, counts, total):
    unknown = S.Segmenter.weight(1, 2 * total)
    best = None
    for cut in product([0, 1], repeat=max(0, len(run) - 1)):
        words, now = [], run[:1]
        for c, stop in zip(run[1:], cut):
            if stop:
                words.append(now)
                now = c
            else:
                now += c
        words.append(now)
        if all(w in counts or len(w) == 1 for w in words):
            score = sum(S.Segmenter.weight(counts[w], total) if w in counts else unknown for w in words)
            key = (score, [len(w) for w in words])
            best = max(best, (key, words)) if best else (key, words)
    return best[1]


@pytest.mark.parametrize("seed", range(4))
def test_best_path(seed, monkeypatch):
    rng = random.Random(seed)
    chars = "二三四五大"
    word = lambda n: "".join(rng.choice(chars) for _ in range(n))
    counts = {word(rng.randrange(1, 5)): rng.choice([1, 1, 2, 8, 50]) for _ in range(25)}
    total = sum(counts.values()) + rng.choice([0, 100])
    runs = [word(rng.randrange(1, 11)) for _ in range(60)] + ["", "龙", "二龙三"]
    monkeypatch.setattr(S, "TOGETHER", 30)
    got = S.Segmenter(counts, total).segment(runs)
    assert got == [brute(r, counts, total) if r else [] for r in runs]


def test_without_a_dictionary_every_character_is_a_word():
    assert S.Segmenter({}).segment(["二三", ""]) == [["二", "三"], []]
    assert S.Segmenter({}).segment([]) == []


def test_columns(spark):
    words = spark.createDataFrame([("学习",), ("学习",), ("机器",), ("机器",), ("abc",), (None,), ("方法",), ("一个",)], "word string")
    split = S.word_splitter(S.fit(words), spark)
    df = spark.createDataFrame([(1, "机器学习方法 GPU2 the 一个"), (2, None), (3, ""), (4, "x 龙 学习学习")], "i long, t string").withColumn("tokens", F.lit(0))
    got = {r["i"]: r["s"] for r in df.select("i", split(F.col("t")).alias("s")).collect()}
    assert got == {1: ["机器", "学习", "方法", "GPU2"], 2: [], 3: [], 4: ["学习", "学习"]}


def test_recall_before_and_after(spark):
    rows = catalog.QUERIES["f01_keyword_recall"](spark, "/root/testdata/sf0.001").collect()
    wanted, run, word = (sum(r[c] for r in rows) for c in ("n_wanted", "n_by_run", "n_by_word"))
    print("recall by run", run / wanted, "by word", word / wanted)
    assert word > 0.6 * wanted and word > 2 * run


def test_token_lists_are_worked_on_in_slices():
    import pyarrow as pa

    lists = [["ab"] * n for n in (3, 0, 50, 1, 1)] + [None, ["c", None]]
    array = pa.array([["x"], *lists], pa.list_(pa.string())).slice(1)
    parts = [p.to_pylist() for p in S.pieces_of(array, 8)]
    assert sum(parts, []) == lists and all(len(p) == 1 or sum(len(t or "") for r in p for t in r or []) <= 8 for p in parts)
    assert list(S.pieces_of(array.slice(0, 0), 8)) == []


def test_steps_of_long_runs_cost_a_few_calls():
    """A run's length is a number of steps, each over few runs; a call for each length of word took most of the time."""
    import cProfile
    import pstats

    seg = S.Segmenter({"二三四五六七八": 3, "二三": 5, "三四": 4, "八二": 2})
    profile = cProfile.Profile()
    assert profile.runcall(seg.segment, ["二三四五六七八" * 300])[0] == ["二三四五六七八"] * 300
    assert pstats.Stats(profile).total_calls < 2100 * 7

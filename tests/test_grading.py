"""The grading transaction against a model: replays, conflicts, a writer that dies, a user with most of the rows."""

from __future__ import annotations

import datetime
import random

import pytest

from quarry.operators import grading as G
from quarry.sources.store import Conflict, Store

T0 = datetime.datetime(2024, 1, 1)


def grid(x):
    return round(x * 10_000) / 10_000  # levels have four places, half to even


def rows(n=300, seed=1, hot=0.4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = 1 if rng.random() < hot else rng.randrange(2, 12)
        out.append((user, f"k{rng.randrange(n)}", f"i{rng.randrange(n)}", rng.choice(["p", "q"]), T0 + datetime.timedelta(seconds=rng.randrange(n // 2)), i, f"a{i}",
                    None if rng.random() < 0.05 else rng.choice([0.0, 3.33, 5.0, 8.0, 9.0, 10.0]), rng.choice([10.0, 12.0, 0.5]), rng.choice([0.0, 0.9, 0.9, None]), rng.choice([True, False, False, None])))
    return out


class Model:
    def __init__(self):
        self.done, self.items, self.state, self.log, self.mistakes = set(), set(), {}, [], {}

    def submit(self, batch):
        seen, out = set(), {}
        for user, key, item, point, at, seq, answer, score, most, sure, review in sorted(batch, key=lambda r: (r[4], r[5])):
            if (user, key) in self.done | seen:
                out[seq] = "replayed"
                continue
            seen.add((user, key))
            if score is None:
                out[seq] = "failed"
            elif (user, item) in self.items:
                out[seq] = "already_graded"
            else:
                out[seq] = "accepted"
                self.items.add((user, item))
                self.grade(user, key, item, point, at, seq, score, most, sure, review)
        return out

    def grade(self, user, key, item, point, at, seq, score, most, sure, review):
        self.done.add((user, key))
        ratio = round(score / max(most, 1.0) + 1e-12, 2)
        level, streak, attempts, correct, last = self.state.get((user, point), (0.5, 0, 0, 0, None))
        before = (level, streak)
        if (sure or 0) > 0 and not review:
            level, streak = grid(min(1, max(0, 0.7 * level + 0.3 * ratio))), streak + 1 if ratio >= 0.8 else 0
            twice = last is not None
            step = 1 if twice and min(ratio, last) >= 0.8 else -1 if twice and max(ratio, last) < 0.5 else 0
            attempts, correct, last = attempts + 1, correct + (ratio >= 0.8), ratio
        else:
            step = 0
        self.state[user, point] = (level, streak, attempts, correct, last)
        self.log.append((user, point, "grade_result" if ratio >= 0.8 else "wrong_answer", *before, level, streak))
        if step:
            self.log.append((user, point, f"difficulty 2→{2 + step}", level, streak, level, streak))
        if step > 0:
            self.log.append((user, point, "status→mastered", level, streak, level, streak))
        if ratio < 0.8 or review:
            self.mistakes[user, item] = (point, 1, score)


def tables(store):
    state = store.manifest()
    read = lambda t: store.read(t, G.SCHEMAS[t], state).collect()
    return {
        "state": {(r["user_id"], r["point"]): (r["level"], r["streak"], r["attempts"], r["correct"], r["last_ratio"]) for r in read("mastery")},
        "log": sorted((r["user_id"], r["point"], r["reason"], r["before_level"], r["before_streak"], r["after_level"], r["after_streak"]) for r in read("log")),
        "mistakes": {(r["user_id"], r["item_id"]): (r["point"], r["error_count"], r["last_score"]) for r in read("mistakes")},
        "done": {(r["user_id"], r["request_key"]) for r in read("requests")},
        "n": (len(read("submissions")), len(read("grades"))),
    }


def test_transaction(spark, tmp_path):
    store, model, all_ = Store(spark, f"file://{tmp_path}/s", 4), Model(), rows()
    frame = lambda x: spark.createDataFrame(x, G.REQUEST).repartition(5)
    assert store.manifest()["tables"] == {} and G.submit(store, frame([])).collect() == [] and store.version() == 0
    for n, batch in enumerate([all_[:120], all_[120:], all_]):
        got = {r["seq"]: r["outcome"] for r in G.submit(store, frame(batch)).collect()}
        assert got == model.submit(batch)
        now = tables(store)
        assert now["state"] == model.state and now["log"] == sorted(model.log) and now["mistakes"] == model.mistakes and now["done"] == model.done
        assert now["n"] == (len(model.done),) * 2
    version, held = store.version(), tables(store)
    G.submit(store, frame(all_))
    assert store.version() == version and tables(store) == held


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", 4)
    G.submit(store, spark.createDataFrame(rows(40), G.REQUEST))
    held, version = tables(store), store.version()
    from quarry.sources.store import Commit

    for table in ("append", "upsert", "finish"):
        for after in (1, 2):
            calls = []

            def dying(self, *a, real=getattr(Commit, table)):
                calls.append(1)
                if len(calls) == after:
                    raise KeyboardInterrupt
                return real(self, *a)

            with monkeypatch.context() as m:
                m.setattr(Commit, table, dying)
                if table == "finish" and after == 2:
                    continue
                with pytest.raises(KeyboardInterrupt):
                    G.submit(store, spark.createDataFrame(rows(40, seed=2), G.REQUEST))
            assert tables(store) == held and store.version() == version
    G.submit(store, spark.createDataFrame(rows(40, seed=2), G.REQUEST))
    assert store.version() == version + 1


def test_of_two_writers_one_conflicts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 4)
    one, two = store.begin(), store.begin()
    df = spark.createDataFrame([(1, "k", "i")], G.SCHEMAS["requests"])
    one.append("requests", df)
    two.append("requests", df)
    assert one.finish() == 1
    with pytest.raises(Conflict):
        two.finish()
    assert store.version() == 1 and store.read("requests", G.SCHEMAS["requests"]).count() == 1


def test_a_key_over_many_parts(spark, many_parts):
    n, rng = 5000, random.Random(3)
    data = [(1 if i % 3 else 2, i, rng.choice([0.0, 0.4, 0.8, 0.85, 1.0]), rng.random() < 0.9, False, None, None, None) for i in range(n)]
    data += [(1, -1, None, False, True, 0.9, 3, 0.8), (3, 0, 1.0, True, False, None, None, None)]
    df = spark.createDataFrame(data, "k long, at long, ratio double, counts boolean, is_state boolean, level double, streak long, last_ratio double")
    got = {(r["k"], r["at"]): (r["before_level"], r["after_level"], r["before_streak"], r["after_streak"], r["before_ratio"]) for r in G.running_mastery(df, ["k"], ["at"]).collect()}
    want, now = {}, {1: (0.9, 3, 0.8)}
    for k, at, ratio, counts, *_ in sorted(d for d in data if not d[4]):
        level, streak, last = now.get(k, (0.5, 0, None))
        after = (grid(min(1, max(0, 0.7 * level + 0.3 * ratio))), streak + 1 if ratio >= 0.8 else 0, ratio) if counts else (level, streak, last)
        want[k, at], now[k] = (level, after[0], streak, after[1], last), after
    assert got == want


def test_ratios_are_rounded_as_in_sql(spark, tmp_path):
    import duckdb

    values = [17.0, 23.0, 29.0, 81.0, 115.0, 137.0, 187.0, 24.6]
    store = Store(spark, f"file://{tmp_path}/s", 4)
    data = [(i, f"k{i}", "i", "p", T0, i, "", v / 20, 10.0, 1.0, False) for i, v in enumerate(values)]
    G.submit(store, spark.createDataFrame(data, G.REQUEST))
    got = {r["user_id"]: r["last_ratio"] for r in store.read("mastery", G.SCHEMAS["mastery"]).collect()}
    assert got == {i: duckdb.execute("select round(?::double / 20 / 10, 2)", [v]).fetchone()[0] for i, v in enumerate(values)}


def test_an_upsert_of_new_keys_leaves_folders_as_they_are(spark, tmp_path):
    store, schema = Store(spark, f"file://{tmp_path}/s", 2), "k long, v long"

    def put(keys, v):
        commit = store.begin()
        commit.upsert("t", spark.createDataFrame([(k, v) for k in keys], schema), ["k"])
        commit.finish()
        return store.manifest()["tables"]["t"]["folders"]

    one = put(range(20), 0)
    two = put(range(20, 40), 1)
    assert all(set(one[b]) < set(two[b]) for b in one)
    three = put(range(10, 30), 2)
    assert all(len(f) == 1 for f in three.values())
    assert {(r["k"], r["v"]) for r in store.read("t", schema).collect()} == {(k, 0 if k < 10 else 2 if k < 30 else 1) for k in range(40)}

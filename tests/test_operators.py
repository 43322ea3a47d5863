"""Rules and operators on literal rows and against small models."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import jsons, numeric, text
from quarry.operators import evaluation, ingestion, ordered, reports, retrieval, validation
from quarry.sources import tables
from quarry.streaming import streams


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_tokens_of_mixed_script(spark):
    rows = [("数据库 the Index 的 B a1 一 ix",), ("",), (None,)]
    assert values(spark, rows, "t string", text.tokens(F.col("t"))) == [["数据库", "index", "a1", "ix"], [], []]


def test_answers(spark):
    rows = [("Ａ１　 x\n",), (None,)]
    assert values(spark, rows, "t string", text.normalized_answer(F.col("t"))) == ["a1 x", None]
    rows = [("about 3.1e2 m",), ("none",), ("-5",)]
    assert values(spark, rows, "t string", text.first_number(F.col("t"))) == [310.0, None, -5.0]
    rows = [("19.9", True), ("19.7", False), ("20 units", True), ("twenty", True), ("x", False)]
    got = values(spark, [r[:1] for r in rows], "t string", text.blank_is_right(F.col("t"), F.lit("20"), F.array(F.lit("Twenty"))))
    assert got == [r[1] for r in rows]


@pytest.mark.parametrize(("line", "level"), [("第一章 绪论", 1), ("[HEADING] 第二节 索引", 1), ("1.2 Joins", 2), ("(3) step", 2), ("3) step", 3), ("A short line", 3), ("This sentence ends with a stop and it is long.", 0), ("[HEADING] " + "x" * 40, 1)])
def test_heading_levels(spark, line, level):
    assert values(spark, [(line,)], "t string", text.heading_level(F.col("t"))) == [level]


def test_heading_levels_against_sql(spark):
    import duckdb

    from quarry.plans import ingestion

    starts = ["第三章", "第12节 ", "第章 ", "1.2.3 ", "1.2.3.4 ", "7 ", "三、", "十", "（二）", "(12)", "B.", "E.", "9、", "4)", "⑩", "⑪", "Plain "]
    lines = [m + s + body for m in ("", "[HEADING] ", "[HEADING]") for s in starts for body in ("", "x", "x。", "y" * 24, "y" * 35, "y" * 45, "y" * 70)]
    found = values(spark, [(line,) for line in lines], "t string", text.heading_level(F.col("t")))
    con = duckdb.connect()
    con.execute("CREATE TABLE lines (n INT, content VARCHAR)")
    con.executemany("INSERT INTO lines VALUES (?, ?)", [[n, line.strip()] for n, line in enumerate(lines)])
    want = con.execute(f"WITH layout AS (SELECT * FROM lines) SELECT {ingestion.LEVEL_SQL} FROM ({ingestion.TITLES}) ORDER BY n").fetchall()
    assert found == [w for (w,) in want] and set(found) == {0, 1, 2, 3}


def test_question(spark):
    body = ["1. 选择正确的 (5分)", "A. one B. two C. three D. four", "答案：B", "知识点：索引", "2、计算 x", "1. 选择正确的 (5分)", "again", "第一章 x"]
    lay = spark.createDataFrame([(1, 1, i, "text", t, 1.0) for i, t in enumerate(body)], "document_id long, page_no int, reading_order int, block_type string, content string, confidence double")
    rows = {r["question_no"]: r for r in ingestion.questions(lay).collect()}
    assert set(rows) == {"1", "2"}
    q = rows["1"]
    assert (q["type"], q["answer"], q["confidence"], q["score"], q["hints"]) == ("choice", "B", 0.95, 5.0, ["索引"])
    assert q["stem"] == "选择正确的 (5分)" and [o["id"] for o in q["options"]] == ["A", "B", "C", "D"] and q["options"][0]["text"] == "one"
    assert rows["2"]["type"] == "calculation"


def test_sections(spark):
    body = [("text", "intro that ends here and is quite long, yes."), ("text", "第一章 a"), ("formula", "$x$"), ("text", "第二章 b"), ("table", "t"), ("text", "第三章 c")]
    lay = spark.createDataFrame([(1, 1, i, k, t, 1.0) for i, (k, t) in enumerate(body)], "document_id long, page_no int, reading_order int, block_type string, content string, confidence double")
    rows = sorted((r["section_no"], r["heading"], r["paragraphs"]) for r in ingestion.sections(lay).collect())
    assert rows == [(0, None, [body[0][1]]), (1, "第一章 a", ["[公式] $x$"]), (3, "第三章 c", [])]


def model_cut(t, target=500, most=800):
    """The same rule, written as a search over all breaks for each piece."""
    if len(t) <= most:
        return [t]
    ends = [m.end() for m in re.finditer(ingestion.BREAK, t)]
    if not ends:
        return [t[i : i + most] for i in range(0, len(t), target)]
    out, at = [], 0
    while at < len(t):
        good = [e for e in ends if at + target <= e <= at + most]
        early = [e for e in ends if at < e < min(at + 2 * target, len(t))]
        end = good[0] if good else early[0] if early else min(at + 2 * target, len(t))
        out.append(t[at:end].strip())
        at = end
    return [x for x in out if x]


def test_cut_against_model():
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["word ", "w" * rng.randint(1, 400), ". ", "。", "\n"]) for _ in range(rng.randint(1, 60)))
        assert list(ingestion.cut(t)) == model_cut(t)


def model_chunks(segments):
    parts = [dict(s, text=p) for s in segments for p in ([s["text"]] if s["exam"] else model_cut(s["text"]))]
    merged = []
    for p in parts:
        b = merged[-1] if merged else None
        if b and len(b["text"]) < 100 and not b["heading"] and not b["exam"] and not p["exam"] and b["page_no"] == p["page_no"] and b["kind"] == p["kind"] and len(b["text"]) + len(p["text"]) <= 800:
            b["text"] += ("\n" if b["kind"] == "formula" else "") + p["text"]
        else:
            merged.append(dict(p))
    merged = [m for m in merged if m["text"].strip()]
    out = []
    for i, m in enumerate(merged):
        t = m["text"]
        if i:
            tail = merged[i - 1]["text"][-80:]
            clean = tail.lstrip("，。！？；：、,.;:!? \t\n")
            t = (tail if len(clean) < 40 else clean) + "\n" + t
        out.append(t.replace("[HEADING] ", "").replace("[HEADING]", ""))
    return out


def test_chunks_against_model(spark):
    rng = random.Random(3)
    docs = []
    for i in range(40):
        segs = []
        for _ in range(rng.randint(1, 30)):
            t = "".join(rng.choice(["abc ", "z" * rng.randint(1, 120), ". ", "。"]) for _ in range(rng.randint(1, 40)))
            segs.append({"text": rng.choice(["", "", "[HEADING] "]) + t, "page_no": rng.randint(1, 2), "kind": rng.choice(["text", "text", "formula"]), "heading": False, "exam": rng.random() < 0.1})
            segs[-1]["heading"] = segs[-1]["text"].startswith("[HEADING]")
        docs.append((i, segs))
    df = spark.createDataFrame(docs, "document_id long, segments array<struct<text:string,page_no:int,kind:string,heading:boolean,exam:boolean>>")
    got = {}
    for r in ingestion.chunks(df).orderBy("document_id", "position").collect():
        got.setdefault(r["document_id"], []).append(r["content"])
    assert got == {i: model_chunks(s) for i, s in docs}


def test_ocr_blocks(spark):
    rows = [(1, 1, 0, "title", "x", [1.0, 2.0, 3.0, 4.0], 0.9), (1, 1, 1, "table", "<tr><td>a</td><td>b</td></tr>", [5.0, 1.0, 9.0, 2.0, 8.0, 7.0, 4.0, 6.0], None), (1, 1, 2, "odd", None, [1.0], 0.5)]
    raw = spark.createDataFrame(rows, "document_id long, page_no int, reading_order int, type string, text string, bbox array<double>, confidence double")
    got = {r["reading_order"]: r for r in ingestion.ocr_blocks(raw).collect()}
    assert got[0]["block_type"] == "text" and got[1]["bbox"] == [4.0, 1.0, 9.0, 7.0] and got[1]["content"] == "a | b |" and got[1]["confidence"] == 0.5
    assert got[2]["bbox"] == [0.0] * 4 and got[2]["content"] == ""


@pytest.mark.parametrize("parts", [1, 7])
def test_mastery_of_a_hot_key(spark, parts):
    rng = random.Random(parts)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 30), i, rng.choice([0.0, 1.0, rng.random(), None])) for i in range(3000)]
    levels = {}
    for k, _, r in rows:
        if r is not None:
            n, now = levels.get(k, (0, 0.5))
            levels[k] = (n + 1, round(max(0.0, min(1.0, 0.7 * now + 0.3 * r)) * 10_000) / 10_000)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "k long, at long, r double").repartition(5)
        assert {r["k"]: (r["n"], r["level"]) for r in ordered.mastery(df, ["k"], ["at"], "r").collect()} == levels
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_mastery_rules(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.9), ("b", 1, 0.3), ("b", 2, 0.4), ("c", 1, 0.9)]
    df = spark.createDataFrame(rows, "k string, at long, r double")
    got = {r["k"]: (r["s"], r["d"]) for r in ordered.last_two(df, ["k"], ["at"], "r").select("k", ordered.status(F.col("last"), F.col("before")).alias("s"), ordered.difficulty(F.col("last"), F.col("before"), F.lit(2)).alias("d")).collect()}
    assert got == {"a": ("mastered", 3), "b": ("pending", 1), "c": ("pending", 2)}
    ok = df.withColumn("ok", F.col("r") >= 0.8)
    assert {r["k"]: r["streak"] for r in ordered.streaks(ok, ["k"], ["at"], "ok").collect()} == {"a": 2, "b": 0, "c": 1}


def test_rate_limit_against_model(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 3), rng.randint(0, 2000), i) for i in range(300)]
    want, held = {}, {}
    for k, t, i in sorted(rows):
        live = [x for x in held.get(k, []) if x > t - 300]
        want[i] = len(live) < 5
        held[k] = live + [t] * want[i]
    df = spark.createDataFrame(rows, "k long, t long, i long")
    assert {r["i"]: r["accepted"] for r in ordered.allowed_attempts(df, ["k"], "t", ["i"]).collect()} == want


def test_order_statistic(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL", 50)
    rng = random.Random(1)
    xs = [rng.choice([1.0, 2.0, rng.random() * 5]) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (0, 1500, 2000, 3800, 3999):
        assert ordered.order_statistic(df, "x", k) == sorted(xs)[k]


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x long").repartition(6)
    assert [(r["x"], r["n"]) for r in ordered.numbered(df, ["x"], "n").orderBy("n").collect()] == [(i, i + 1) for i in range(101)]


def test_annotation_states(spark):
    ev = "array<struct<document_id:string,pages:array<int>>>"
    cases = spark.createDataFrame([(1, "c", "answer", True, "answer", []), (2, "c", "answer", False, "answer", []), (3, "c", "answer", True, "answer", []), (4, "c", "answer", False, "answer", []), (5, "c", "grade", False, "grade", [])], f"case_id long, category string, expected_behavior string, critical boolean, scoring_policy string, expected_evidence {ev}")
    results = spark.createDataFrame([(1, "answer"), (2, "refuse"), (3, "answer"), (4, "answer")], "case_id long, actual_behavior string")
    j = lambda a, c="pass": {"answer": a, "citation": c}
    ann = spark.createDataFrame([(1, "x", 0, j("fail")), (1, "x", 1, j("pass")), (1, "y", 0, j("fail", "na")), (3, "x", 0, j("pass")), (4, "x", 0, j("fail")), (4, None, 0, j("pass"))], "case_id long, annotator_id string, seq int, judgments map<string,string>")
    arb = spark.createDataFrame([(1, "answer", "pass", 0)], "case_id long, metric string, judgment string, seq int")
    pol = spark.createDataFrame(list(evaluation.POLICY_DIMENSIONS.items()), "scoring_policy string, dimensions array<string>")
    got = {(r["case_id"], r["metric"]): r["state"] for r in evaluation.annotation_states(cases, results, ann, arb, pol).collect()}
    assert got == {
        (1, "answer"): "arbitrated_pass", (1, "citation"): "incomplete", (2, "answer"): "misbehaved", (2, "citation"): "misbehaved", (3, "answer"): "incomplete",
        (3, "citation"): "incomplete", (4, "answer"): "fail", (4, "citation"): "pass", (5, "grading"): "incomplete",
    }


def test_sufficiency_rules(spark):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["q", "q", "q", "计算 x", "见图", "q", "q"])], "query_id long, query string")
    refs = spark.createDataFrame([(1, "[答案] x", 1.0, "d"), (2, "text", 0.01, "d"), (3, "text", 1.0, "d"), (4, "[图1] text", 1.0, "d"), (5, "不是 a", 1.0, "d"), (5, "但 b", 1.0, "e"), (5, "c", 1.0, "d"), (6, "fine", 1.0, "d")], "query_id long, excerpt string, score double, document_id string")
    got = {r["query_id"]: r["reason"] for r in retrieval.sufficiency(q, refs).collect()}
    assert got == dict(enumerate(["no_results", "staff_only", "topic_mismatch", "missing_condition", "image_unavailable", "conflicting", "sufficient"]))


def test_cosine_blocks(spark):
    rng = random.Random(4)
    vs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None), (62, [1.0])]
    v = spark.createDataFrame(vs, "chunk_id long, embedding array<float>")
    q = v.where("chunk_id < 10 or chunk_id = 60").select(F.col("chunk_id").alias("query_id"), "embedding")
    a, b = (sorted(map(tuple, retrieval.top(retrieval.cosine_top(q, v, 5, block=n), 5).select("query_id", "rank", "chunk_id").collect())) for n in (3, 100))
    assert a == b and len(a) == 50 and all(r == (r[0], 1, r[0]) for r in a if r[1] == 1)


def test_pages_and_labels(spark):
    rows = [("看前两页",), ("第2页",), ("other",)]
    assert values(spark, rows, "t string", retrieval.explicit_pages(F.col("t"))) == [[1, 2], [2], []]


def test_json(spark):
    rows = [('{"a": 1}',), ('x ```json\n{"a": {"b": 2}}\n``` y',), ("say {\"a\": [1]} now",), ("{broken",), (None,)]
    assert values(spark, rows, "t string", jsons.repaired(F.col("t"))) == ['{"a": 1}', '{"a": {"b": 2}}', '{"a": [1]}', None, None]
    rows = [('{"x": [{"Step_Scores": 1}]}',), ('{"x": "\\"rubric\\": 1"}',), ('{"rubric_hidden": {"private": 1}}',)]
    assert values(spark, rows, "t string", jsons.has_key(F.col("t"))) == [True, False, True]
    assert values(spark, rows, "t string", jsons.leaks(F.col("t"))) == [["$.x[0].Step_Scores"], [], ["$.rubric_hidden.private"]]
    rows = [('{"a": [[1, {"Private": 2}], "x:", {"b": "private", "rubric": {"step_scores": []}}], "$$about": {"rubric": 1}, "rubric": 0}',), ("no json",), (None,), ('{"p\\"": [",", "]"], "l": [{}, {}, {"private": 1}]}',)]
    assert values(spark, rows, "t string", jsons.leaks(F.col("t"))) == [["$.a[0][1].Private", "$.a[2].rubric", "$.a[2].rubric.step_scores", "$.rubric"], None, None, ["$.l[2].private"]]
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "string", "minLength": 2, "enum": ["ab", "c"], "pattern": "^a"}}}
    rows = [('{"k": "ab"}',), ('{"k": "c"}',), ("{}",), ('{"k": 5}',), ("[]",), ("no",)]
    got = values(spark, rows, "t string", jsons.schema_errors(F.col("t"), schema))
    assert got[0] == [] and set(got[1]) == {"$.k: breaks minLength", "$.k: breaks pattern"} and got[2] == ["$: k is missing"]
    assert "$.k: type is not string" in got[3] and got[4] == ["$: type is not object"] and got[5] == ["$: not JSON"]


def test_moves_and_errors(spark):
    rows = [(1, 1, "pending"), (1, 2, "running"), (1, 3, "running"), (1, 4, "pending"), (2, 1, "succeeded"), (2, 2, "pending")]
    log = spark.createDataFrame(rows, "j long, at long, status string")
    assert sorted((r["j"], r["at"]) for r in reports.bad_moves(log, ["j"], ["at"]).collect()) == [(1, 4), (2, 2)]
    rows = [("ValueError", "x"), ("E", "bad FORMAT"), ("E", None)]
    assert values(spark, rows, "n string, m string", reports.error_kind(F.col("n"), F.col("m"))) == ["failed_permanent", "failed_permanent", "failed_retryable"]
    assert values(spark, [(1,)], "x int", numeric.cost(F.lit("nothing"), F.lit(1), F.lit(1))) == [-1.0]


def test_manifest_and_arbitration(spark):
    m = spark.createDataFrame([("r", "t", " ", "c", {}, {}, None, {})], "run_id string, created_at string, code_commit string, material_commit string, models map<string,string>, prompt_versions map<string,string>, retrieval_parameters map<string,string>, environment map<string,string>")
    assert sorted(r["error"] for r in validation.manifest_errors(m).collect()) == ["code_commit_missing", "retrieval_parameters_missing"]
    cases = spark.createDataFrame([(1,)], "case_id long")
    a = spark.createDataFrame([(1, "answer", "z", "pass", "why"), (1, "answer", "z", "maybe", ""), (2, "refusal", None, "fail", "x")], "case_id long, metric string, arbiter_id string, judgment string, reason string")
    assert sorted((r["case_id"], r["error"]) for r in validation.arbitration_errors(a, cases).collect()) == [(1, "duplicate_arbitration"), (1, "invalid_judgment"), (1, "reason_missing"), (2, "arbiter_missing"), (2, "invalid_metric"), (2, "unknown_case")]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2, "y": "é"}\n')
    df = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int, y string")
    assert sorted(map(tuple, df.collect())) == [(1, None), (2, "é")]
    tables.write_jsonl(df, f"file://{tmp_path}/out")
    assert sorted(map(tuple, tables.read_jsonl(spark, f"file://{tmp_path}/out", "x int, y string").collect())) == [(1, None), (2, "é")]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{bad\n')
    with pytest.raises(Exception, match="not a JSON object"):
        tables.read_jsonl(spark, str(tmp_path / "b.jsonl"), "x int").collect()
    (tmp_path / "up").mkdir()
    for name, data in (("a.PDF", b"%PDF-1"), ("b.png", b"%PDF"), ("c.txt", b"x"), ("d.pdf", b"%PDF" + b"x" * 2_000_000)):
        (tmp_path / "up" / name).write_bytes(data)
    got = {r["name"]: r["error"] for r in tables.read_uploads(spark, f"file://{tmp_path}/up", 1).collect()}
    assert got == {"a.PDF": None, "b.png": "FILE_UNSUPPORTED_TYPE", "c.txt": "FILE_UNSUPPORTED_TYPE", "d.pdf": "FILE_TOO_LARGE"}
    assert values(spark, [(bytearray(),)], "b binary", tables.upload_error(F.lit("e.pdf"), F.col("b"))) == ["FILE_UNSUPPORTED_TYPE"]


@pytest.mark.parametrize("buckets", [0, 4])
def test_replace_documents(spark, tmp_path, buckets):
    path = f"file://{tmp_path}/t"
    rows = lambda *xs: spark.createDataFrame(list(xs), "document_id long, v string")
    tables.replace_documents(rows((1, "a"), (2, "b"), (3, "c")), path, buckets=buckets)
    for _ in range(2):
        tables.replace_documents(rows((2, "x"), (2, "y")), path, buckets=buckets)
    assert sorted((r["document_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "x"), (2, "y"), (3, "c")]


def test_fallback_embeddings(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "document_id long, content string")
    got = {r["document_id"]: r["embedding"] for r in tables.embedded(df, 8).collect()}
    assert got[1] == got[2] != got[3] and abs(sum(x * x for x in got[1]) - 1) < 1e-9


def test_streams_in_two_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = f"file://{tmp_path}/in"
    for n, rows in enumerate([[(1, 1, 1.0), (1, 2, 0.0), (2, 1, 0.9)], [(1, 3, 1.0), (2, 2, 0.9)]]):
        spark.createDataFrame(rows, "k long, at long, r double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, at long, r double").parquet(source)
        found = streams.to_table(streams.numbered(stream, "k", ["at"]), f"file://{tmp_path}/numbers", f"file://{tmp_path}/s1")
        level = streams.to_table(streams.running_mastery(stream, "k", ["at"], "r"), f"file://{tmp_path}/levels{n}", f"file://{tmp_path}/s2", "update")
    assert sorted((r["k"], r["at"], r["sequence_no"]) for r in found.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 0), (2, 2, 1)]
    got = {r["k"]: (r["n"], r["level"], r["streak"], r["status"]) for r in level.where("n > 1").collect()}
    assert got[2] == (2, 0.704, 2, "mastered") and got[1][0] == 3 and got[1][2:] == (1, "pending")
    assert [r["sequence_no"] for r in streams.replay(found, 0, "k", 1).collect()] == [1, 2]

"""The ten operators against brute force, on small tables with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, decontamination, licenses, mixing, pseudonyms, quality, registry, simhash, substring_dedup, suffix_dedup, token_counts, token_files, tokens
from quarry.llm.common import on_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, as a table may have them.
CLASH = {"fp": 1, "spans": "x", "tk": 2, "kept": "y", "leaks": 3, "mix": "z", "quality": 4, "__t": 5, "seed": 6}


def table(spark, texts, extra=False):
    ids = [None if t == "NOID" else i for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if extra else df


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, shared passages, repeats inside a text, multi-byte characters, odd white space, nulls, a long text."""
    rng = random.Random(7)
    shared = prose(rng, 90)
    out = [None, "", "  \t\n ", "one", "É ü 漢字 " * 30, prose(rng, 20_000, 5000)]
    out += [prose(rng, rng.randrange(1, 200)) for _ in range(25)]
    out += [f"{prose(rng, 30)} {shared} {prose(rng, 20)}" for _ in range(6)]
    out += [f"{prose(rng, 5)}\v{shared[:300]}\f{prose(rng, 5)} {shared[100:420]}" for _ in range(3)]
    out += [shared, shared, "é" * 350, "a" * 900, out[8], out[8], "NOID", "x " * 100]
    return out


def with_id(texts):
    return [(None if t == "NOID" else i, t) for i, t in enumerate(texts)]


def test_substring_dedup(spark, texts):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = {}
    for (i, _), w in zip(with_id(texts), words):
        gone = set()
        for a in range(len(w) - 34):
            if seen[tuple(w[a : a + 35])] > 1:
                gone.update(range(a, a + 35))
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeated_windows(table(spark, texts, True)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 900


@pytest.mark.parametrize("hot", [5000, 1])
def test_suffix_dedup(spark, texts, hot, monkeypatch):
    from quarry.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    want = {}
    for (i, _), x in zip(with_id(texts), data):
        gone = np.zeros(len(x), bool)
        for a in range(len(x) - 199):
            if seen[x[a : a + 200]] > 1:
                gone[a : a + 200] = True
        runs = int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum())
        want[i] = (len(x), int(gone.sum()), runs, bytes(b for b, g in zip(x, gone) if not g))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_dedup.remove_repeated_strings(table(spark, texts, True)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 4000


def model_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def model_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        best[find(i)] = min(best.get(find(i), d), d)
    return {d: best[find(i)] for i, d in enumerate(ids)}


def test_simhash_of_texts(spark, texts):
    rows = [(i, t) for i, t in with_id(texts) if i is not None]
    fps = [model_fingerprint(t) for _, t in rows]
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(table(spark, texts, True)).where("doc_id is not null").collect()}
    parts = model_components([i for i, _ in rows], fps)
    assert got == {i: (f, parts[i]) for (i, _), f in zip(rows, fps)}
    kept = {r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect()}
    assert kept - {None} == set(parts.values()) - {None}


@pytest.mark.parametrize("pairs", [32, 2])
def test_simhash_links_find_every_component(spark, pairs, monkeypatch):
    """Clusters around a few centres, small and large, with either way of linking a bucket."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(pairs)
    fps = {0}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([3, 60])):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    root = {r["node"]: r["root"] for r in components.components(links, "test").collect()}
    want = model_components(signed, fps)
    assert {s: root.get(s, s) for s in signed} == want


def test_components_of_a_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "a long, b long"), "test").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def test_thresholds_by_dynamic_programming():
    cost, chosen = simhash.thresholds([{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 9.0, 1: 90.0}], 0)
    assert (cost, chosen) == (7.0, [0, 1, -1])


def test_quality_rules(spark):
    rng = random.Random(2)
    rows = [None, "", "\n".join(prose(rng, 12) + "." for _ in range(8)), "Home | News | Shop | Contact\n" * 20, "short text."]
    rows += ["\n".join([f"Line {i} of {i * i} things is good." for i in range(10)] + ["Accept our cookie policy now."] + ["no stop here"])]
    got = {r["doc_id"]: r["q"] for r in quality.line_quality(table(spark, rows, True), "q").collect()}
    assert [got[i]["kept"] for i in range(6)] == [False, False, True, False, False, True]
    assert got[0]["n_words"] == 0 and got[3]["base_failed"] and got[3]["n_dup_lines"] == 19
    assert "cookie" not in got[5]["text"] and "no stop" not in got[5]["text"] and got[5]["n_bad_lines"] == 2
    kept = quality.keep_good(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and all(r["n_chars"] == len(r["text"]) for r in kept.collect())


def test_pseudonyms(spark):
    card = "4111 1111 1111 1111"
    rows = [f"Pay {card} by 2024-02-29, call +49 30 1234567 or 555-123-4567.", f"{card} again; 29/02/2024; bad 4111 1111 1111 1112, 2023-02-29.", None, "", "Mail jo.doe@example.com from 192.168.0.1, ssn 123-45-6789.", "api_key=abcDEF123456 " * 2000]
    got = {r["doc_id"]: r["pii"] for r in pseudonyms.pseudonyms(table(spark, rows, True)).collect()}
    first, second = got[0]["text"], got[1]["text"]
    new = re.search(r"4\d{3} \d{4} \d{4} \d{4}", first)[0]
    assert new != card and new in second and pseudonyms.luhn_digit(new.replace(" ", "")[:-1]) == new[-1]
    day = re.search(r"(\d{4})-(\d{2})-(\d{2})", first)
    assert "/".join(reversed(day.groups())) in second  # one day, two formats
    assert "4111 1111 1111 1112, 2023-02-29" in second and got[2]["text"] is None and got[3]["n_found"] == 0
    assert [m["kind"] for m in got[4]["matches"]] == ["email", "address", "social"] and got[4]["text"].endswith(".") and "@example.com" in got[4]["text"]
    assert got[5]["n_found"] == 2000
    back = table(spark, rows).select("doc_id", F.lit("").alias("x")).drop("x")
    again = spark.createDataFrame([(i, p["text"]) for i, p in got.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["pii"]["text"] for r in pseudonyms.pseudonyms(again, back=True).collect()} == dict(enumerate(rows)) and back.count() == len(rows)


def test_permutations_are_bijections():
    for size in (2, 7, 100, 366):
        assert sorted(pseudonyms.permuted(i, size, b"k", "t") for i in range(size)) == list(range(size))
        assert all(pseudonyms.permuted(pseudonyms.permuted(i, size, b"k", "t"), size, b"k", "t", True) == i for i in range(size))
    assert [pseudonyms.permuted(i, 1000, b"k", "t") for i in range(50)] != [pseudonyms.permuted(i, 1000, b"l", "t") for i in range(50)]


TEXTS = ["Hello world", "", None, "a\tb  c\n\n d  x y\x1c", "漢字 émoji 🙂 x", " lead", "trail ", "<|endoftext|> ok", "x" * 3000, "1234 56 don't we'll\n\nnext\r\nline"]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    rng = random.Random(9)
    bits = ["a", "Zu", " ", "  ", "\n", "\t", "é", "12", "'s", ".", "　", "\x85", "Ġ", "\0", "<|endoftext|>", " longer-than-sixteen-bytes"]
    samples = [x or "" for x in TEXTS] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(2000)]
    samples += [" ".join(rng.choice([*(b for b in bits if not b.isspace()), "x\ny", "'", "(z)", "word"]) for _ in range(rng.randrange(40))) for _ in range(2000)]
    want = [x.ids for x in t.encode_batch(samples, add_special_tokens=False)]
    for kept in (tokens.KEPT, 64, 2):  # a full table goes on with what was used most
        e = tokens.Encoder(tokens.vocabulary_path(), kept)
        for step in (len(samples), 150):
            for i in range(0, len(samples), step):
                ids, at = e.encode(pa.array(samples[i : i + step], pa.string()))
                assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want[i : i + step]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in TEXTS]
    path = f"file:///tmp/checkpoints/quarry/test-{random.getrandbits(64):x}"
    token_files.write_token_files(table(spark, TEXTS, True), path)
    rows = token_files.read_token_files(spark, path).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == want
    assert [r["start"] for r in rows] == [sum(map(len, want[:i])) for i in range(len(want))]
    digest = token_files.token_digests(spark, path).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in digest] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]


def test_variable_length_coding():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], np.uint32)
    control, data = token_files.pack(values)
    assert len(control) == 3 and len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1 and (token_files.unpack(control, data, 9) == values).all()
    assert token_files.pack(values[:0]) == (b"", b"") and not len(token_files.unpack(b"", b"", 0))


def model_leaks(texts, items, threshold=0.6, overlap=0.8):
    """BM25 of every passage against every piece of every item, term by term, then the overlap of all 5-word shingles."""
    plain = lambda t: re.findall(r"[^ ]+", "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t or ""))
    pieces = []
    for item in {(i, t) for i, t in items if t is not None}:
        w = plain(item[1])
        pieces += [(item, Counter(w[max(0, min(at, len(w) - 64)) : at + 64])) for at in range(0, len(w), 64)]
    n, mean = len(pieces), sum(p.total() for _, p in pieces) / max(1, len(pieces))
    df = Counter(t for _, p in pieces for t in p)
    idf = {t: math.log((n - d + 0.5) / (d + 0.5) + 1) for t, d in df.items()}
    shares = [(item, {t: idf[t] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * p.total() / mean)) for t, f in p.items()}) for item, p in pieces]
    out = []
    for text in texts:
        words, found = plain(text), set()
        for at in range(0, max(1, len(words) - 64), 64):
            passage = set(words[at : at + 128])
            for item, share in shares:
                score = sum(s for t, s in share.items() if t in passage) / sum(share.values())
                assert abs(score - threshold) > 1e-9
                if score < threshold:
                    continue
                width = len(plain(item[1]))
                near = words[max(0, at - width) : at + 128 + width]
                sentences = [s for s in re.split(r"(?<=[.!?])\s+", item[1]) if plain(s)]
                parts = [plain(item[1])] * 2 if len(sentences) < 2 else [[w for s in sentences[:-1] for w in plain(s)], plain(sentences[-1])]
                grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
                if all(len(grams(p, min(5, len(p))) & grams(near, min(5, len(p)))) >= overlap * len(grams(p, min(5, len(p)))) for p in parts):
                    found.add(item)
        out.append(sorted((i for i, _ in found), key=lambda i: (i is None, i)))
    return out


@pytest.mark.parametrize(("n", "words"), [(40, 900), (600, 300)])
def test_decontamination(spark, n, words):
    rng = random.Random(n)
    sentence = lambda k: " ".join(f"q{rng.randrange(words)}" for _ in range(k)).capitalize() + "."
    items = [(i, f"{sentence(rng.randrange(8, 40))} {sentence(rng.randrange(4, 20))}") for i in range(n)] + [(n, sentence(150)), (n + 1, "")]
    docs = [None, "", *[f"{prose(rng, rng.randrange(300))} {items[rng.randrange(n + 1)][1].upper()} {prose(rng, 50)}" for _ in range(15)]]
    docs += [items[3][1].split(".")[0], prose(rng, 500), items[n][1], f"{items[1][1]} {prose(rng, 400)} {items[2][1]}"]
    docs += [" ".join(w for w in items[rng.randrange(n)][1].split() if rng.random() < 0.7) for _ in range(10)] + [sentence(300)]
    items += [(None, "x y z"), (n + 2, None), (3, "dup")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dict(enumerate(model_leaks(docs, items)))
    found = {r["doc_id"]: r["found"] for r in decontamination.leaks(table(spark, docs, True), bench, result="found").collect()}
    assert {i: [x["item_id"] for x in f] for i, f in found.items()} == want
    assert sum(map(len, want.values())) >= 17 and not want[17]  # a question alone is no leak
    passes = decontamination.leaks(table(spark, docs, True), bench, result="found", most_words=len(items) * 6)
    assert {r["doc_id"]: r["found"] for r in passes.collect()} == found
    assert decontamination.leaks(table(spark, docs), bench.limit(0)).where(F.size("leaks") > 0).count() == 0


def test_licenses(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    rows = [f"Some intro.\n\n{mit.lower()}\n\nThe end of it.", "Licensed under CC BY 4.0.", "Nothing here.", None, "", "word " * 5000 + "\nReleased under the MIT license!", "License"]
    got = {r["doc_id"]: [(m["license"], m["unit"], m["start_line"]) for m in r["licenses"]] for r in licenses.licenses(table(spark, rows, True)).collect()}
    assert got == {0: [("MIT", "line", 2), ("MIT", "text", 0)], 1: [("CC-BY-4.0", "line", 0)], 2: [], 3: [], 4: [], 5: [("MIT", "line", 1)], 6: []}
    rng = random.Random(1)
    index = licenses.Templates(licenses.TEMPLATES, 0.8)
    for _, template in licenses.TEMPLATES:  # size bounds drop no template that would reach the threshold
        words = licenses.plain_words(template)
        words = [w for w in words if rng.random() > 0.05]
        best = max((licenses.dice(licenses.bigrams(words), b) for b in index.bags), default=0)
        found = index.best(words)
        assert (found[1] if found else 0) == (best if best >= 0.8 else 0)


def test_token_counts_after_edits(spark):
    from tokenizers import Tokenizer

    rng = random.Random(21)
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rows = []
    for i in range(60):
        t = "".join(rng.choice(["word ", "x", "\n", "  ", "é", "Ab.", "12 ", " "]) for _ in range(rng.randrange(600)))
        edits, at = [], 0
        while at < len(t) and rng.random() < 0.8:
            a = rng.randrange(at, len(t) + 1)
            b = min(len(t), a + rng.randrange(30))
            edits.append((a, b, rng.choice(["", " new", "x\n", "ab cd " * 60])))
            at = b + 1
        rows.append((i, t, edits))
    rows += [(100, None, None), (101, "", [(0, 0, "start")]), (102, "abc", [(5, 9, "z"), None])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    got = {r["doc_id"]: r["counts"] for r in token_counts.recounted(df, F.col("edits")).collect()}
    for i, t, edits in rows:
        new = t or ""
        for a, b, s in sorted((e for e in edits or [] if e), reverse=True):
            new = new[: min(a, len(new))] + s + new[b:]
        assert got[i]["after"]["text"] == new and got[i]["after"]["n_tokens"] == count(new) and got[i]["n_tokens"] == count(t or "") == sum(got[i]["tokens"][len(got[i]["tokens"]) // 2 :])
        assert sum(got[i]["after"]["tokens"][len(got[i]["after"]["tokens"]) // 2 :]) == count(new)
    long = spark.createDataFrame([(0, "some words here " * 20_000, [(50_000, 50_004, "other")])], f"doc_id long, text string, edits {token_counts.EDITS}")
    assert token_counts.recounted(long, F.col("edits")).first()["counts"]["after"]["n_reencoded"] < 2000
    tree = token_counts.Tree(token_counts.leaves_of("a b c"), [3])
    tree.edit(1, 1, " new words" * 3000)  # a long insertion is many leaves, so that an edit within touches few of them
    tree.settle(iter(token_counts.counted(tree.pending(), tokens.vocabulary_path())))
    before = tree.reencoded
    tree.edit(10_000, 10_004, "other")
    tree.settle(iter(token_counts.counted(tree.pending(), tokens.vocabulary_path())))
    assert tree.reencoded - before < 1000 and tree.tokens[1] == count(tree.text()) and tree.text()[9_990:10_010].count("other") == 1


def test_mixing(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, rng.randrange(5, 60)).replace("w", "wording"), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), 1) for i in range(600)] + [(600, None, "en", "a", None), (601, "", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    one = {r["doc_id"]: r["mix"] for r in mixing.mixed(df).collect()}
    two = {r["doc_id"]: r["mix"] for r in mixing.mixed(df.repartition(7)).collect()}
    assert one.keys() == two.keys() and all(abs(one[i]["probability"] - two[i]["probability"]) < 1e-9 and one[i]["sampled"] == two[i]["sampled"] for i in one)
    assert one[600]["topic"] == one[601]["topic"] == "(none)" and len({m["topic"] for m in one.values()}) > 4
    cells = Counter()
    for i, _, lang, source, _ in rows:
        cells[(source or "(none)", lang or "(none)", one[i]["topic"])] += one[i]["n_tokens"]
    share, chance = model_mix(cells, 0.7)
    for i, _, lang, source, _ in rows:
        c = (source or "(none)", lang or "(none)", one[i]["topic"])
        assert abs(one[i]["weight"] - share[c]) < 1e-5 and abs(one[i]["probability"] - chance[c]) < 1e-4
    total = sum(cells.values())
    assert abs(sum(m["n_tokens"] * m["probability"] for m in one.values()) - 0.7 * total) < 1e-6 * total
    sampled = sum(m["n_tokens"] for m in one.values() if m["sampled"])
    assert abs(sampled - 0.7 * total) < 0.1 * total
    only = mixing.sample_mix(df.withColumns({"__mix": F.lit(1), "__MIX_t": F.lit(2), "__sample": F.lit(3)}), targets={"source": {"b": 1.0}})
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"b"} and only.columns == [*df.columns, "__mix", "__MIX_t", "__sample"]
    assert {tuple(r) for r in only.select("__mix", "__MIX_t", "__sample").distinct().collect()} == {(1, 2, 3)}


def model_mix(cells, budget):
    """Shares by 2,000 sweeps over a dict, and probabilities with the scale found by bisection."""
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    targets = []
    for d in range(3):
        size = Counter()
        for c, n in cells.items():
            size[c[d]] += n
        raw = {k: v**0.5 for k, v in size.items()}
        targets.append({k: v / sum(raw.values()) for k, v in raw.items()})
    for _ in range(2000):
        for d, target in enumerate(targets):
            now = Counter()
            for c, v in w.items():
                now[c[d]] += v
            w = {c: v * target[c[d]] / now[c[d]] if now[c[d]] else 0.0 for c, v in w.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        s = (low + high) / 2
        low, high = (s, high) if sum(min(cells[c], s * w[c]) for c in cells) < budget * total else (low, s)
    return w, {c: min(1.0, high * w[c] / cells[c]) if cells[c] else 0.0 for c in cells}


def test_raking_meets_all_marginals(spark):
    rows = [(s, l, t, n) for n, (s, l, t) in enumerate(((s, l, t) for s in "ab" for l in "xy" for t in "pq"), 10)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    wanted = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"p": 0.9, "q": 0.1}}
    found = mixing.calibrate(mixing.rake(cells, {d: mixing.marginal(cells, d, t) for d, t in wanted.items()}), 60.0)
    for d, t in wanted.items():
        got = {r[d]: r["w"] for r in found.groupBy(d).agg(F.sum("w").alias("w")).collect()}
        assert all(abs(got[k] - v) < 1e-5 for k, v in t.items())
    assert abs(found.agg(F.sum(F.col("p") * F.col("tokens"))).first()[0] - 60) < 1e-6 and found.agg(F.max("p")).first()[0] <= 1
    assert found.agg(F.max("deviation")).first()[0] < 1e-5
    assert mixing.calibrate(found, 1e6).where("p < 1").count() == 0


def test_raking_says_what_it_cannot_meet(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 30)], "source string, lang string, tokens long")
    wanted = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}}
    found = mixing.rake(cells, {d: mixing.marginal(cells, d, t) for d, t in wanted.items()}).collect()
    assert {round(r["deviation"], 6) for r in found} == {0.2} and {r["source"]: round(r["w"], 6) for r in found} == {"a": 0.3, "b": 0.7}
    slow = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("b", "y", 1), ("c", "y", 1000), ("c", "x", 1)], cells.schema)
    wanted = {"source": {"a": 0.4, "b": 0.3, "c": 0.3}, "lang": {"x": 0.7, "y": 0.3}}  # slow, but it can be met
    found = mixing.rake(slow, {d: mixing.marginal(slow, d, t) for d, t in wanted.items()}).collect()
    for d, t in wanted.items():
        assert all(abs(sum(r["w"] for r in found if r[d] == k) - v) < 1e-5 for k, v in t.items())


def test_topics_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"wording{rng.randrange(60)}" for _ in range(20)) if i % 3 else "the same long wording everywhere") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (mixing.fit_topics(df.repartition(k), 40) for k in (2, 9))
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1]) and len(one[0]) == mixing.TOPICS


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op7", "op1", "op3", "op8", "op10", "op9"])
def test_empty_tables(spark, name, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    query = next(q for n, q in registry.queries().items() if n.startswith(f"{name}_"))
    assert query(spark, f"file://{tmp_path}").count() == 0


def test_contract_columns(spark, texts, tmp_path):
    table(spark, [t for t in texts if t != "NOID"]).write.parquet(f"file://{tmp_path}/documents.parquet")
    q = registry.queries()
    d = f"file://{tmp_path}"
    one = {r["doc_id"]: r for r in q["op2_substring_dedup"](spark, d).collect()}
    assert one[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest() == one[1]["kept_sha256"]
    assert {r["fingerprint"] for r in q["op5_simhash"](spark, d).where("doc_id < 3").collect()} == {"0" * 16}


def near_copy_groups(rows):
    """The smallest id of each component of all pairs whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    best = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                root[find(i)] = find(j)
    out = {}
    for i, d in enumerate(best):
        out[find(i)] = min(out.get(find(i), d), d)
    return set(out.values())


def test_pipeline(spark):
    """Stage by stage on the smallest fixture: each keeps whole rows of what it got, and takes effect."""
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = P.stash(stage(spark, docs, d), f"test-{name}")
        assert docs.columns == names
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            assert now == {i: x["text"] for i, x in ((i, quality.judge(t)) for i, t in kept.items()) if x["kept"]}
        elif name == "simhash_near_dedup":
            assert now == {i: kept[i] for i in near_copy_groups(list(kept.items()))}
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            assert now == {i: t for (i, t), leaks in zip(kept.items(), model_leaks(kept.values(), items)) if not leaks}
        else:
            assert now == {i: kept[i] for i in now} and 0 < len(now) < before.count()
        kept = now
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    start = 0
    want = []
    for i in sorted(kept):
        ids = [*t.encode(kept[i], add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, P.run(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_on_texts_cuts_large_batches(spark):
    df = spark.createDataFrame([(i, "x" * 3_000_000 if i % 2 else None) for i in range(6)], "doc_id long, text string").coalesce(1)
    assert df.select(on_texts(lambda ts: [len(t or "") for t in ts], "long")(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == 9_000_000

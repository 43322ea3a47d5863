"""Byte-level BPE, collocations and clustering against the library itself or brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, clustering, collocations

SCHEMA = "doc_id long, text string, lang string"
CLASH = {"ids": 1, "decoded": "x", "block": 2, "keys": "y", "gid": 3, "v": 4, "x": 5, "cluster": 6, "centroid": "z", "n": 7, "rank": 8, "salt": 9}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


# ---- byte-level BPE

PARTS = ["'", "s", "re", "ll", "'ve", " ", "  ", "\n", "\t", "a", "É", "漢", "1", "²", "!", ".", "　", "\x85", "\x1c", " ", "don", "T", "'S", "D", "m", "𝒳", "🙂", "\r\n", "the", " and", "́"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.coder(byte_bpe.ranks_path()).ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(3000)]
    return out + [None, "", " ", "'", "'s", "''s", " 's", "\n's", "x'll'llm", "a" * 5000, "ab" * 3000, "word " * 4000, "<|endoftext|>", " \n \n x"]


@pytest.mark.parametrize("kept, section", [(1 << 18, 1 << 20), (50, 40)])
def test_bpe_ids_are_the_librarys(library, texts, kept, section):
    coder = byte_bpe.Coder(byte_bpe.ranks_path(), kept, section)
    ids, at = coder.encode(pa.array(texts, pa.string()))
    data, where = coder.decode(ids, at)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or ""), repr(t)[:80]
        assert data[where[i] : where[i + 1]].tobytes() == (t or "").encode()
    empty, at = coder.encode(pa.array([], pa.string()))
    assert not len(empty) and at.tolist() == [0]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 1000, 20_000):
        numbers = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert sorted(byte_bpe.PerfectHash(numbers).places(numbers).tolist()) == list(range(n))
    coder = byte_bpe.coder(byte_bpe.ranks_path())
    assert sorted(coder.hash.places(coder.prints).tolist()) == list(range(len(coder.ids)))


def test_bpe_unknown_id_is_an_error():
    coder = byte_bpe.coder(byte_bpe.ranks_path())
    with pytest.raises(ValueError):
        coder.decode(np.array([50256], np.uint32), np.array([0, 1]))


def test_round_trip(spark, library, texts):
    rows = [(None if i % 11 == 0 else i, t, "en") for i, t in enumerate(texts[-200:] + texts[-5:])]
    df = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in byte_bpe.round_trip(df).collect())
    assert got == Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert byte_bpe.round_trip(df.limit(0)).collect() == []
    columns = df.select(byte_bpe.encode("text").alias("e")).select("e", byte_bpe.decode("e").alias("d"))
    assert Counter((bytes(r["e"]), bytes(r["d"])) for r in columns.collect()) == Counter(x[1:] for x in got.elements())


def test_op11_digests(spark, library):
    got = {r["doc_id"]: r for r in byte_bpe.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"])
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


# ---- collocations


def brute_collocations(rows, least, longest, kept):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, p), a in frequent.items():
        inside = any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in frequent.items())
        if not inside:
            cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, left, right, total[lang], score))
    return sorted((lang, i + 1, x[2].decode(), *x[3:]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:kept]))


def phrase_rows():
    rng = random.Random(9)
    words = ["a", "b", "c", "d", "É", "漢字", "x y", "(q)", "\x1f"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \n ", "!?", "\x0b"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(80))), rng.choice(["en", "en", "fr", None, "und"])) for i in range(60)]
    rows += [(100 + i, "One two THREE four five six. one two", "en") for i in range(9)] + [(None, "One two THREE four five six. one two", "en")] * 4
    return rows + [(1, None, "en"), (2, "", None), (3, " .. \n", "fr"), (4, "a " * 3000, "de"), (5, "x", "")]


@pytest.mark.parametrize("block, few", [(1 << 21, 1 << 18), (300, 1 << 18), (300, 0)])
def test_collocations(spark, monkeypatch, block, few):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "FEW", few)
    df = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(4)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r[c] for c in columns) for r in collocations.collocations(df, 6, 5, 12).collect())
    want = brute_collocations(rows, 6, 5, 12)
    assert len(want) > 30 and got == want


def test_lists_stay_where_they_are_in_small_row_groups(spark, monkeypatch):
    """However many phrases are frequent, lists are neither shuffled nor joined; large rows don't gather in a writer or a reader."""
    plans, groups, stash = [], [], collocations.stash

    def watched(df, tag, **options):
        if tag == "phrase-lists":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        back = stash(df, tag, **options)
        if tag == "phrase-blocks":
            for f in Path(back.stashed_at.removeprefix("file://")).glob("*.parquet"):
                found = pq.ParquetFile(f).metadata
                groups.extend(found.row_group(i).num_rows for i in range(found.num_row_groups))
        return back

    monkeypatch.setattr(collocations, "stash", watched)
    monkeypatch.setattr(collocations, "FEW", 0)
    words = F.transform(F.sequence(F.lit(100_000), F.lit(400_000)), lambda i: F.concat(F.lit("w"), i.cast("string")))  # over 2 MB, a block of its own
    docs = spark.range(12, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b. a b. a b. "), F.concat_ws(" ", words)).alias("text"), F.lit("en").alias("lang"))
    phrases, _ = collocations.frequent_phrases(docs, 30, 3)
    assert {tuple(r) for r in phrases.collect()} == {("en", "a", 1, 36), ("en", "b", 1, 36), ("en", "a b", 2, 36)}
    assert sum(groups) == 12 and max(groups) <= 4
    assert len(plans) == 2 and not [p for p in plans if "Exchange" in p or "Join" in p]


def test_frequent_phrases_in_several_parts(spark, monkeypatch):
    parts, told_parts = [], collocations.told_parts
    monkeypatch.setattr(collocations, "told_parts", lambda *a: parts.append(told_parts(*a)) or parts[-1])
    monkeypatch.setattr(collocations, "FEW", 0)
    monkeypatch.setattr(collocations, "BLOCK", 3000)
    monkeypatch.setattr(collocations, "TOGETHER", 500)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(100 * rng.random() ** 2)}" for _ in range(300)), rng.choice(["en", "fr"])) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df, 8, 4, 300).collect())
    assert [len(p) > 1 for p in parts[:2]] == [True, True]
    assert got == brute_collocations(rows, 8, 4, 300)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, " , ", "en")], SCHEMA)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 10**12
    phrases = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big + 1), ("en", "a b", 2, big + 7)], "lang string, phrase string, size int, a long")
    totals = spark.createDataFrame([("en", 10**15 + 3)], "lang string, n long")
    r = collocations.scored(phrases, totals).first()
    assert r["score"] == 1000 * (big + 7) * (10**15 + 3) // (3 * big * (2 * big + 1))


def test_op12_on_whole_documents(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.op12_collocations(spark, "/root/testdata/sf0.001").collect())
    assert got == brute_collocations(docs, 100, 5, 2000)


# ---- clustering


def brute_clusters(rows, dim, clusters, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda x: (x[0] is None, digest(x[0]), x[1]))[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *place(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    return Counter((i, j, d, tuple(centroids[j]), inertia[j], sum(inertia.values())) for i, j, d in found)


def vector_rows():
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(200)] + [(7, [0.5] * 6)] * 5 + [(None, [1.0] * 6), (None, [-1.0] * 6)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [1.0, None, 1, 1, 1, 1]), (305, [float("nan")] * 6), (306, [float("inf")] + [0.0] * 5)]
    return [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows] + [(400 + i, [1e-9, -1e-9, 0.0, 2.0, 2.0, 2.0]) for i in range(40)]


@pytest.mark.parametrize("extra", [[], [(900, [4e5, 0.0, 0.0, 0.0, 0.0, -4e5]), (901, [1e6] * 6)]])
def test_clusters(spark, extra):
    rows = vector_rows() + extra
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(5)
    got = Counter((r["vec_id"], r["cluster"], r["distance"], tuple(r["centroid"]), r["cluster_inertia"], r["inertia"]) for r in clustering.clustered(df, 6).collect())
    assert got == brute_clusters(rows, 6, 8, 10)


def test_clusters_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])], schema)
    assert Counter(r["cluster"] for r in clustering.clustered(few, 2).collect()) == Counter(j for _, j, *_ in brute_clusters([(1, [1, 2]), (2, [1, 2]), (3, [5, 5])], 2, 8, 10).elements())
    assert clustering.clustered(few.where("vec_id > 9"), 2).collect() == []
    assert clustering.clustered(spark.createDataFrame([(1, None)], schema), 2).collect() == []


def test_op13_digests(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = Counter((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"], r["cluster_inertia"], r["inertia"]) for r in clustering.op13_clusters(spark, "/root/testdata/sf0.001").collect())
    want = Counter()
    for (i, j, d, c, a, b), n in brute_clusters(rows, 64, 8, 10).items():
        want[i, j, d, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), a, b] += n
    assert got == want

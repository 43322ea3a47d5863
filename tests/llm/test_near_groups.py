"""Large groups of near copies in several components, against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import near_copies

COPIES = 2400


def corpus() -> dict[int, str]:
    """Three bases with a common passage, their copies with none to many changed words, and texts that have only the passage."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(n)] for n in (60, 62, 90)]
    out = {}
    for i in range(COPIES):
        base = bases[i % 3]
        words = base[:20] + passage + base[20:]
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            words[r.randrange(len(words))] = word()
        out[i] = " ".join(words)
    for i in range(COPIES, COPIES + 300):
        out[i] = " ".join([word() for _ in range(r.randrange(0, 40))] + passage)
    return out


def kept_by_all_pairs(texts: dict[int, str]) -> set[int]:
    ids = sorted(texts)
    sets = []
    for i in ids:
        w = texts[i].split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    often = Counter(s for each in sets for s in each)
    column = {s: k for k, s in enumerate(s for s, n in often.items() if n > 1)}
    held = np.zeros((len(ids), len(column)), np.float32)
    for row, each in enumerate(sets):
        held[row, [column[s] for s in each if s in column]] = 1
    size = np.array([len(s) for s in sets])
    both = np.rint(held @ held.T).astype(int)
    root = np.arange(len(ids))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in np.argwhere(5 * both >= 4 * (size[:, None] + size[None, :] - both)):
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {ids[k] for k in range(len(ids)) if top(k) == k}


@pytest.mark.parametrize("pairs", [2, 32])
def test_large_groups_in_several_components(spark, monkeypatch, pairs):
    monkeypatch.setattr(near_copies, "PAIRS", pairs)
    texts, compared = corpus(), []
    plain = near_copies.stash

    def counting(df, tag, **options):
        out = plain(df, tag, **options)
        if tag == "near-pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "stash", counting)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    assert got == kept_by_all_pairs(texts)
    assert 100 < len(got) < len(texts)
    assert sum(compared) < 20 * len(texts), compared


def test_pairs_by_simhash_are_compared(spark, monkeypatch):
    """Of the texts' fingerprints those within 2 bits give candidates, among them the near copies that they reach."""
    from quarry.llm import simhash

    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = [*base]
    near[399] = "other"
    texts = [" ".join(base), " ".join(near), " ".join(base).upper(), " ".join(f"v{rng.randrange(5000)}" for _ in range(300)), "one two", "one three"]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    fp = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(df.withColumnRenamed("node", "doc_id")).collect()}
    want = {(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2}
    got = {(r["a"], r["b"]) for r in near_copies.by_fingerprint(df).collect()}
    assert (0, 2) in got and got <= want and {x for p in got for x in p} == {x for p in want for x in p}
    used, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: used.append(1) or plain(fps))
    kept = {r["doc_id"] for r in near_copies.keep_one(df.withColumnRenamed("node", "doc_id")).collect()}
    assert used and kept == {0, 3, 4, 5}

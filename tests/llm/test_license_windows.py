"""Licences next to each other: windows of a text's words against all windows, and files of two and three licences."""

from __future__ import annotations

import random
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import licenses
from quarry.llm.licenses import Templates, bigrams


def all_windows(words, texts, least):
    """Disjoint windows by margin, from every window of every part, with bags of words."""
    bags = sorted(((bigrams(t.encode().split()), name) for name, t in texts), key=lambda b: (b[0].total(), b[1]))
    pairs = list(zip(words, words[1:]))

    def margin(bag, i, j):
        return 2 * (Counter(pairs[i : j + 1]) & bag).total() - least * (bag.total() + j + 1 - i)

    found, parts = [], [(0, len(pairs))]
    while parts:
        a, b = parts.pop()
        candidates = []
        for t, (bag, _) in enumerate(bags):
            for i in range(a, b):
                best, _, j = max((round(margin(bag, i, j), 6), -j, j) for j in range(i, b))
                if best >= 0 and not (i > a and margin(bag, i - 1, j) > margin(bag, i, j)):
                    candidates.append((-best, t, i, j))
        taken = set()
        for _, t, i, j in sorted(candidates):
            if not taken & set(range(i, j + 2)):
                taken |= set(range(i, j + 2))
                found.append((t, i, j + 2))
        ends = sorted((i, e) for _, i, e in found if a <= i < b)
        if taken:
            parts += [(lo, hi) for lo, hi in zip([a, *(e for _, e in ends)], [*(i - 1 for i, _ in ends), b]) if hi > lo]
    return sorted(found, key=lambda f: f[1:])


@pytest.mark.parametrize("least", [0.8, 0.6])
def test_windows_against_all_windows(least):
    rng = random.Random(3)
    some = 0
    for round_ in range(60):
        texts = [(f"L{k}", " ".join(f"t{rng.randrange(2 + 5 * (k % 3))}" for _ in range(rng.randrange(2, 18)))) for k in range(3)]
        index = Templates(texts, least)
        words = []
        for _ in range(rng.randrange(1, 5)):
            part = rng.choice(texts)[1].split()
            part = [w if rng.random() > 0.07 else "x" for w in part]
            words += part + [f"y{rng.randrange(3)}" for _ in range(rng.choice([0, 0, 1, 4]))]
        words = [w.encode() for w in words]
        values = licenses.word_values(np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(b" ".join(words))]))[0]
        ids = index.numbers(licenses.Stretches(values).all_of(2))
        found = licenses.windows(ids, index, list(range(len(index.bags))))
        assert found == all_windows(words, texts, least), (round_, words, texts)
        some += len(found) > 1
    assert some > 20


def named(name, start):
    return next(t for n, t in licenses.TEMPLATES + licenses.full_texts() if n == name and t.startswith(start))


def test_files_of_several_licences(spark):
    mit, bsd = named("MIT", "Permission"), named("BSD-3-Clause", "Redistribution")
    apache = named("Apache-2.0", "Licensed under the Apache License, Version 2.0 (")
    gpl = named("GPL-3.0", next(t for n, t in licenses.full_texts() if n == "GPL-3.0")[:20])

    def wrapped(*texts):
        return "\n\n".join("\n".join(textwrap.wrap(t, 72)) for t in texts)

    thirds = textwrap.wrap(mit, len(mit) // 3 + 20)
    rows = [
        wrapped(*thirds, bsd),
        wrapped("The MIT License", "Copyright 2020 Some One", *thirds, "The BSD License", "Copyright 2021 Another", bsd),
        wrapped(f"{mit} {bsd}"),
        f"{mit} {bsd}",
        f"{bsd} {mit} {apache}",
        wrapped("Some words before.", f"{mit} {mit}"),
        wrapped(gpl, mit),
        "and of the software to the use in source " * 200,
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["licenses"] for r in licenses.licenses(df).collect()}
    names = {i: {m["license"] for m in f} for i, f in found.items()}
    both = {"MIT", "BSD-3-Clause"}
    assert [names[i] for i in range(4)] == [both] * 4
    assert names[4] == both | {"Apache-2.0"} and names[5] == {"MIT"} and {"GPL-3.0", "MIT"} <= names[6]
    assert names[7] == names[8] == names[9] == set()
    assert [m["unit"] for m in found[5]].count("stretch") == 2  # the same licence twice
    assert all(m["dice"] >= 0.8 for f in found.values() for m in f)
    assert licenses.licenses(df.limit(0)).count() == 0


def test_templates_of_one_word_and_none():
    texts = pa.array(["apache", "a b apache c", "a b c d", None])
    assert [len(f) for f in licenses.scan(texts, Templates([("A", "apache"), ("B", "a b c d")], 0.8))] == [1, 0, 1, 0]
    assert licenses.scan(texts, Templates([], 0.8)) == [[], [], [], []]

"""Cases that an operator once left out."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import decontamination, licenses, near_copies, pseudonyms, repeats, substring_dedup, suffix_dedup
from quarry.llm.common import joined_bytes
from quarry.llm.rolling import word_values

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """The smallest id of each component of all pairs of similarity 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return set(best.values())


@pytest.mark.parametrize("pairs", [32, 2])
def test_pipeline_near_dedup_keeps_one_of_each_group(spark, pairs, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRS", pairs)
    rng = random.Random(5)
    line = " ".join(f"c{i}" for i in range(30))
    texts = [None, "", "one two", "One  TWO", "one three"]
    for g in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 300))]
        texts.append(f"{line} {' '.join(words)}")
        for _ in range(rng.randrange(1, 6)):
            for _ in range(rng.randrange(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(f"{line} {' '.join(words)}")
    rows = list(enumerate(texts))
    want = groups(rows)
    assert 12 < len(want) < len(rows) - 15
    kept = corpus_pipeline.near_dedup(spark, table(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_op3_cards_of_any_first_digit():
    for first in "0123456789":
        for size in (13, 16, 19):
            payload = first + "27182818284590452"[: size - 2]
            text = f"card {payload}{pseudonyms.luhn_digit(payload)} end"
            new = pseudonyms.pseudonymise(text)
            assert new["n_found"] == 1 and new["matches"][0]["kind"] == "card" and new["text"] != text
            assert pseudonyms.pseudonymise(new["text"], back=True)["text"] == text


def test_op3_compact_phones_and_month_first_dates():
    for value, kind in [("+14155550123", "phone"), ("+442079460958", "phone"), ("+35312345", "phone"), ("+442079460958 2024", "phone"), ("02/29/2024", "date"), ("12-31-1999", "date"), ("01.13.2050", "date")]:
        text = f"x {value}, y"
        new = pseudonyms.pseudonymise(text)
        assert [m["kind"] for m in new["matches"]] == [kind] and new["text"] != text
        assert pseudonyms.pseudonymise(new["text"], back=True)["text"] == text
    assert pseudonyms.phone("+14155550123", pseudonyms.KEY).replace("+1", "") == pseudonyms.phone("+1 415 555 0123", pseudonyms.KEY)[3:].replace(" ", "")
    assert pseudonyms.pseudonymise("13/13/2024 and 02/30/2024")["n_found"] == 0


def test_op7_items_with_equal_or_no_id(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"q{rng.randrange(900)}" for _ in range(n)) + ".") for i, n in [(1, 12), (1, 30), (None, 25), (None, 15), (2, 20)]]
    docs = [(i, f"some words before {t} and after it") for i, (_, t) in enumerate(items)] + [(9, "clean")]
    bench = spark.createDataFrame([*items, items[0], (None, None)], "item_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontamination.leaks(table(spark, docs), bench).collect()}
    assert got == {0: [1], 1: [1], 2: [None], 3: [None], 4: [2], 9: []}
    assert [r["doc_id"] for r in decontamination.drop_contaminated(table(spark, docs), bench).collect()] == [9]


def test_pipeline_near_dedup_keeps_one_row(spark):
    t = [" ".join(f"{k}{i}" for i in range(20)) for k in "abc"]
    rows = [(1, t[0]), (1, t[0]), (None, t[1]), (3, t[1]), (None, t[2]), (None, t[2])]
    kept = corpus_pipeline.near_dedup(spark, table(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, t[0]), (3, t[1]), (None, t[2])], key=str)


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_stretches_of_equal_polynomial_hash_are_told_apart(spark):
    """A Thue-Morse word and its complement have one value under any odd base modulo a power of two."""
    words = [f"w{i}" for i in range(60)]
    one, two = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    rows = [(0, " ".join([*words[:17], one, *words[17:34]])), (1, " ".join([*words[:17], two, *words[17:34]])), (2, " ".join(words)), (3, " ".join(words[5:45]))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeated_windows(table(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 40, 3: 40}
    values = word_values(*joined_bytes(pa.array([one, two, one, "x" * 300, "x" * 301])))[0]
    assert len(set(values.tolist())) == 4 and values[0] == values[2]
    text = "".join(f"<{i}>" for i in range(60))
    docs = table(spark, [(0, f"{text}{one}{text[::-1]}"), (1, f"{text}{two}{text[::-1]}")])
    got = suffix_dedup.remove_repeated_strings(docs, 1300).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_op2_and_op4_many_contexts_of_one_anchor(spark, monkeypatch):
    """A passage that many texts share, with other words around it in each."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(20))} {passage} {' '.join(f'v{rng.randrange(10**6)}' for _ in range(20))}") for i in range(60)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeated_windows(table(spark, rows)).collect()}
    assert got == {i: 70 for i, _ in rows}
    want = None
    for hot in (1000, 10):
        monkeypatch.setattr(repeats, "HOT", hot)
        found = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.remove_repeated_strings(table(spark, rows)).collect()}
        assert want in (None, found) and all(n >= len(passage) for n, _ in found.values())
        want = found


def model_dice(a, b):
    grams = lambda t: Counter(zip(*(lambda w: (w, w[1:]))(re.findall(r"[a-z0-9\x80-\uffff]+", t.lower()))))
    x, y = grams(a), grams(b)
    return 2 * sum(min(n, y[g]) for g, n in x.items()) / max(1, sum(x.values()) + sum(y.values()))


def test_op8_whole_licences_and_stretches(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    parts = re.split(r"(?<=conditions: )|(?<=Software\. )(?=THE)", mit)
    assert len(parts) == 3
    filler = " ".join(f"word{i}" for i in range(300))
    full = dict(licenses.full_texts())
    rows = [(0, f"{filler}\n\n" + "\n\n".join(parts) + f"\n\n{filler}\n\n{filler}"), (1, f"{filler} {mit} {filler}"), (2, full["GPL-3.0"]), (3, f"{filler}\n{full['Apache-2.0']}\n{filler}"), (4, f"{filler} of the software and the rights of all {filler}")]
    got = {r["doc_id"]: {(m["license"], m["unit"]) for m in r["licenses"]} for r in licenses.licenses(table(spark, rows)).collect()}
    assert got == {0: {("MIT", "stretch")}, 1: {("MIT", "stretch")}, 2: {("GPL-3.0", "text")}, 3: {("Apache-2.0", "line"), ("Apache-2.0", "text")}, 4: set()}


def test_op8_coefficients_equal_the_model(spark):
    """Every line of texts made of noisy templates against all templates, without size bounds."""
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        texts.append(" ".join(w if rng.random() > 0.06 else f"x{rng.randrange(99)}" for w in words if rng.random() > 0.04))
    got = {r["doc_id"]: max((m["dice"] for m in r["licenses"] if m["unit"] == "line"), default=0) for r in licenses.licenses(table(spark, list(enumerate(texts))), licenses.TEMPLATES).collect()}
    for i, t in enumerate(texts):
        best = max(model_dice(t, x) for _, x in licenses.TEMPLATES)
        assert got[i] == (round(best, 6) if best >= 0.8 else 0)
    assert sum(v > 0 for v in got.values()) > 20


def test_op3_against_a_model(spark):
    """A Feistel network written anew, over cards and dates found by plain string tests."""
    import datetime
    import hashlib

    def network(value, size, tweak):
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        person = hashlib.blake2b(f"{tweak}:{size}".encode(), digest_size=16).digest()
        while True:
            a, b = value // 2**half, value % 2**half
            for i in range(pseudonyms.ROUNDS):
                width = (half + 7) // 8
                f = hashlib.blake2b(bytes([i]) + b.to_bytes(width, "big"), digest_size=max(8, width), key=pseudonyms.KEY, person=person).digest()
                a, b = b, a ^ int.from_bytes(f, "big") % 2**half
            value = a * 2**half + b
            if value < size:
                return value

    rng = random.Random(6)
    for _ in range(50):
        payload = "".join(rng.choice("0123456789") for _ in range(15))
        number = payload + pseudonyms.luhn_digit(payload)
        new = payload[0] + str(network(int(payload[1:]), 10**14, f"card{payload[0]}")).zfill(14)
        assert pseudonyms.pseudonymise(f"a {number} b")["text"] == f"a {new}{pseudonyms.luhn_digit(new)} b"
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))
        moved = datetime.date(1900, 1, 1) + datetime.timedelta(network((day - datetime.date(1900, 1, 1)).days, 73049, "date"))
        assert pseudonyms.pseudonymise(f"on {day}.")["text"] == f"on {moved}."


def test_op3_spellings_stay_linked():
    one, two = (pseudonyms.pseudonymise(t)["text"] for t in ("jo.doe7@example.com", "Jo.DOE7@example.com"))
    assert one != "jo.doe7@example.com" and one == two.lower() and two[0].isupper() and pseudonyms.pseudonymise(two, back=True)["text"] == "Jo.DOE7@example.com"
    digits = lambda t: re.sub(r"\D", "", pseudonyms.pseudonymise(t)["text"])
    assert digits("+1 415-555-0123") == "1" + digits("(415) 555-0123") == "1" + digits("415-555-0123")

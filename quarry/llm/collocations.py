"""Phrase collocations: frequent phrases by positional inverted lists, scored by their weakest cut.

Texts are gathered into blocks of one language. A block has, for each of its words, the list of
places at which it stands. The list of a phrase is extended by a word by merging its places with
those of the words that follow; the sum of the lists' lengths over all blocks is the phrase's
exact frequency, and only lists of frequent phrases are kept. The lists stay where they are: the
frequent phrases, however many, go to all tasks in parts of bounded size, and a task looks up a
few blocks at a time in one part after the other.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import load, slices, stash, unstash

LEAST, LONGEST, KEPT = 100, 5, 2000
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 1 << 21
#: Bytes of text that a task holds while blocks of several languages fill.
HELD = 1 << 24
#: Frequent phrases of a length that a task holds at a time.
FEW = 1 << 21
#: Phrases of the blocks that a task looks up together, if there are several parts.
TOGETHER = 1 << 20
#: A block's row is some MB. Unless told, Parquet looks at the size of what it holds after 100 rows only, and readers take a whole row group.
LISTS = {"compression": "zstd", "parquet.block.size": str(1 << 22), "parquet.page.size.row.check.min": "1"}
#: Shares in which the rows of a language are ranked before they meet.
SALTS = 64

#: Capital letters become small, what ends a piece a line feed, a tab a space.
PLAIN = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))


def lists_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of the texts, how often each occurs, and the places of all words, list by list in ascending order. Ends of pieces take a place, so that words on both sides aren't adjacent."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[b"\n"]
    raw = b"\n".join(texts).translate(PLAIN)
    words = [w for w in re.sub(rb"\n[\n ]*", b" \n ", raw).split(b" ") if w]
    seq = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
    sizes = np.bincount(seq, minlength=len(number)).astype(np.int32)
    at = np.argsort(seq, kind="stable").astype(np.int32)
    return list(number)[1:], sizes[1:], at[sizes[0] :]


def blocks_of(documents: DataFrame) -> DataFrame:
    """block, lang, keys (words), sizes, at (places, 32-bit integers): lists of each block's words. Null languages are ``und``, null texts empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, list[bytes]] = defaultdict(list)
        size: defaultdict[str, int] = defaultdict(int)

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            keys, sizes, at = lists_of(held.pop(lang))
            del size[lang]
            if keys:
                words = pa.array(keys, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([sizes], pa.list_(pa.int32())), pa.array([at.tobytes()], pa.binary())],
                    names=["lang", "keys", "sizes", "at"],
                )

        for batch in slices(batches, "text", 1 << 22):
            for lang, text in zip(batch.column("lang").to_pylist(), pa.compute.cast(batch.column("text"), pa.binary()).to_pylist()):
                held[lang].append(text)
                size[lang] += len(text) + 1
                if size[lang] >= BLOCK:
                    yield from flush(lang)
            while sum(size.values()) > HELD:
                yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = docs.mapInArrow(run, "lang string, keys array<string>, sizes array<int>, at binary")
    return found.select(F.monotonically_increasing_id().alias("block"), "*")


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def kept_lists(sizes: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists those with these ascending numbers."""
    wanted = np.zeros(len(sizes), bool)
    wanted[keep] = True
    return sizes[keep], at[np.repeat(wanted, sizes)]


def extended(phrases: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of phrases of ``k`` words, each merged with the lists of words that stand ``k`` places on.

    Only places where another listed phrase starts one place on can count. Gives, for each longer
    phrase, the number of the phrase and of the word, the list's length, and all lists' places.
    """
    (sizes, at), (word_sizes, word_at) = phrases, words
    end = int(max(at.max(initial=0), word_at.max(initial=0))) + k + 2
    word_of = np.full(end, -1, np.int64)
    word_of[word_at] = _places(word_sizes)
    starts = np.zeros(end, bool)
    starts[at] = True
    word = word_of[at + k]
    fits = (word >= 0) & starts[at + 1]
    key = _places(sizes)[fits] * max(1, len(word_sizes)) + word[fits]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first] // max(1, len(word_sizes)), key[first] % max(1, len(word_sizes)), np.diff(np.r_[first, len(key)]), at[fits][order]


STATE = "block long, words array<int>, word_sizes array<int>, word_at binary, keys array<int>, sizes array<int>, at binary"


def paired(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """One number for each pair of ids. Ids count from 0 and a frequent phrase takes ``least`` places, so that 2**31 are met in hundreds of billions of words only; that is an error."""
    if max(prefix.max(initial=0), suffix.max(initial=0)) >= 1 << 31:
        raise OverflowError("too many frequent phrases of a length")
    return prefix << 32 | suffix


class Told:
    """A part of the counted, frequent phrases of ``k`` words, for all tasks: finds those of a block."""

    def __init__(self, level: DataFrame, k: int, part: int = 0, parts: int = 1):
        found, self.part, self.parts = level.toArrow(), part, parts
        gid = found.column("gid").to_numpy()
        if k == 1:
            lang, words = found.column("lang").combine_chunks(), found.column("phrase").combine_chunks()
            own = {x: pa.compute.indices_nonzero(pa.compute.equal(lang, x)) for x in lang.unique()}
            self.words = {x.as_py(): (words.take(at), gid[at].astype(np.int32)) for x, at in own.items()}
            return
        key = paired(found.column("prefix").to_numpy(), found.column("suffix").to_numpy())
        order = np.argsort(key)
        self.key, self.gid = key[order], gid[order].astype(np.int32)

    @staticmethod
    def dealt(k: int, parts: int):
        """The part of a phrase, by the columns of its level."""
        return (F.col("gid") if k == 1 else 31 * F.col("prefix") + F.col("suffix")) % parts

    def of_words(self, lang: str, words: pa.Array) -> np.ndarray:
        if lang not in self.words:
            return np.full(len(words), -1, np.int32)
        own, gid = self.words[lang]
        at = pa.compute.fill_null(pa.compute.index_in(words, value_set=own.cast(words.type)), -1).to_numpy()
        return np.where(at < 0, -1, gid[at])

    def of_pairs(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), -1, np.int32)
        if len(self.key):
            mine = np.flatnonzero((31 * (key >> 32) + (key & 0xFFFFFFFF)) % self.parts == self.part) if self.parts > 1 else np.arange(len(key))
            at = np.minimum(np.searchsorted(self.key, key[mine]), len(self.key) - 1)
            out[mine] = np.where(self.key[at] == key[mine], self.gid[at], -1)
        return out


def told_parts(level: DataFrame, keys: list[str], k: int) -> list[Broadcast[Told]]:
    """The frequent phrases of ``k`` words in parts; one part at a time passes the driver."""
    n = max(1, -(-level.count() // max(64, FEW)))
    send = level.sparkSession.sparkContext.broadcast
    return [send(Told(level.where(Told.dealt(k, n) == i).select("gid", *keys), k, i, n)) for i in range(n)]


class Row:
    """One block of a batch, its columns as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.row = {n: batch.column(n)[i] for n in batch.schema.names}

    def numbers(self, name: str) -> np.ndarray:
        return self.row[name].values.to_numpy(zero_copy_only=False).astype(np.int64)

    def places(self, name: str) -> np.ndarray:
        return np.frombuffer(self.row[name].as_py(), np.int32)

    def longer(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lists of phrases of k words, extended by a word each: the ids of phrase and word, lengths and places."""
        keys, lists = self.numbers("keys"), (self.numbers("sizes"), self.places("at"))
        ids, words = (keys, lists) if k == 1 else (self.numbers("words"), (self.numbers("word_sizes"), self.places("word_at")))
        prefix, word, sizes, at = extended(lists, words, k)
        return keys[prefix], ids[word], sizes, at


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for batch in batches:
        yield from (Row(batch, i) for i in range(batch.num_rows))


def candidates(state: DataFrame, k: int) -> DataFrame:
    """prefix, suffix and m of each block's phrases of k + 1 words, frequent or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            prefix, suffix, sizes, _ = row.longer(k)
            yield pa.RecordBatch.from_pydict({"prefix": prefix, "suffix": suffix, "m": sizes.astype(np.int64)})

    return state.mapInArrow(run, "prefix long, suffix long, m long")


class Block:
    """The phrases of ``k`` words of a block and their lists; ``ids`` has those of the frequent ones found so far, -1 for others."""

    def __init__(self, row: Row, k: int):
        self.row, self.k = row, k
        if k == 1:
            self.sizes, self.at = row.numbers("sizes"), row.places("at")
        else:
            prefix, suffix, self.sizes, self.at = row.longer(k - 1)
            self.key = paired(prefix, suffix)
        self.ids = np.full(len(self.sizes), -1, np.int32)

    def find(self, told: Told) -> None:
        self.ids = np.maximum(self.ids, told.of_words(self.row.row["lang"].as_py(), self.row.row["keys"].values) if self.k == 1 else told.of_pairs(self.key))

    def kept(self) -> Iterator[pa.RecordBatch]:
        """The lists of frequent phrases, and the word lists that longer ones may need; nothing, if none is frequent."""
        row, k, keep = self.row, self.k, np.flatnonzero(self.ids >= 0)
        if not len(keep):
            return
        ids = self.ids[keep]
        sizes, at = kept_lists(self.sizes, self.at, keep)
        words = (np.zeros(0, np.int64),) * 3
        if k > 1:
            words = (row.numbers("words"), row.numbers("word_sizes"), row.places("word_at")) if k > 2 else (row.numbers("keys"), row.numbers("sizes"), row.places("at"))
            needed = np.zeros(int(at.max()) + k + 1, bool)  # places right after a phrase
            needed[at + k] = True
            near = needed[np.minimum(words[2], len(needed) - 1)] & (words[2] < len(needed))
            left = np.bincount(_places(words[1])[near], minlength=len(words[0]))
            some = np.flatnonzero(left)
            words = (words[0][some], left[some], words[2][near])
        listed = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
        lists = [[listed(i), listed(n), pa.array([p.astype(np.int32).tobytes()], pa.binary())] for i, n, p in (words, (ids, sizes, at))]
        yield pa.RecordBatch.from_arrays([pa.array([row.row["block"].as_py()]), *lists[0], *lists[1]], names=["block", "words", "word_sizes", "word_at", "keys", "sizes", "at"])


def step(state: DataFrame, parts: list[Broadcast[Told]], k: int) -> DataFrame:
    """The lists of each block's frequent phrases of ``k`` words, and the word lists that longer ones may need."""

    def told(held: list[Block]) -> Iterator[pa.RecordBatch]:
        for part in parts if held else []:
            for block in held:
                block.find(part.value)
            if len(parts) > 1 and getattr(part, "_path", None):  # is read from there again, so that no worker holds all parts
                vars(part).pop("_value", None)
        for block in held:
            yield from block.kept()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows_of(batches):
            held.append(Block(row, k))
            size += len(held[-1].ids)
            if size >= TOGETHER or len(parts) == 1:
                yield from told(held)
                held, size = [], 0
        yield from told(held)

    return state.select("block", "keys", "sizes", "at", *(["lang"] if k == 1 else ["words", "word_sizes", "word_at"])).mapInArrow(run, STATE)


def dense(level: DataFrame) -> DataFrame:
    """A written table with ids that count from 0; small numbers take little room in shuffles. One number for each part of the table reaches the driver."""
    part = F.shiftright("gid", 33)
    before, rows = 0, []
    for r in sorted(level.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        rows.append((r["p"], before))
        before += r["n"]
    starts = level.sparkSession.createDataFrame(rows, "p long, before long")
    numbered = level.withColumn("p", part).join(F.broadcast(starts), "p")
    return numbered.withColumn("gid", F.col("before") + F.col("gid").bitwiseAND(F.lit((1 << 33) - 1))).drop("p", "before")


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase (words joined by a space), size (in words), a (its frequency), for each phrase of up to ``longest`` words that occurs ``least`` times or more; and lang, n (all its word occurrences).

    Rows are not told apart by doc_id: repeated rows count each time. An empty table, or one
    without words, gives none. Columns other than lang and text, whatever their names, are not read.
    """
    state = stash(blocks_of(documents), "phrase-blocks", **LISTS)
    totals = state.groupBy("lang").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    totals = stash(totals, "phrase-totals", small=True)
    one = state.select("block", "lang", F.posexplode(F.arrays_zip("keys", "sizes")).alias("local", "x")).select("block", "lang", "local", F.col("x.keys").alias("phrase"), F.col("x.sizes").alias("m"))
    keys, every, words = ["lang", "phrase"], None, None
    for k in range(1, longest + 1):
        counted = one.groupBy(*keys).agg(F.sum("m").alias("a")).where(F.col("a") >= least)
        level = counted.select(F.monotonically_increasing_id().alias("gid"), "*")
        if k > 1:
            level = dense(stash(level, "phrase-level"))  # ids are fixed before they are used
            before = every.where(F.col("size") == k - 1).select(F.col("gid").alias("prefix"), "lang", F.col("phrase").alias("head"))
            named = level.join(before, "prefix").join(words, "suffix")
            named = named.select("gid", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), F.lit(k).alias("size"), "a")
        else:
            level = named = dense(stash(level.select("gid", "lang", "phrase", F.lit(1).alias("size"), "a"), "phrase-level"))
            words = level.select(F.col("gid").alias("suffix"), F.col("phrase").alias("tail"))
        every = named if every is None else every.unionByName(named)
        if k == longest:
            break
        del counted, one  # nothing else holds their shuffles
        parts = told_parts(level, keys, k)
        after = stash(step(state, parts, k), "phrase-lists", **LISTS)
        unstash(state)
        for part in parts:
            part.destroy()
        state, keys = after, ["prefix", "suffix"]
        one = candidates(state, k)
    return every.select("lang", "phrase", "size", "a"), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of each phrase of two words or more, by the cut with the lowest score, the first of equal ones. All arithmetic is exact."""
    words = F.split("phrase", " ")
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ")})
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    whole = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    least = whole.withColumn("score", exact).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "size", "a", "l", "r", "n")).alias("c"))
    return least.select("lang", "phrase", *[F.col(f"c.{c}").alias(c) for c in ("size", "a", "l", "r", "n", "score")])


def without_parts(phrases: DataFrame, share: int = 100) -> DataFrame:
    """Phrases of two words or more that no longer one of ``phrases`` contains with at least ``share`` hundredths of their frequency."""
    words = F.split("phrase", " ")
    stretch = lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), stretch))
    longer = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("b"))
    return phrases.where("size > 1").join(longer, ["lang", "phrase"], "left").where(F.col("b").isNull() | (100 * F.col("b") < share * F.col("a"))).select("lang", "phrase")


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, kept: int = KEPT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Ties go to the more frequent phrase, then to the first in order of UTF-8 bytes. A language is
    ranked in shares first, so that no task needs all its phrases.
    """
    phrases, totals = frequent_phrases(documents, least, longest)
    phrases = stash(phrases, "phrases", small=True)
    own = scored(phrases, totals).join(without_parts(phrases), ["lang", "phrase"]).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = own.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= kept)
    best = share.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= kept)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))

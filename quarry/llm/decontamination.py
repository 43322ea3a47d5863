"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap check.

The test items are the indexed documents, and every passage of the training texts is a
query. Item count, document frequencies and mean length are taken once, by Spark, over all
pieces of all items. An impact is a term's BM25 share in a piece, divided by the piece's score for
itself, so that a passage holding a whole piece scores 1 and one threshold serves all items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import PLAIN, free_name, joined_bytes, load, on_text_batches, plain_words, slices, stash, text_key
from quarry.llm.rolling import Stretches, word_values

#: Words of an indexed piece; a longer item is several pieces.
PIECE = 64
#: A passage is twice as long and starts every PIECE words, so that each stretch of PIECE words is inside one.
PASSAGE = 2 * PIECE
K1, B = 1.5, 0.75
THRESHOLD = 0.6
SHINGLE, OVERLAP = 5, 0.8
#: Pieces in a block with one upper bound for each term.
BLOCK = 8
#: Words of items (16 bytes each, or fewer, in the index) that go to all tasks at once; a larger benchmark is searched in several passes, with the same statistics.
PASS_WORDS = 500_000
#: Share of the threshold that the passed-over lists of a query may reach together.
PASSED = 0.3
#: Sums of single shares may differ in the last places; bounds are taken with this margin.
MARGIN = 1e-9

LEAKS = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,first_word:int,last_word:int>>"
PIECES = "item_id long, tk long, piece int, term long, tf int, size int"
ITEMS = "item_id long, tk long, width int, question_length int, question array<long>, answer_length int, answer array<long>"


def parts_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: its last sentence is the answer; an item of one sentence is both."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text or "") if plain_words(s)]
    if len(sentences) < 2:
        return plain_words(text), plain_words(text)
    return [w for s in sentences[:-1] for w in plain_words(s)], plain_words(sentences[-1])


def hashed(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return word_values(data, np.array([0, len(data)]))[0]


def shingle_hashes(values: np.ndarray) -> np.ndarray:
    """Of the different word shingles; of all words, if there are fewer."""
    return np.unique(Stretches(values).all_of(min(SHINGLE, len(values)))) if len(values) else np.zeros(0, np.uint64)


def _pieces(items: DataFrame) -> DataFrame:
    """A row for each different word of each piece of ``items``; the last piece of a longer item is as long as the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            rows = [[] for _ in range(6)]
            for item_id, tk, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "tk", "text"))):
                values = hashed(plain_words(text))
                for k, at in enumerate(range(0, len(values), PIECE)):
                    piece = values[max(0, min(at, len(values) - PIECE)) : at + PIECE]
                    term, tf = np.unique(piece, return_counts=True)
                    for column, x in zip(rows, ([item_id] * len(term), [tk] * len(term), [k] * len(term), term.view(np.int64), tf, [len(piece)] * len(term))):
                        column.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names=["item_id", "tk", "piece", "term", "tf", "size"])

    return items.mapInArrow(run, PIECES)


def _items(items: DataFrame) -> DataFrame:
    """Question and answer shingles of each item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            rows = []
            for item_id, tk, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "tk", "text"))):
                if width := len(plain_words(text)):
                    (n, question), (m, answer) = ((min(SHINGLE, len(w)), shingle_hashes(hashed(w)).view(np.int64)) for w in parts_of(text))
                    rows.append({"item_id": item_id, "tk": tk, "width": width, "question_length": n, "question": question, "answer_length": m, "answer": answer})
            kind = pa.schema([("item_id", pa.int64()), ("tk", pa.int64()), ("width", pa.int32()), ("question_length", pa.int32()), ("question", pa.list_(pa.int64())), ("answer_length", pa.int32()), ("answer", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist(rows, kind)

    return items.mapInArrow(run, ITEMS)


class Index:
    """Postings by term, with the largest impact of each term overall and in each block of pieces."""

    def __init__(self, items: pa.Table, postings: pa.Table, n: int, mean: float, k1: float = K1, b: float = B):
        """``postings`` has PIECES and each term's document frequency ``df`` among all ``n`` pieces, whose mean length is ``mean``."""
        rows = sorted(items.to_pylist(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["tk"]))
        self.item_id, self.width = [r["item_id"] for r in rows], [r["width"] for r in rows]
        self.parts = [tuple((r[f"{p}_length"], np.array(r[p], np.int64).view(np.uint64)) for p in ("question", "answer")) for r in rows]
        place = {(r["item_id"], r["tk"]): i for i, r in enumerate(rows)}
        item = np.array([place[k] for k in zip(postings.column("item_id").to_pylist(), postings.column("tk").to_pylist())], np.int64)
        number, term, tf, size, df = (np.asarray(postings.column(c)) for c in ("piece", "term", "tf", "size", "df"))
        pieces, piece = np.unique(item << 32 | number, return_inverse=True)
        #: The item of each piece.
        self.of = pieces >> 32
        term = np.ascontiguousarray(term).view(np.uint64)
        order = np.lexsort((term, piece))
        share = (np.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)))[order]
        piece, term = piece[order], term[order]
        impact = share / np.bincount(piece, weights=share, minlength=len(pieces))[piece]
        # by term, then by piece
        order = np.argsort(term, kind="stable")
        self.terms, which = np.unique(term, return_inverse=True)
        which, self.piece, self.impact = which[order], piece[order].astype(np.int32), impact[order]
        #: Blocks of pieces of each term: number, place of their first posting, and largest impact.
        self.blocks = max(1, -(-len(pieces) // BLOCK))
        self.key, self.at = np.unique(which * np.int64(self.blocks) + self.piece // BLOCK, return_index=True)
        self.block_max = np.maximum.reduceat(self.impact, self.at) if len(self.at) else np.zeros(0)
        self.at = np.r_[self.at, len(self.piece)]
        self.first = np.searchsorted(self.key, np.arange(len(self.terms) + 1) * np.int64(self.blocks))
        self.term_max = np.maximum.reduceat(self.block_max, self.first[:-1]) if len(self.terms) else np.zeros(0)
        # look-up of a term by the low bits of its hash, then by the whole
        self.bits = max(12, int(len(self.terms) * 16).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        low = (self.terms & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        self.slot[low] = np.arange(len(self.terms))
        self.clash = np.bincount(low, minlength=1 << self.bits) > 1

    def term_of(self, values: np.ndarray) -> np.ndarray:
        """Each word's term, or -1."""
        if not len(self.terms):
            return np.full(len(values), -1, np.int32)
        low = (values & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        found = self.slot[low]
        found = np.where((found >= 0) & (self.terms[found] == values), found, -1)
        doubt = np.flatnonzero(self.clash[low])
        if len(doubt):
            at = np.minimum(np.searchsorted(self.terms, values[doubt]), len(self.terms) - 1)
            found[doubt] = np.where(self.terms[at] == values[doubt], at, -1)
        return found

    def search(self, values: np.ndarray, offsets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word (within it), piece and score of all passages and pieces that reach the threshold."""
        term = self.term_of(values)
        word = np.flatnonzero(term >= 0)
        text = np.searchsorted(offsets, word, side="right") - 1
        within = (word - offsets[text]) // PIECE
        count = np.maximum(1, -(-np.diff(offsets) // PIECE) - 1)  # passages of each text
        base = np.cumsum(count) - count
        here, before = within < count[text], within > 0
        passage = np.concatenate([(base[text] + within)[here], (base[text] + within - 1)[before]])
        pair = np.sort(passage * np.int64(len(self.terms)) + np.concatenate([term[word][here], term[word][before]]))
        pair = pair[np.r_[True, pair[1:] != pair[:-1]][: len(pair)]]
        found = []
        if len(pair):
            passage, term = np.divmod(pair, len(self.terms))
            starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            for cut in np.split(np.arange(len(starts)), range(2048, len(starts), 2048)):
                a, b = starts[cut[0]], starts[cut[-1] + 1] if cut[-1] + 1 < len(starts) else len(passage)
                found.append(self._block_max_wand(passage[a:b], term[a:b], threshold))
        passage, piece, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        text = np.searchsorted(base, passage, side="right") - 1
        return text, (passage - base[text]) * PIECE, piece, score

    def _block_max_wand(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, piece and score from the threshold on, for many queries at once. (passage, term) are in order.

        The terms of a query stand in order of their largest impacts. Those before the pivot,
        where the sum of these reaches the threshold, cannot reach it by themselves, so
        their postings are passed over: blocks come from the lists from the pivot on. A block is
        skipped if its maxima in these lists, and the others' largest impacts, stay below, then
        if its maxima in all lists do. Only in blocks that are left are pieces scored. Nothing
        that reaches the threshold is skipped.
        """
        least = threshold - MARGIN
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        size = np.diff(np.r_[first, len(passage)])
        query = np.repeat(np.arange(len(first)), size)
        bound = self.term_max[term]
        order = np.lexsort((bound, query))
        total = np.cumsum(bound[order])
        total -= np.r_[0.0, total][first][query]
        early = np.empty(len(term), bool)
        early[order] = total < PASSED * least
        rest = np.bincount(query[early], weights=bound[early], minlength=len(first))

        late = np.flatnonzero(~early)
        count = self.first[term[late] + 1] - self.first[term[late]]
        entry = _stretches(self.first[term[late]], count)
        place, which = np.unique(np.repeat(query[late], count) * np.int64(self.blocks) + self.key[entry] % self.blocks, return_inverse=True)
        upper = np.bincount(which, weights=self.block_max[entry], minlength=len(place))
        place = place[upper + rest[place // self.blocks] >= least]

        # all lists of each query that is left, in each of its blocks
        q, block = np.divmod(place, self.blocks)
        pair = _stretches(first[q], size[q])
        row = np.repeat(np.arange(len(place)), size[q])
        wanted = term[pair] * np.int64(self.blocks) + block[row]
        entry = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        has = self.key[entry] == wanted
        row, entry = row[has], entry[has]
        go = np.bincount(row, weights=self.block_max[entry], minlength=len(place)) >= least
        row, entry = row[go[row]], entry[go[row]]

        count = self.at[entry + 1] - self.at[entry]
        posting = _stretches(self.at[entry], count)
        hit, which = np.unique(np.repeat(q[row], count) * np.int64(len(self.of)) + self.piece[posting], return_inverse=True)
        score = np.bincount(which, weights=self.impact[posting], minlength=len(hit))
        hit, score = hit[score >= least], score[score >= least]
        q, piece = np.divmod(hit, max(1, len(self.of)))
        return passage[first[q]], piece, score


def _stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of the stretches of these starts and lengths, one after the other."""
    ends = np.cumsum(length, dtype=np.int64)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def leaks_in(texts: pa.Array, index: Index, threshold: float, overlap: float) -> list[list[dict]]:
    """For each text, the items whose question and answer both overlap one of its passages."""
    data, offsets = joined_bytes(texts)
    values, _, _, at = word_values(PLAIN[data], offsets)
    found: list[dict[int, dict]] = [{} for _ in range(len(texts))]
    hashes: dict[int, np.ndarray] = {}
    all_of = Stretches(values)
    for text, first, piece, score in zip(*(x.tolist() for x in index.search(values, at, threshold))):
        item = int(index.of[piece])
        n = int(at[text + 1] - at[text])
        lo, hi = max(0, first - index.width[item]), min(n, first + PASSAGE + index.width[item])
        shares = []
        for length, wanted in index.parts[item]:
            if length not in hashes:
                hashes[length] = all_of.all_of(length)
            shares.append(float(np.isin(wanted, hashes[length][at[text] + lo : at[text] + max(lo, hi - length + 1)]).mean()))
        if min(shares) < overlap:
            continue
        row = {"item_id": index.item_id[item], "score": round(score, 6), "question_overlap": shares[0], "answer_overlap": shares[1], "first_word": first, "last_word": min(n, first + PASSAGE) - 1}
        if item not in found[text] or row["score"] > found[text][item]["score"]:
            found[text][item] = row
    return [[x[i] for i in sorted(x)] for x in found]


def indexes(benchmark: DataFrame, most_words: int = PASS_WORDS) -> Iterator[Index]:
    """The index of each pass, one after the other, all with the statistics of the whole benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct().withColumn("tk", text_key())
    pieces = stash(_pieces(items), "benchmark-pieces")
    n, words = pieces.select("item_id", "tk", "piece", "size").distinct().agg(F.count("*"), F.sum("size")).first()
    if not n:
        return
    passes = -(-words // most_words)
    df = pieces.groupBy("term").agg(F.count("*").alias("df"))
    known = stash(pieces.join(df, "term").select("item_id", "tk", "piece", "term", "tf", "size", "df"), "benchmark-postings")
    described = stash(_items(items), "benchmark-items")
    for p in range(passes):
        mine = F.pmod(F.xxhash64("item_id", "tk"), F.lit(passes)) == p
        yield Index(described.where(mine).toArrow(), known.where(mine).toArrow(), n, words / n)


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, result: str = "leaks", most_words: int = PASS_WORDS) -> DataFrame:
    """``documents`` with an array column ``result``: the benchmark items that a text holds.

    Every passage of ``PASSAGE`` words queries the index; all pieces from the threshold on are
    retrieved, and their items stay if ``overlap`` of the 5-word shingles (all words, if fewer) of their
    question and of their answer are in the passage or within an item's length of it. Of an
    item's passages the best counts (ties: the first). Null texts and items, and those without
    words, match nothing. Each different pair of id and text is an item; its id may be null or
    another item's, too. A benchmark of over ``most_words`` words is searched in passes of about so many, each
    written before the next, with the statistics of the whole; results are the same. A
    column already named ``result`` is replaced; others stay as they are. An empty table gives an empty
    table, an empty benchmark empty arrays; a very long text is searched in all its passages.
    """

    def search(text: Column, index: Index) -> Column:
        shared = documents.sparkSession.sparkContext.broadcast(index)
        return on_text_batches(lambda texts: leaks_in(texts, shared.value, threshold, overlap), LEAKS)(text.cast("string"))

    each = indexes(benchmark, most_words)
    first, second = next(each, None), next(each, None)
    if first is None:
        return documents.withColumn(result, F.array().cast(LEAKS))
    if second is None:
        return documents.withColumn(result, search(F.col("text"), first))
    row = free_name(documents, "row")
    rows = stash(documents.withColumn(row, F.monotonically_increasing_id()), "leaks-rows")
    found = None
    for index in (i for part in ((first, second), each) for i in part):
        now = stash(rows.select(F.col(row).alias("row"), search(F.col("text"), index).alias("found")).where(F.size("found") > 0), "leaks-pass")
        found = now if found is None else found.unionByName(now)
    order = F.array_sort("all", lambda a, b: F.when(a.item_id.isNull() & b.item_id.isNull(), 0).when(a.item_id.isNull(), 1).when(b.item_id.isNull(), -1).otherwise(F.signum(a.item_id - b.item_id).cast("int")))
    found = found.groupBy("row").agg(F.flatten(F.collect_list("found")).alias("all")).select(F.col("row").alias(f"{row}2"), order.alias(f"{row}found"))
    joined = rows.join(found, F.col(row) == F.col(f"{row}2"), "left").withColumn(result, F.coalesce(F.col(f"{row}found"), F.array().cast(LEAKS)))
    return joined.select(*[F.col(f"`{c}`") for c in documents.columns if c != result], F.col(result))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; columns as they were."""
    name = free_name(documents, "leaks")
    return leaks(documents, benchmark, result=name).where(F.size(name) == 0).drop(name)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    found = leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")

"""Byte-level BPE by a file of ranks: whole texts to ids, and ids back to bytes.

A text is cut into pre-tokens; those that are whole tokens are resolved by a minimal perfect
hash, a batch at a time, and compared byte by byte with the token found. The others are merged
from single bytes by rank, with a heap over linked parts; a table of their ids, bounded in
entries, lives as long as the Python worker.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import joined_bytes, load, mixed, on_text_batches, slices
from quarry.llm.tokens import _stretches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that are no token, whose ids a worker keeps; a full table starts anew.
KEPT = 1 << 18
#: Bytes of text that are worked on together; a longer text is cut before white space.
SECTION = 1 << 20

#: What follows an apostrophe in a contraction.
ONE, TWO = "stmd", ["re", "ve", "ll"]

OTHER, LETTER, NUMBER, SPACE = range(4)


def ranks_path(path: str | None = None) -> str:
    """The file of ranks; the installed public one if none is given."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The class of each code point, by the library's own engine of patterns: its version of Unicode decides."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        engine = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for plane in range(0, 0x110000, 0x4000):
            every = "".join(chr(c) for c in range(plane, plane + 0x4000) if not 0xD800 <= c < 0xE000)
            out[np.frombuffer(bytes(engine.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def pretokens(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bytes at which pre-tokens start, in UTF-8 texts that start at ``edges``.

    A pre-token is a contraction; or a run of letters, of numbers or of other characters, with the
    space before it; or white space, but for the last of it if text follows.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    place = np.cumsum(wide) - wide
    kind = kinds()[points]
    first = np.zeros(n + 3, bool)  # no character follows in the same text
    first[n:] = True
    first[np.searchsorted(place, edges[edges < len(data)])] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]

    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False

    quote = np.flatnonzero((points == ord("'")) & start)
    quote = quote[~first[quote + 1]]
    padded = np.concatenate([points, np.zeros(2, np.uint32)])
    second, third = padded[quote + 1], np.where(first[quote + 2], 0, padded[quote + 2])
    short = np.isin(second, list(map(ord, ONE)))
    long = np.zeros(len(quote), bool)
    for a, b in TWO:
        long |= (second == ord(a)) & (third == ord(b))
    start[quote[short | long] + 1] = False
    end = np.concatenate([quote[short] + 2, quote[long] + 3])
    start[end[end < n]] = True
    return place[start]


class PerfectHash:
    """Gives each of n different 64-bit numbers a place of its own below n, and any other number some place.

    Numbers are dealt into buckets; from the largest bucket on, each gets the first shift that
    moves all its numbers to free places. Buckets of one get one of the places left.
    """

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, numbers: np.ndarray, load: int = 3):
        self.n = max(1, len(numbers))
        self.shift = np.zeros(max(1, -(-len(numbers) // load)), np.int64)
        bucket = self._bucket(numbers)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(self.shift))
        ends = np.cumsum(sizes)
        free = np.ones(self.n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            mine = numbers[order[ends[b] - sizes[b] : ends[b]]]
            if len(mine) < 2:
                break
            tried = 0
            while True:
                shifts = np.arange(tried, tried + 64)
                places = self._moved(mine, shifts[:, None])
                good = free[places].all(1)
                if len(mine) > 1:
                    good &= (np.diff(np.sort(places, 1), axis=1) > 0).all(1)
                if good.any():
                    at = int(np.argmax(good))
                    self.shift[b], tried = shifts[at], 0
                    free[places[at]] = False
                    break
                tried += 64
        alone = np.flatnonzero(sizes == 1)
        self.shift[alone] = -1 - np.flatnonzero(free)[: len(alone)]

    def _bucket(self, numbers: np.ndarray) -> np.ndarray:
        return (mixed(numbers) % np.uint64(len(self.shift))).astype(np.int64)

    def _moved(self, numbers: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mixed(numbers + (shift.astype(np.uint64) + np.uint64(1)) * self.STEP) % np.uint64(self.n)).astype(np.int64)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        shift = self.shift[self._bucket(numbers)]
        return np.where(shift < 0, -1 - shift, self._moved(numbers, np.maximum(shift, 0)))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


class Coder:
    """The ids that a rank file gives to texts, and the bytes of ids."""

    def __init__(self, path: str, kept: int = KEPT, section: int = SECTION):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.ids = np.array([self.ranks[t] for t in tokens], np.int64)
        self.size = np.array(list(map(len, tokens)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.longest = int(self.size.max())
        seed = 0
        while True:  # until all tokens have different fingerprints
            self.weights = np.random.default_rng(seed).integers(0, 1 << 64, self.longest + 1, np.uint64, endpoint=False)
            prints = self._fingerprints(self.pool, self.start, self.size)[0]
            if len(np.unique(prints)) == len(prints):
                break
            seed += 1
        self.hash = PerfectHash(prints)
        self.at = np.zeros(len(tokens), np.int64)
        self.at[self.hash.places(prints)] = np.arange(len(tokens))
        self.prints = prints
        self.row_of = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.row_of[self.ids] = np.arange(len(tokens))
        self.kept, self.section = kept, section
        self.known: dict[bytes, bytes] = {}

    def _fingerprints(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each of the stretches that ``data`` is made of, and each byte's place in its stretch."""
        inner = np.arange(len(data)) - np.repeat(start, size)
        sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * self.weights[np.minimum(inner, self.longest)], start)
        return mixed(sums + size.astype(np.uint64)), inner

    def whole(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The row of the token that each stretch is, or -1."""
        prints, inner = self._fingerprints(data, start, size)
        row = self.at[self.hash.places(prints)]
        alike = (self.prints[row] == prints) & (self.size[row] == size)
        each = np.repeat(alike, size)
        same = np.ones(len(data), bool)
        same[each] = data[each] == self.pool[(np.repeat(self.start[row], size) + inner)[each]]
        return np.where(alike & np.logical_and.reduceat(same, start), row, -1)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: of adjacent parts the two whose union has the least rank are joined, the leftmost first, until none has a rank."""
        n, rank = len(word), self.ranks.get
        s = n.bit_length()
        low = (1 << s) - 1
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r << s | i) << s | i + 2 for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]  # rank, start and end of a union, as one number
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, e = x >> s & low, x & low
            j = end[i]
            if not j or j == n or end[j] != e:
                continue  # parts have changed since
            end[i], end[j] = e, 0
            if e < n:
                before[e] = i
                if (r := rank(word[i : end[e]])) is not None:
                    heappush(heap, (r << s | i) << s | end[e])
            h = before[i]
            if h >= 0 and (r := rank(word[h:e])) is not None:
                heappush(heap, (r << s | h) << s | e)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def _misses(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that are no token, one after the other, and how many each has."""
        if len(self.known) + len(words) > self.kept:
            self.known = {}
        known = self.known
        rows = list(map(known.get, words))
        for i in [i for i, row in enumerate(rows) if row is None]:
            w = words[i]
            row = known.get(w)
            if row is None:
                row = known[w] = array("I", self.merge(w)).tobytes()
            rows[i] = row
        return np.frombuffer(b"".join(rows), np.uint32), np.fromiter(map(len, rows), np.int64, len(rows)) // 4

    def _edges(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts of texts, the end, and places before white space within long texts, where pre-tokens never go across."""
        extra = []
        for i in np.flatnonzero(np.diff(at) > self.section).tolist():
            text = data[at[i] : at[i + 1]]
            space = ((text[1:] == 0x20) | (text[1:] == 0x0A)) & (text[:-1] > 0x20) & (text[:-1] < 0x7F)
            found = np.flatnonzero(space) + 1
            near = np.searchsorted(found, np.arange(self.section, len(text), self.section))
            extra.append(at[i] + found[near[near < len(found)]])
        return np.unique(np.concatenate([at, *extra]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (unsigned 32-bit), and their n+1 offsets. A null text has none."""
        data, at = joined_bytes(texts)
        edges = self._edges(data, at)
        out, total, before, a = [np.zeros(0, np.uint32)], np.zeros(len(edges), np.int64), 0, 0
        while a + 1 < len(edges):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + self.section, side="right")) - 1)
            ids, ends = self._section(data[edges[a] : edges[b]], edges[a : b + 1] - edges[a])
            out.append(ids)
            total[a + 1 : b + 1] = before + ends
            before += len(ids)
            a = b
        return np.concatenate(out), total[np.searchsorted(edges, at)]

    def _section(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = pretokens(data, edges)
        size = np.diff(np.r_[start, len(data)])
        row = self.whole(data, start, size)
        miss = np.flatnonzero(row < 0)
        raw = data.tobytes()
        ids, sizes = self._misses([raw[a:b] for a, b in zip(start[miss].tolist(), (start + size)[miss].tolist())])
        count = np.ones(len(start), np.int64)
        count[miss] = sizes
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]), np.uint32)
        hit = row >= 0
        out[(ends - 1)[hit]] = self.ids[row[hit]]
        out[_stretches((ends - count)[miss], sizes)] = ids
        return out, ends[np.searchsorted(start, edges[1:]) - 1]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each document's begin, for documents whose ids begin at ``at``."""
        if len(ids) and (ids.max() >= len(self.row_of) or self.row_of[ids].min() < 0):
            raise ValueError("an id that the ranks don't have")
        row = self.row_of[ids]
        ends = np.r_[0, np.cumsum(self.size[row])]
        return self.pool[_stretches(self.start[row], self.size[row])], ends[at]


def _cut(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def encode(text: str | Column, ranks: str | None = None) -> Column:
    """Ids of whole texts, as binary little-endian unsigned 32-bit integers; null and empty texts have none.

    The file of ranks must be at the same path on all machines. Texts of any length are worked on
    in sections of about a megabyte.
    """
    path = ranks_path(ranks)

    def run(texts: pa.Array) -> list[bytes]:
        ids, at = coder(path).encode(texts)
        return _cut(ids.astype("<u4").view(np.uint8), 4 * at)

    return on_text_batches(run, "binary")(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def decode(ids: str | Column, ranks: str | None = None) -> Column:
    """The bytes of ids that ``encode`` gave; null has none. An id that the file doesn't have is an error."""
    path = ranks_path(ranks)

    def run(column: pa.Array) -> list[bytes]:
        data, at = joined_bytes(column.cast(pa.large_binary()).fill_null(b""))
        return _cut(*coder(path).decode(np.frombuffer(data.tobytes(), "<u4"), at // 4))

    return on_text_batches(run, "binary")(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids and decoded of each document, row by row: repeated rows, null ids and ties stay as they are; an empty table gives none.

    Ids are decoded where they were found. Other columns, whatever their names, are not read.
    """
    path = ranks_path(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SECTION):
            ids, at = coder(path).encode(batch.column("text"))
            decoded = coder(path).decode(ids, at)
            binary = [pa.array(_cut(*x), pa.binary()) for x in ((ids.astype("<u4").view(np.uint8), 4 * at), decoded)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *binary], names=["doc_id", "ids", "decoded"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(load(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

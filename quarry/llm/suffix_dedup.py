"""Suffix-array dedup of byte strings, by two-stage suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import load, slices
from quarry.llm.repeats import SLICE, SPANS, Block, Kind, by_blocks, covered, removed_spans, runs_of

LENGTH, GRAM = 200, 50
#: Bytes of contexts in one suffix array.
BLOCK = 1 << 18

OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` symbols.

    ``text`` holds symbols 1 to 255, and 0 after each string. A suffix smaller than its
    successor is of type B: only these are sorted directly. Of the others, of type A, the
    place follows from their successor's: a scan through the buckets of first symbols, from
    the smallest on, meets each suffix in order and appends its predecessor, if of type A,
    to the front part of the predecessor's bucket. The scan handles a whole bucket at
    once: first its A part, whose runs of one symbol extend it, then its B part.
    """
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = 1  # a string's end is smaller than whatever follows
    later = np.where(step != 0, np.arange(n), n)
    later = np.minimum.accumulate(later[::-1])[::-1]  # next place where the symbol changes
    smaller = step[later] > 0  # type B

    b = np.flatnonzero(smaller)
    padded = np.zeros(n + depth, np.uint8)
    padded[:n] = text
    b = b[np.argsort(np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))[b].view(f"S{depth}").ravel(), kind="stable")]

    b_at = np.searchsorted(text[b], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        part = [np.concatenate(fronts[c])] if fronts[c] else []
        fronts[c] = []
        run = part[0] if part else None
        while run is not None and len(run):  # A suffixes of this bucket whose successor is in it too
            before = run[run > 0] - 1
            run = before[(text[before] == c) & ~smaller[before]]
            part.append(run)
        part.append(b[b_at[c] : b_at[c + 1]])
        bucket = np.concatenate(part)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]  # larger than its successor, so of type A
        if len(before):
            symbol = text[before]
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            starts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
            for piece, s in zip(np.split(before, starts[1:]), symbol[starts].tolist()):
                fronts[s].append(piece)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Lengths, at most ``most``, of the prefixes that the suffixes at left and right share, by their bytes."""
    eights = -(-most // 8)
    padded = np.zeros(len(text) + 8 * eights, np.uint8)
    padded[: len(text)] = text
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(text), 8 * eights), (1, 1))
    out = np.empty(len(left), np.int64)
    for at in range(0, len(left), 4096):
        i, j = left[at : at + 4096], right[at : at + 4096]
        differ = words[i].view("<u8") ^ words[j].view("<u8")
        first = (differ != 0).argmax(axis=1)
        x = differ[np.arange(len(i)), first]  # the lowest byte that differs comes first
        length = 8 * first + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        out[at : at + 4096] = np.minimum(np.where(x == 0, most, length), np.minimum(most, len(text) - np.maximum(i, j)))
    return out


def _by_suffix_array(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that share a prefix of the full length with a neighbour in the suffix array."""
    length = block.kind.window
    row, at = block.windows()
    used = np.flatnonzero(block.hi > block.lo)
    if not len(used):
        return row, at, np.zeros(len(row), bool)
    # what the windows in question reach, with a 0 after each piece; 255 is no byte of UTF-8, so symbols move up by one
    begin = block.start[used] + block.lo[used]
    size = block.hi[used] - block.lo[used] - 1 + length
    to = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(to, size) + within] = block.elements[np.repeat(begin, size) + within] + 1

    order = two_stage_order(text, length)
    moved = np.zeros(len(block.lo), np.int64)
    moved[used] = to - begin
    place = at + moved[row]
    window = np.full(len(text), -1)
    window[place] = np.arange(len(place))
    mine = window[order]
    mine = mine[mine >= 0]
    repeated = np.zeros(len(row), bool)
    if len(mine) > 1:
        same = common_prefixes(text, place[mine[:-1]], place[mine[1:]], length) >= length
        repeated[mine[1:][same]] = True
        repeated[mine[:-1][same]] = True
    return row, at, repeated


def remove_repeated_strings(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Bytes of each text without those in a ``length``-byte string that also starts elsewhere.

    Contexts around repeated anchors are sorted as suffixes, in two stages (see
    ``two_stage_order``); windows whose common prefix with a neighbour has ``length`` bytes are
    repeated: prefixes are compared byte by byte. A context that itself is met twice needs no
    sort: all its windows are. Those of an anchor with over ``repeats.HOT`` different contexts
    are counted by digests instead, so that no task sorts a group of any size.

    Columns: doc_id, n_bytes, n_removed, spans (byte positions of the maximal removed runs,
    end exclusive) and kept (binary, as a cut may fall within a character). A null text has
    no bytes. Matches never cross texts; overlaps count. Rows with equal doc_id or text
    stay separate rows and count as repeats of each other. A null doc_id stays null. An
    empty table gives an empty table. Other columns are ignored.
    """
    found = removed_spans(documents, Kind(False, length, gram), by_blocks(_by_suffix_array, BLOCK), "suffix-dedup")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            n_bytes, n_removed, removed, kept = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = (text or "").encode()
                left, start, end = data, (), ()
                if spans:
                    gone = covered(spans, len(data), length)
                    start, end = runs_of(gone)
                    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(left))
                removed.append([{"start": a, "end": b} for a, b in zip(start, end)])
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, SPANS), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return found.select("doc_id", "text", "spans").mapInArrow(finish, OUT)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated_strings(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

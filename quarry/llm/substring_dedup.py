"""Substring dedup over word windows, by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import load, slices
from quarry.llm.repeats import SLICE, SPANS, Kind, by_levels, covered, removed_spans, runs_of

WINDOW, GRAM = 35, 9

OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def remove_repeated_windows(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Words of each text without those in a window of ``window`` words that also starts elsewhere.

    Levels: ``gram`` words at every window's anchor, twice that, then the full window.
    Windows met once at one length are dropped; those repeated are extended to twice the
    length (the last time to ``window``), until none survive or the full length is reached.
    Each level counts over all documents. A whole stretch of windows around an anchor that
    is met twice needs no level: all its windows are repeated. What is equal is told by
    digests of the words themselves (see ``repeats``).

    Columns: doc_id, n_words, n_removed, spans (word positions removed, end exclusive), and
    kept (the other words, joined by a space). A null text has no words and keeps ''. Texts
    under ``window`` words keep everything. Rows with equal doc_id or text stay separate
    rows, and count as repeats of each other. A null doc_id stays null. An empty table
    gives an empty table. Other columns are ignored.
    """
    kind = Kind(True, window, gram)
    found = removed_spans(documents, kind, by_levels, "substring-dedup")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            n_words, n_removed, removed, kept = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = (text or "").encode().split()
                start = end = ()
                if spans:
                    gone = covered(spans, len(words), window)
                    start, end = runs_of(gone)
                    words_left = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    words_left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(words_left))
                removed.append([{"start": a, "end": b} for a, b in zip(start, end)])
                kept.append(b" ".join(words_left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, SPANS), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return found.select("doc_id", "text", "spans").mapInArrow(finish, OUT)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated_windows(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

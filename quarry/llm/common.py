"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and
#: carriage return. ``bytes.split()`` splits UTF-8 at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local folder is taken in
    local mode, as in tests; on a cluster it would be another folder on each machine, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints/quarry"
    return found.rstrip("/")


def stash(df: DataFrame, tag: str, small: bool = False, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage durably.

    Shuffle files of the finished jobs are released, so that a long operator doesn't
    hold the shuffles of all its steps at once (``small`` tables leave that to the next one).
    The written table survives executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stashed_at = path
    del df
    if not small:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return back


def unstash(df: DataFrame) -> None:
    """Deletes a stashed table that a later one has replaced."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has (names don't differ by case alone)."""
    taken, out = {c.lower() for c in df.columns}, f"__{name}"
    while any(c.startswith(out) for c in taken):
        out = f"_{out}"
    return out


def text_key() -> Column:
    """With doc_id, tells the rows of a table apart; rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` has about ``most`` bytes in each (a single longer value stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (or the bytes of all binary values) one after the other, and their n+1 offsets (null: empty)."""
    filled = pa.compute.fill_null(texts, "") if texts.null_count else texts
    if not (pa.types.is_large_string(filled.type) or pa.types.is_large_binary(filled.type)):
        filled = filled.cast(pa.large_string() if pa.types.is_string(filled.type) else pa.large_binary())
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if data is None or not len(filled):
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of ``data``, as rows; beyond the end are 0s."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))


def first_bytes(at_each: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The up to eight first bytes of stretches, as little-endian integers; shorter ones (none, if the size is negative) are padded with 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return at_each[np.minimum(starts, len(at_each) - 1)].view("<u8").ravel() & _LOW[np.clip(size, 0, 8)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits depend on all input bits (the MurmurHash3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def on_text_batches(fn: Callable[[pa.Array], list], returns: str) -> Callable[[Column], Column]:
    """A column function over whole texts, in Arrow arrays of bounded bytes; evaluated once for each row."""

    def apply(texts: Column) -> Column:
        kind = to_arrow_type(_parse_datatype_string(returns))

        def run(texts: pa.Array) -> pa.Array:
            parts = [pa.array(fn(piece.column(0)), kind) for piece in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text")]
            return pa.concat_arrays(parts) if parts else pa.array([], kind)

        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, returns).asNondeterministic()(texts)

    return apply


def on_texts(fn: Callable[[list[str | None]], list], returns: str) -> Callable[[Column], Column]:
    """As ``on_text_batches``, with the texts as Python strings."""
    return on_text_batches(lambda texts: fn(texts.to_pylist()), returns)


#: Small letters, digits and bytes beyond ASCII stay; capital letters become small, all else a space.
PLAIN = np.array([c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def plain_words(text: str | None) -> list[bytes]:
    """Words without case and punctuation."""
    return (text or "").encode().translate(PLAIN.tobytes()).split()

"""Token ids in binary files: frequency-ranked, byte-aligned variable-length coding.

A file set is a folder of two tables. ``ranks`` has one row for each id that occurs: its
rank by frequency over all documents (ties: the smaller id first) and its count. ``blocks``
has rows of consecutive documents in ascending doc_id order: the documents' ids and
lengths, one control byte for each four ranks (two bits each: bytes less one), and, apart
from them, the ranks' one to four little-endian bytes. Frequent ids take one byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import joined_bytes, load, shared_dir, slices, stash
from quarry.llm.tokens import encoder, vocabulary_path

END = 0
#: Ids in a block; a longer document has a block of its own.
BLOCK = 1 << 18

BLOCKS = "part int, block int, first long, doc_ids array<long>, n_tokens array<int>, control binary, data binary"

#: For each control byte: its four lengths.
LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
#: For each length: the mask of a little-endian 32-bit word's bytes that count.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers: lengths by table from the control bytes, places by a running sum, values by a masked word at each place."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, (max(0, len(padded) - 3), 4), (1, 1))
    taken = words[ends - size]
    return np.ascontiguousarray(taken).view("<u4").ravel() & MASKS[size]


def token_ids(documents: DataFrame, vocabulary: str | None, end_id: int) -> DataFrame:
    """doc_id, ids: each text's ids (null: none) and the end id, as little-endian 16- or 32-bit integers."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        kind = "<u2" if tokenizer.size <= 1 << 16 and end_id < 1 << 16 else "<u4"
        width = int(kind[-1])
        for batch in slices(batches, "text", 1 << 20):
            ids, at = tokenizer.encode(batch.column("text"))
            data = np.insert(ids, at[1:], end_id).astype(kind).tobytes()
            ends = ((at + np.arange(len(at))) * width).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(np.full(batch.num_rows, width, np.int32))], names=["doc_id", "ids", "width"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary, width int")


def _values(batch: pa.RecordBatch) -> np.ndarray:
    data, _ = joined_bytes(batch.column("ids"))
    return np.frombuffer(data, f"<u{batch.column('width')[0].as_py()}")


def counts(ids: DataFrame) -> DataFrame:
    """id, n over all documents: one row for each task and id is shuffled, a vocabulary's rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            now = np.bincount(_values(batch))
            if len(now) > len(total):
                now[: len(total)] += total
                total = now
            else:
                total[: len(now)] += now
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    return ids.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END) -> None:
    """Encode all texts and write the file set to ``path``, in ascending doc_id order.

    Each text is encoded once and kept; ids are counted over all documents before the files
    are written. A null text has the end id only. A null doc_id comes before all others;
    rows with equal doc_id follow each other, ordered by a hash of their ids. An empty table
    gives empty files. The counts, one for each id of the vocabulary, reach the driver and go to all tasks.
    """
    path = path.rstrip("/")
    spark = documents.sparkSession
    ids = stash(token_ids(documents, vocabulary, end_id), "token-ids", compression="zstd")
    found = sorted(((r["id"], r["n"]) for r in counts(ids).collect()), key=lambda x: (-x[1], x[0]))
    ranks = spark.createDataFrame([(i, r, n) for r, (i, n) in enumerate(found)], "id long, rank long, n long")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((i for i, _ in found), default=0) + 1, np.uint32)
    rank_of[[i for i, _ in found]] = np.arange(len(found))
    table = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, "ids", 2 * BLOCK):
            sizes = np.asarray(pa.compute.binary_length(batch.column("ids"))) // batch.column("width")[0].as_py()
            control, data = pack(table.value[_values(batch)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                ],
                names=["part", "block", "first", "doc_ids", "n_tokens", "control", "data"],
            )
            block, first = block + 1, first + int(sizes.sum())

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"))
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks", compression="zstd")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (array) of every document in the files.

    A total for each file part, of which there are as many as shuffle partitions, passes the driver.
    """
    return _read(spark, path, "doc_id long, start long, ids array<long>", lambda ids: pa.array(ids, pa.list_(pa.int64())), "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, without its ids."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", None, None)


def _read(spark: SparkSession, path: str, schema: str, column, name) -> DataFrame:
    path = path.rstrip("/")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    total, before = 0, {}
    sums = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    for r in sorted(sums.collect(), key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]
    found = spark.read.schema("id long, rank long, n long").parquet(f"{path}/ranks").select("rank", "id").collect()
    id_of = np.zeros(len(found), np.uint32)
    for r in found:
        id_of[r["rank"]] = r["id"]
    shared = spark.sparkContext.broadcast((id_of, before))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of, before = shared.value
        for batch in batches:
            for part, first, doc_ids, n_tokens, control, data in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "doc_ids", "n_tokens", "control", "data"))):
                sizes = np.array(n_tokens, np.int64)
                ids = id_of[unpack(control, data, int(sizes.sum()))]
                ends = np.cumsum(sizes)
                start = before[part] + first + ends - sizes
                each = np.split(ids, ends[:-1]) if len(ends) else []
                if column:
                    rest = [column([x.tolist() for x in each])]
                else:
                    rest = [pa.array(sizes), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start), *rest], names=["doc_id", "start", *([name] if column else ["n_tokens", "ids_crc32"])])

    return blocks.select("part", "first", "doc_ids", "n_tokens", "control", "data").mapInArrow(decode, schema)


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Write the file set, to a new folder in the shared one if no path is given, and read its digests back."""
    import uuid

    spark = documents.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents, path)
    return token_digests(spark, path)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    return encoded(load(spark, sf_dir, "documents"))

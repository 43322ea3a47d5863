"""Readers and writers: JSON lines with provenance, damaged packets, uploads, keyed overwrites, scratch tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints/quarry").rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: fixed once, read by several branches."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _schema(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else _parse_datatype_string(schema)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON objects, one a line; blank lines are skipped. Bad lines fail the read, or else have ``corrupt``."""
    fields = StructType([*_schema(schema).fields]).add("corrupt", "string")
    found = spark.read.schema(fields).json(paths, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")
    if strict:
        message = F.concat(F.lit("not a JSON object: "), F.col("_metadata.file_name"), F.lit(": "), F.col("corrupt"))
        return found.select(F.when(F.col("corrupt").isNotNull(), F.raise_error(message).cast("string")).alias("__bad"), *[f.name for f in _schema(schema)]).where("__bad is null").drop("__bad")
    return found


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON object for each file."""
    return spark.read.schema(_schema(schema)).json(path, multiLine=True, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys in order; as many files as partitions."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, offset (of the line's split), line of text files; byte-order marks go, blank lines are dropped."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "^﻿", "").alias("line"))
    return lines.where(F.length(F.trim("line")) > 0)


PACKET = "struct<case_id:string,annotator_id:string,judgments:map<string,string>,notes:string>"


def parsed_packet(line: Column) -> Column:
    """An annotation packet and ``recovered``: of a damaged line, the ids and whatever follows its last "judgments" still count; null if even these can't be read."""
    whole = F.from_json(line, PACKET, {"mode": "PERMISSIVE"})
    good = F.try_parse_json(line).isNotNull()
    tail = F.from_json(F.concat(F.lit("{"), F.regexp_extract(line, r'(?s)^.*("judgments".*)$', 1)), "struct<judgments:map<string,string>,notes:string>")
    case = F.nullif(F.regexp_extract(line, r'"case_id"\s*:\s*"([^"]+)', 1), F.lit(""))
    annotator = F.nullif(F.regexp_extract(line, r'"annotator_id"\s*:\s*"([^"]+)', 1), F.lit(""))
    saved = F.struct(case.alias("case_id"), annotator.alias("annotator_id"), tail["judgments"].alias("judgments"), F.coalesce(tail["notes"], F.lit("")).alias("notes"))
    usable = case.isNotNull() & annotator.isNotNull() & tail["judgments"].isNotNull()
    return F.struct(F.when(good, whole).when(usable, saved).alias("packet"), (~good & usable).alias("recovered"))


# File kinds, their first bytes (hexadecimal) and declared types.
KINDS = {
    ".pdf": ("25504446", "application/pdf"),
    ".docx": ("504B0304", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ".pptx": ("504B0304", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ".png": ("89504E47", "image/png"),
    ".jpg": ("FFD8FF", "image/jpeg"),
    ".jpeg": ("FFD8FF", "image/jpeg"),
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def upload_error(name: Column, content: Column, declared: Column | None = None, most_mb: int = 100) -> Column:
    """The first check that an upload fails, of kind, first bytes, declared type (empty passes) and size; null if none."""
    kind = lambda i: F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[i])])[extension(name)]
    first = F.unhex(kind(0))
    bad = F.when(kind(0).isNull(), "FILE_UNSUPPORTED_TYPE").when(F.substring(content, F.lit(1), F.length(first)) != first, "FILE_UNSUPPORTED_TYPE")
    if declared is not None:
        bad = bad.when((F.coalesce(declared, F.lit("")) != "") & (declared != kind(1)), "FILE_UNSUPPORTED_TYPE")
    return bad.when(F.length(content) == 0, "FILE_UNSUPPORTED_TYPE").when(F.length(content) > most_mb * 1024 * 1024, "FILE_TOO_LARGE")


def read_uploads(spark: SparkSession, path: str, most_mb: int = 100) -> DataFrame:
    """name, size, sha256 and error of each file; Spark's reader leaves out files without bytes."""
    f = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return f.select(name.alias("name"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), upload_error(name, F.col("content"), most_mb=most_mb).alias("error"))


def replace_documents(df: DataFrame, path: str, key: str = "document_id", buckets: int = 0) -> None:
    """Rewrites just the partitions of the documents in ``df``, so that a repeated write changes nothing.

    With ``buckets`` the folders are by hash of the key, and rows of other documents in the
    touched folders are read back and kept: few folders for many documents.
    """
    spark = df.sparkSession
    if not buckets:
        df.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        return
    new = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        old = None
    if old is not None:
        touched = new.select("bucket").distinct()
        rest = old.join(F.broadcast(touched), "bucket", "left_semi").join(new.select(key).distinct(), key, "left_anti")
        new = written(new.unionByName(rest.select(*new.columns)), "replace")
    new.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def first_of_content(df: DataFrame, content: str = "content", tie: str = "document_id") -> DataFrame:
    """With sha256, and is_duplicate for all rows of a content but that of the smallest id: hashes and ids are aggregated, contents are not."""
    hashed = df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    least = hashed.groupBy("sha256").agg(F.min(tie).alias("__least"))
    return hashed.join(least, "sha256").withColumn("is_duplicate", F.col(tie) != F.col("__least")).drop("__least")


def fallback_embedding(text: Column, dim: int = 768) -> Column:
    """A unit vector seeded by the text's SHA-256, equal for equal texts."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        import hashlib
        import math
        import random

        def one(t: str | None) -> list[float]:
            rng = random.Random(int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:4], "big"))
            v = [rng.gauss(0, 1) for _ in range(dim)]
            size = math.sqrt(sum(x * x for x in v))
            return [x / size for x in v] if size else v

        return texts.map(one)

    return run(text)


def embedded(chunks: DataFrame, dim: int = 768, embed=fallback_embedding) -> DataFrame:
    """``chunks`` with an embedding; equal contents are embedded once."""
    hashed = chunks.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    one = hashed.groupBy("content_hash").agg(F.first("content").alias("content")).select("content_hash", embed(F.col("content"), dim).alias("embedding"))
    return hashed.join(one, "content_hash")

"""Several tables that change together: staged files, and one manifest that a rename puts in force.

A store is a folder of parquet folders and of numbered manifests. A manifest names, for each table,
the folders that are its content. A commit writes its folders first and then renames its manifest to
the next number, which fails if that exists: until then readers see the old state as a whole, and of
two writers who began at the same version only one gets through. The rename is atomic where the file
system's is (HDFS and stores with such a rename; a local folder is for one driver).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Folders of a bucket from which on it is written as one again.
PIECES = 16


def _several(folders: str | list[str]) -> list[str]:
    """A bucket's folders; manifests of earlier versions name one."""
    return folders if isinstance(folders, list) else [folders]


class Conflict(RuntimeError):
    """Another writer has committed since this one read the state."""


class Store:
    """Tables under ``path``; ``buckets`` is the number of parts of a keyed table, of which a commit rewrites those that it touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._path("")
        self._fs = root.getFileSystem(conf)
        self._names = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The number of the newest manifest; 0 for an empty store."""
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(self._path("manifests")) if f.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path(f"manifests/{version:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, schema: str | StructType, state: dict | None = None) -> DataFrame:
        """A table as of ``state`` (the newest one if none is given); empty if nothing was committed to it."""
        entry = (state or self.manifest())["tables"].get(table)
        if not entry:
            return self.spark.createDataFrame([], schema)
        folders = entry["folders"] if isinstance(entry["folders"], list) else [f"{f}/bucket={b}" for b, fs in entry["folders"].items() for f in _several(fs)]
        paths, reader = [f"{self.path}/data/{f}" for f in folders], self.spark.read.schema(schema)
        if entry.get("by"):  # each folder has folders of values of its own
            return reduce(DataFrame.unionByName, [reader.parquet(p) for p in paths])
        return reader.parquet(*paths)

    def begin(self) -> Commit:
        return Commit(self)


class Commit:
    """Changes on top of the version read at its start. Nothing of it counts before ``finish``."""

    def __init__(self, store: Store):
        self.store, self.state = store, store.manifest()
        self.tables = json.loads(json.dumps(self.state["tables"]))

    def read(self, table: str, schema: str | StructType) -> DataFrame:
        return self.store.read(table, schema, self.state)

    def append(self, table: str, rows: DataFrame, by: str | None = None) -> None:
        """Adds rows, in folders ``by`` a column if one is given; readers that ask for some of its values skip the others."""
        folder = f"{table}-{uuid.uuid4().hex}"
        (rows.write.partitionBy(by) if by else rows.write).parquet(f"{self.store.path}/data/{folder}")
        self.tables.setdefault(table, {"folders": [], "by": by})["folders"].append(folder)

    def replace(self, table: str, rows: DataFrame) -> None:
        """The table's whole new content."""
        self.tables.pop(table, None)
        self.append(table, rows)

    def bucket(self, *keys: str):
        return F.pmod(F.xxhash64(*keys), F.lit(self.store.buckets)).cast("int")

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Puts ``rows``, one for each key, in place of those with their keys.

        Only the buckets that have such keys, or ``PIECES`` folders already, are written anew; others get the new rows as one more folder.
        """
        new = rows.withColumn("bucket", self.bucket(*keys))
        staged, read = f"{table}-{uuid.uuid4().hex}", self.store.spark.read
        new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.store.path}/data/{staged}-new")
        new = read.schema(new.schema).parquet(f"{self.store.path}/data/{staged}-new")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # a store has a fixed number of buckets
        held = self.tables.get(table, {"folders": {}})["folders"]
        paths = lambda bs: [f"{self.store.path}/data/{f}/bucket={b}" for b in bs for f in _several(held[str(b)])]
        old = [b for b in touched if str(b) in held]
        anew = set()
        if old:
            shared = read.schema(rows.schema).parquet(*paths(old)).join(new.select(*keys), keys, "left_semi")
            anew = {r["b"] for r in shared.select(self.bucket(*keys).alias("b")).distinct().collect()}
            anew |= {b for b in old if len(_several(held[str(b)])) >= PIECES}
        if anew:
            kept = read.schema(rows.schema).parquet(*paths(sorted(anew))).join(new.select(*keys), keys, "left_anti")
            both = kept.withColumn("bucket", self.bucket(*keys)).unionByName(new.where(F.col("bucket").isin(sorted(anew))))
            both.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.store.path}/data/{staged}")
        self.tables[table] = {"folders": held | {str(b): [staged] if b in anew else [*_several(held.get(str(b), [])), f"{staged}-new"] for b in touched}}

    def finish(self) -> int:
        """Puts all changes in force at once and gives the new version; raises ``Conflict`` if the state has changed since."""
        store, version = self.store, self.state["version"] + 1
        staged = store._path(f"manifests/staged-{uuid.uuid4().hex}")
        out = store._fs.create(staged, False)
        out.write(json.dumps({"version": version, "tables": self.tables}).encode())
        out.close()
        options = store.spark.sparkContext._gateway.new_array(getattr(store._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            store._names.rename(staged, store._path(f"manifests/{version:012d}"), options)
        except Py4JJavaError as error:
            store._fs.delete(staged, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                raise Conflict(f"version {version} is there already") from None
            raise
        return version

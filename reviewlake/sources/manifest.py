"""Bucketed tables behind a manifest: what counts is what the newest manifest names.

Rows live in folders per bucket, written once and never changed. A manifest is a small JSON file that
lists, per bucket, the folders that hold its rows, so no reader has to list what has piled up, and one
rename makes any number of changed buckets visible together. A job that dies before that leaves folders
nobody names. Folders a commit replaces stay until the commit after it, for readers that already planned.

Keys can be removed without touching their rows: a folder of keys is named together with the number of
row folders its bucket had by then, and a reader leaves those keys out of them until the bucket is merged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"
MOST_FOLDERS = 8  # folders of one bucket before they are merged into one


class Files:
    """The few file operations a manifest needs, in whatever store the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.root = path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Make a whole file appear under a name nobody has taken; False if somebody has."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        self._fs.mkdirs(draft.getParent())
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.exists(self._path(name)) and self._fs.rename(draft, self._path(name)):
            return True
        self._fs.delete(draft, False)
        return False

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def delete(self, names: Iterable[str]) -> None:
        for name in names:
            self._fs.delete(self._path(name), True)


class BucketTable:
    """A table of keyed rows in ``buckets`` buckets; see the module's text.

    The number of buckets is stored with the table: a writer that names another is refused.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int | None = None):
        self.spark, self.key = spark, list(key)
        self.files = Files(spark, path)
        versions = [n for n in self.files.names("_manifest") if n.endswith(".json")]
        self.state = json.loads(self.files.read(f"_manifest/{versions[-1]}")) if versions else \
            {"version": 0, "buckets": buckets, "schema": None, "folders": {}, "old": [], "done": {}}
        self.state.setdefault("removed", {})  # by bucket: [number of its first row folders meant, folder of keys]
        if buckets not in (None, self.state["buckets"]):
            raise ValueError(f"the table has {self.state['buckets']} buckets, not {buckets}")
        self.buckets = self.state["buckets"]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Numbers of the buckets these rows fall into; at most ``buckets``."""
        return sorted(r[0] for r in rows.select(self.bucket().alias(BUCKET)).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """Rows of these buckets (of all, if none are named); None while the table has no rows at all."""
        if self.state["schema"] is None:
            return None
        schema = T.StructType.fromJson(self.state["schema"])
        wanted = self.state["folders"] if buckets is None else [str(b) for b in buckets if str(b) in self.state["folders"]]
        removed = self._removed(wanted, schema)
        last = max((n for b in wanted for n, _ in self.state["removed"].get(b, [])), default=0)
        ages: dict[int, list[str]] = {}  # row folders by their place in their bucket; from the last removal on that does not matter
        for b in wanted:
            for n, folder in enumerate(self.state["folders"][b]):
                ages.setdefault(min(n, last), []).append(f"{self.files.root}/{folder}")
        if removed is None:
            return self.spark.read.schema(schema).parquet(*ages[0]) if ages else self.spark.createDataFrame([], schema)
        aged = [self.spark.read.schema(schema).parquet(*paths).withColumn("_age", F.lit(n)) for n, paths in ages.items() if n < last]
        held = reduce(DataFrame.union, aged).join(removed, self.key, "left").filter(F.col("_before").isNull() | (F.col("_age") >= F.col("_before")))
        held = held.select(*schema.names)
        return held.union(self.spark.read.schema(schema).parquet(*ages[last])) if last in ages else held

    def _removed(self, buckets: Iterable[str], schema: T.StructType) -> DataFrame | None:
        """Removed keys, each with the number of first row folders it is gone from; None if there are none."""
        paths: dict[int, list[str]] = {}
        for b in buckets:
            for n, folder in self.state["removed"].get(b, []):
                paths.setdefault(n, []).append(f"{self.files.root}/{folder}")
        if not paths:
            return None
        keys = T.StructType([schema[name] for name in self.key])
        found = [self.spark.read.schema(keys).parquet(*p).withColumn("_before", F.lit(n)) for n, p in paths.items()]
        return reduce(DataFrame.union, found).groupBy(*self.key).agg(F.max("_before").alias("_before"))

    def write(self, rows: DataFrame, purpose: str) -> list[tuple[int, str]]:
        """Write rows into new folders, one per bucket, that no manifest names yet. Spark sizes the files."""
        name = f"data/{purpose}-{uuid.uuid4().hex}"
        (rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
         .write.partitionBy(BUCKET).parquet(f"{self.files.root}/{name}"))
        found = [n for n in self.files.names(name) if n.startswith(f"{BUCKET}=")]
        return [(int(n.partition("=")[2]), f"{name}/{n}") for n in found]

    def commit(self, added: Iterable[tuple[int, str]], replaced: Iterable[int] = (), schema: T.StructType | None = None,
               removed: Iterable[tuple[int, str]] = (), **done: object) -> None:
        """Name the new folders in one step; in ``replaced`` buckets they take the place of all others.

        The keys in the folders ``removed`` are gone from the rows their buckets had before.
        """
        folders = {b: list(f) for b, f in self.state["folders"].items()}
        gone = {b: list(f) for b, f in self.state["removed"].items()}
        old = [f for b in replaced for f in folders.pop(str(b), []) + [f for _, f in gone.pop(str(b), [])]]
        for b, folder in removed:
            gone.setdefault(str(b), []).append([len(folders[str(b)]), folder])
        for b, folder in added:
            folders.setdefault(str(b), []).append(folder)
        state = {"version": self.state["version"] + 1, "buckets": self.buckets, "folders": folders, "removed": gone, "old": old,
                 "schema": json.loads(schema.json()) if schema is not None else self.state["schema"], "done": {**self.state["done"], **done}}
        if not self.files.publish(f"_manifest/{state['version']:012d}.json", json.dumps(state)):
            raise RuntimeError("another writer has changed the table")
        self.files.delete(self.state["old"])  # replaced by the commit before this one
        self.files.delete([f"_manifest/{state['version'] - 2:012d}.json"])
        self.state = state

    def crowded(self, buckets: Iterable[int]) -> list[int]:
        """Those of these buckets that have gathered too many folders."""
        held = lambda b: len(self.state["folders"].get(str(b), [])) + len(self.state["removed"].get(str(b), []))
        return [b for b in buckets if held(b) >= MOST_FOLDERS]

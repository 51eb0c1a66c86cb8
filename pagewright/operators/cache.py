"""Results kept by content key: looked up by joins, added to by parts.

A cache is a folder, on any file system that Spark writes to, of parts in Parquet and a file that lists the current
ones; readers of a list are not disturbed by the next. A missing or unreadable cache is an empty one.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def misses(inputs: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """Inputs whose key is not cached."""
    return inputs.join(cached.select(key).distinct(), key, "left_anti")


def hits(inputs: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """Inputs with what is cached for their keys."""
    return inputs.join(cached.dropDuplicates([key]), key)


class Cache:
    """Pages by key, in Parquet under a folder; nothing is kept where there is no folder."""

    LIST, MOST_PARTS = "current.json", 64

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path(self.LIST).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        """Folders of the current parts."""
        if self.folder is None:
            return []
        try:
            stream = self._files().open(self._path(self.LIST))
            try:
                names = json.loads(bytes(stream.readAllBytes()))["parts"]
            finally:
                stream.close()
            return [f"{self.folder}/{n}" for n in names if self._files().exists(self._path(n))]
        except (Py4JError, ValueError, KeyError, TypeError):
            return []

    def load(self, schema) -> DataFrame:
        parts = self.parts()
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def merge(self, fresh: DataFrame, key: str = "key") -> None:
        """Add rows, in place of those with the same keys, as a part of their own. All parts are rewritten only where
        keys are replaced or parts have become many. Written in full before it becomes current."""
        if self.folder is None:
            return
        parts, old = self.parts(), self.load(fresh.schema)
        new = fresh.select(key).distinct()
        if parts and (len(parts) >= self.MOST_PARTS or not old.select(key).join(new, key, "left_semi").isEmpty()):
            fresh, parts = old.join(new, key, "left_anti").select(fresh.columns).unionByName(fresh), []
        name = f"part-{uuid.uuid4().hex}"
        fresh.write.parquet(f"{self.folder}/{name}")
        self._list([p.rpartition("/")[2] for p in parts] + [name])

    def _list(self, names: list[str]) -> None:
        """Make these parts current, in one step."""
        jvm, staged = self.spark._jvm, self._path(f".current-{uuid.uuid4().hex}")
        out = self._files().create(staged)
        out.write(json.dumps({"parts": names}).encode())
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        target = self._files().makeQualified(self._path(self.LIST))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._files().makeQualified(staged), target, over)

    def count(self) -> int:
        parts = self.parts()
        return self.spark.read.parquet(*parts).agg(F.count("*")).first()[0] if parts else 0

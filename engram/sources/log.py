"""A table of keyed rows as a log of Parquet folders, without a table format.

Each change appends a folder ``delta-<version>`` with the rows that are new or gone; now and then all is written anew as
``base-<version>``. A folder counts once its marker of success is there, which Spark writes last, so readers
see a change whole or not at all. Two writers of the same version can't both succeed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.operators.retention import latest
from engram.schema import StorageError

_NAME = re.compile(r"(base|delta)-(\d{12})$")


class Log:
    """``schema``: of the rows, with ``key``. Rows carry ``_v``, the version that wrote them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", compact_after: int = 32):
        self.spark, self.path, self.schema, self.key, self.compact_after = spark, path.rstrip("/"), schema, key, compact_after
        self.full = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField("_v", T.LongType()), T.StructField("_gone", T.BooleanType())])

    def _fs(self):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def folders(self) -> list[tuple[int, str]]:
        """(version, name) of the last base and the deltas after it, ascending."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        found = []
        for status in fs.listStatus(path(self.path)):
            m = _NAME.match(status.getPath().getName())
            if m and fs.exists(path(f"{self.path}/{m[0]}/_SUCCESS")):
                found.append((int(m[2]), m[0]))
        base = max((v for v, n in found if n.startswith("base")), default=-1)
        return sorted((v, n) for v, n in found if v > base or (v == base and n.startswith("base")))

    def version(self) -> int:
        own = self.folders()
        return own[-1][0] if own else 0

    def read(self) -> DataFrame:
        """The rows as they are now, with ``_v``."""
        own = self.folders()
        if not own:
            return self.spark.createDataFrame([], self.full).drop("_gone")
        rows = self.spark.read.schema(self.full).parquet(*[f"{self.path}/{n}" for _, n in own])
        if len(own) > 1:
            rows = latest(rows, self.key, "_v")
        return rows.where("not _gone").drop("_gone")

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        try:
            rows.write.mode("error").parquet(f"{self.path}/{kind}-{version:012d}")
        except Exception as e:
            if "PATH_ALREADY_EXISTS" not in str(e):  # what this write left behind would bar the version for the next one
                fs, path = self._fs()
                fs.delete(path(f"{self.path}/{kind}-{version:012d}"), True)
            raise StorageError(f"version {version} of {self.path} can't be written: {e}") from e

    def append(self, rows: DataFrame, gone: bool = False) -> int:
        """Adds rows of unique keys, or takes their keys out. Returns the version."""
        version = self.version() + 1
        cols = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self._write(rows.select(*cols, F.lit(version).cast("bigint").alias("_v"), F.lit(gone).alias("_gone")), "delta", version)
        if len(self.folders()) > self.compact_after:
            self.replace(self.read())
        return version

    def replace(self, rows: DataFrame) -> None:
        """Writes ``rows`` (with ``_v``) as all there is, and removes what isn't read any more but for the last base."""
        before = self.folders()
        version = self.version() + 1
        self._write(rows.withColumn("_gone", F.lit(False)), "base", version)
        fs, path = self._fs()
        keep = {n for _, n in before} | {f"base-{version:012d}"}
        for status in fs.listStatus(path(self.path)):
            if _NAME.match(status.getPath().getName()) and status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)

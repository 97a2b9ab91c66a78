"""A table that several writers append to at once, each id once: data folders, and numbered commits that say which of them count.

A writer puts its rows into a folder of their own, then creates the commit of the next number, which the file system grants to one writer alone. Whoever
comes second leaves out what the other has committed meanwhile, and tries the number after. Rows lie in buckets by a hash of their id, so an
append reads the buckets of its own ids only. What was written but not committed is never read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from attestra.session import materialize

BUCKETS = 64


class AppendLog:
    """path: a folder in a file system whose exclusive creation of a file is atomic, as HDFS and stores with conditional puts have it."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        """schema: of the rows, as DDL; key: the column of it that is an id. buckets: fixed for the life of the log."""
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commits(self, after: int = -1) -> list[tuple[int, str]]:
        """(number, data folder) of the commits after a number, in their order. A commit that is not written in full yet counts as soon as it is."""
        out, number = [], after + 1
        while True:
            system, path = self._path(f"log/{number:020d}")
            if not system.exists(path):
                return out
            stream = system.open(path)
            try:
                folder = bytes(stream.readNBytes(32)).decode()
            finally:
                stream.close()
            if len(folder) == 32:
                out.append((number, folder))
                number += 1
            else:
                time.sleep(0.01)

    def read(self, commits: list[tuple[int, str]] | None = None) -> DataFrame:
        """All committed rows, or those of some commits."""
        commits = self.commits() if commits is None else commits
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        return self._with_buckets(commits).drop("_bucket")

    def _with_buckets(self, commits: list[tuple[int, str]]) -> DataFrame:
        stored, parts = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())]), None
        for _, folder in commits:
            one = self.spark.read.schema(stored).parquet(f"{self.path}/data/{folder}")
            parts = one if parts is None else parts.unionByName(one)
        return parts

    def _commit(self, number: int, folder: str) -> bool:
        """Whether this writer got the number."""
        system, path = self._path(f"log/{number:020d}")
        try:
            stream = system.create(path, False)
        except Exception:
            if system.exists(path):
                return False
            raise
        try:
            stream.write(folder.encode())
        finally:
            stream.close()
        return True

    def append(self, rows: DataFrame, tries: int = 100) -> int:
        """Add the rows whose ids the log does not have, of rows of one id an arbitrary one, and say how many. Null ids are left out."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        new, seen = materialize(new.withColumn("_bucket", bucket), "incoming"), -1
        for _ in range(tries):
            commits = self.commits(seen)
            if commits:
                own = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # as many as there are buckets at most
                old = self._with_buckets(commits).filter(F.col("_bucket").isin(own)).select(self.key, "_bucket")
                new, seen = materialize(new.join(old, [self.key, "_bucket"], "left_anti").select(*self.schema.names, "_bucket"), "incoming"), commits[-1][0]
            n = new.count()
            if not n:
                return 0
            folder = uuid.uuid4().hex
            new.write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
            if self._commit(seen + 1, folder):
                return n
            system, path = self._path(f"data/{folder}")
            system.delete(path, True)
        raise RuntimeError(f"{tries} other writers were faster")

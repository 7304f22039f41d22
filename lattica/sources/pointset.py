"""A stored point set with one writer: changed buckets are written anew beside the old ones, and one small manifest says which count."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class PointSet:
    """Points by a key column, in buckets of its hash.

    A version is a manifest: for each bucket the folder that holds it, and the
    batch that made the version. Only buckets that a batch touches are written;
    then the manifest is, and readers, who take the newest whole one, see all
    of the batch or nothing. A batch that was applied before changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Versions whose manifest is whole."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [f.getPath() for f in fs.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, version: int | None = None) -> tuple[int, int, dict[int, str]]:
        """(version, batch, folders): at most one row for each bucket."""
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.parquet(f"{self.path}/manifest/v={version}").collect()
        return version, max(r.batch for r in rows), {r.bucket: r.folder for r in rows if r.folder}

    def _commit(self, version: int, batch: int, folders: dict[int, str]) -> None:
        rows = [(k, f, batch) for k, f in sorted(folders.items())] or [(-1, "", batch)]
        self.spark.createDataFrame(rows, "bucket int, folder string, batch long").coalesce(1).write.parquet(f"{self.path}/manifest/v={version}")

    def _write(self, points: DataFrame) -> str:
        """The points of some buckets in a new folder of theirs."""
        name = uuid.uuid4().hex
        points.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return name

    def create(self, points: DataFrame) -> None:
        self.spark.createDataFrame([], points.schema).write.parquet(f"{self.path}/schema")
        name = self._write(points)
        self._commit(0, -1, dict.fromkeys(range(self.buckets), name))

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """All points, or those of some buckets."""
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        _, _, folders = self.manifest(version)
        jvm = self.spark._jvm
        paths = [f"{self.path}/data/{f}/_bucket={k}" for k, f in folders.items() if only is None or k in only]
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [p for p in paths if fs.exists(jvm.org.apache.hadoop.fs.Path(p))]  # a bucket may be empty
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, batch: int, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Points after ``change``, which may only concern the keys of ``touched``; False if the batch was applied before."""
        version, last, folders = self.manifest()
        if batch <= last:
            return False
        some = [r[0] for r in touched.select(self.bucket()).distinct().collect()]  # at most one for each bucket
        if some:
            name = self._write(change(self.read(version, some)))
            folders |= dict.fromkeys(some, name)
        self._commit(version + 1, batch, folders)
        return True

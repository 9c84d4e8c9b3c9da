"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. Shards of similar size (a tier of the logarithm of
their size) are merged into files of the target size once there are enough of them. Every change is
a new manifest version, a table of the live shards, that one rename makes visible; a reader sees
one version, and a failed or lost job leaves files that no version names. A run is marked while it
writes, so that a vacuum spares files that are about to be committed. DataFrame operations only; the
driver handles file names, never rows, and of a merge no more than ``merge_files`` at once.

Rows are stored as they are: nulls and repeated rows stay, an empty arrival adds no shard, and columns
that the store's schema lacks are dropped.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "path string, bytes long, n_rows long"


@dataclass(frozen=True)
class ShardConfig:
    """Files under ``small_bytes`` are tier 0, each next tier is ``fan_in`` times as large; ``fan_in`` to ``merge_files`` shards of a tier are merged at once. A mark older than ``stale_seconds`` is of a lost run."""

    target_bytes: int = 128 * 1024 * 1024
    small_bytes: int = 64 * 1024
    fan_in: int = 4
    merge_files: int = 10_000
    stale_seconds: float = 7 * 86_400


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A table of immutable Parquet shards under ``path``, with versioned manifests."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, config: ShardConfig = ShardConfig()):
        self.spark, self.path, self.schema, self.config = spark, path.rstrip("/"), schema, config
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """``path, bytes, n_rows`` of the live shards of a version."""
        version = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{version}") if version else self.spark.createDataFrame([], MANIFEST)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; no rows before the first commit or from empty arrivals."""
        paths = [r["path"] for r in self.manifest(version).select("path").orderBy("path").collect()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _commit(self, shards: DataFrame, version: int) -> int:
        """Make ``shards`` version ``version``: written aside, then renamed; the rename fails where the version exists."""
        aside = f"{self.path}/pending/{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(aside)
        target = self._path(f"{self.path}/manifests/{version}")
        self._fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        if self._fs.exists(target):
            raise CommitConflict(f"version {version} exists")
        self._files.rename(self._path(aside), target, options)
        return version

    def _shards(self, run: str) -> DataFrame:
        """Manifest rows of the files of a run; files without rows are left out."""
        files = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/data/{run}")
        return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("n_rows")).select("path", "bytes", "n_rows")

    @contextmanager
    def _run(self, kind: str) -> Iterator[str]:
        """The name of a new run, marked until it is committed or has failed."""
        run = f"{kind}-{uuid.uuid4().hex}"
        mark = self._path(f"{self.path}/running/{run}")
        self._fs.mkdirs(mark)
        try:
            yield run
        finally:
            self._fs.delete(mark, True)

    def append(self, rows: DataFrame) -> int:
        """Write ``rows`` as new shards and commit them on the version that is then the latest."""
        with self._run("append") as run:
            rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.path}/data/{run}")
            version = self.version()
            return self._commit(self.manifest(version).unionByName(self._shards(run)), version + 1)

    def _tiers(self, shards: DataFrame) -> DataFrame:
        tier = F.floor(F.log(F.greatest(F.col("bytes") / self.config.small_bytes, F.lit(1.0))) / math.log(self.config.fan_in)).cast("int")
        return shards.withColumn("tier", F.when(F.col("bytes") < 0.75 * self.config.target_bytes, tier))

    def compact(self) -> int | None:
        """Merge the smallest tier that has ``fan_in`` shards, the smallest of them first, and commit the result; None where no tier has."""
        version = self.version()
        live = self._tiers(self.manifest(version))
        ready = live.where(F.col("tier").isNotNull()).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.config.fan_in).orderBy("tier").first()
        if ready is None:
            return None
        chosen = live.where(F.col("tier") == ready["tier"]).orderBy("bytes", "path").limit(self.config.merge_files).select("path", "bytes").collect()
        with self._run("merge") as run:
            files = max(1, -(-sum(r["bytes"] for r in chosen) // self.config.target_bytes))
            self.spark.read.schema(self.schema).parquet(*[r["path"] for r in chosen]).coalesce(files).write.parquet(f"{self.path}/data/{run}")
            gone = self.spark.createDataFrame([(r["path"],) for r in chosen], "path string")
            return self._commit(live.drop("tier").join(gone, "path", "left_anti").unionByName(self._shards(run)), version + 1)

    def compact_fully(self) -> int:
        """Compact until no tier has enough shards; each step has fewer shards than the one before."""
        while self.compact() is not None:
            pass
        return self.version()

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data files that none of the last versions names, but for runs that are marked; returns how many.

        Files are listed first, then marks, then versions: a listed file's run is still marked, or it
        has been committed and a version names it.
        """
        listed, dropped = [], 0
        files = self._fs.listFiles(self._path(f"{self.path}/data"), True)
        while files.hasNext():
            listed.append(files.next().getPath())
        marks = self._path(f"{self.path}/running")
        fresh = (time.time() - self.config.stale_seconds) * 1000
        running = {s.getPath().getName() for s in self._fs.listStatus(marks) if s.getModificationTime() > fresh} if self._fs.exists(marks) else set()
        latest = self.version()
        kept = {r["path"].rsplit("/data/", 1)[1] for v in range(max(1, latest - keep_versions + 1), latest + 1) for r in self.manifest(v).select("path").collect()}
        for path in listed:
            name = path.toString().rsplit("/data/", 1)[1]
            if name.endswith(".parquet") and name not in kept and name.split("/", 1)[0] not in running:
                dropped += bool(self._fs.delete(path, False))
        return dropped

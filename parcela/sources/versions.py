"""Tables with atomic versions: hashed into buckets by key, merged by rewriting only the buckets that change.

A version is a small table that names the files of every bucket. A merge reads the buckets that the
incoming keys fall into, writes their new files aside, and makes the next version visible by one
rename; untouched buckets keep their files. A writer that finds the version taken starts over on the
newer one, so two writers of one key meet. A job that is lost leaves files that no version names.

The rename has to fail where the target exists, as on HDFS and local file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lifecycle import insert_if_absent

FILES = "bucket int, path string, mark long"


class VersionTaken(RuntimeError):
    """Other writers were always faster."""


class VersionedTable:
    """A table of rows with unique keys under ``path``. ``buckets`` should be so many that one fits a task well; it stays as it was first."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The latest version; 0 before the first."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def files(self, version: int | None = None) -> DataFrame:
        """``bucket, path, mark`` of a version's files; a bucket without a path has no rows."""
        version = self.version() if version is None else version
        return self.spark.read.schema(FILES).parquet(f"{self.path}/versions/{version}") if version else self.spark.createDataFrame([], FILES)

    def mark(self, version: int | None = None) -> int:
        """The number that the version's writer left, such as its batch; -1 for none."""
        found = self.files(version).agg(F.max("mark").alias("m")).first()["m"]
        return -1 if found is None else found

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, of all buckets or of some."""
        files = self.files(version).where(F.col("path").isNotNull())
        paths = [r["path"] for r in (files if buckets is None else files.where(F.col("bucket").isin(buckets))).orderBy("path").collect()]  # names only
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, touched: list[int]) -> DataFrame:
        """New files of the touched buckets; a bucket is one task."""
        run = f"{self.path}/data/{uuid.uuid4().hex}"
        cast = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        cast.withColumn("__bucket", self.bucket()).repartition(max(1, len(touched)), "__bucket").write.partitionBy("__bucket").parquet(run)
        kind = T.StructType([*self.schema, T.StructField("__bucket", T.IntegerType())])
        written = self.spark.read.schema(kind).parquet(run).select(F.col("__bucket").alias("bucket"), F.col("_metadata.file_path").alias("path")).distinct()
        empty = self.spark.createDataFrame([(b,) for b in touched], "bucket int").join(written, "bucket", "left_anti").withColumn("path", F.lit(None).cast("string"))
        return written.unionByName(empty)

    def _commit(self, files: DataFrame, version: int) -> bool:
        """Whether ``files`` became ``version``: written aside and renamed, which fails where the version exists."""
        aside, target = f"{self.path}/pending/{uuid.uuid4().hex}", self._path(f"{self.path}/versions/{version}")
        files.coalesce(1).write.parquet(aside)
        self._fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        if self._fs.exists(target):
            return False
        try:
            self._files.rename(self._path(aside), target, options)
        except Exception as e:  # py4j wraps the file system's own errors
            if "FileAlreadyExists" in str(e) or self._fs.exists(target):
                return False
            raise e if isinstance(e, PySparkException) else RuntimeError(f"{target.toString()}: {e}") from e
        return True

    def merge(self, incoming: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], mark: int = -1, also: Callable[[DataFrame, DataFrame], None] | None = None, tries: int = 10) -> int:
        """The version after ``apply(current, incoming)`` on the buckets of the incoming keys.

        ``apply`` returns those buckets' rows, with keys of those buckets only. ``also`` is called with
        the same before the version is made, and may be called again. With a ``mark``, a merge whose
        number the table already has is left out, so that a batch that is run again changes nothing.
        No incoming rows make no version.
        """
        touched = sorted(r["b"] for r in incoming.select(self.bucket().alias("b")).distinct().collect())  # at most the number of buckets
        for _ in range(tries):
            version = self.version()
            if not touched or (mark >= 0 and self.mark(version) >= mark):
                return version
            current = self.read(version, touched)
            if also is not None:
                also(current, incoming)
            fresh = self._write(apply(current, incoming), touched)
            kept = self.files(version).where(~F.col("bucket").isin(touched)).select("bucket", "path")
            if self._commit(kept.unionByName(fresh).withColumn("mark", F.lit(mark).cast("long")), version + 1):
                return version + 1
        raise VersionTaken(f"{self.path}: {tries} tries")

    def append_new(self, rows: DataFrame) -> int:
        """Add the rows whose keys the table does not have; keys that repeat go in once."""
        return self.merge(rows, lambda current, new: insert_if_absent(current, new.select(*current.columns), self.keys))

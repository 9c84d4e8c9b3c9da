"""Session helpers shared by every module: table scans and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


#: Spark's setting to remove an execution's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; Spark reads it, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="parcela-")


def shared_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and executors are threads of the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or f"file://{_local_root()}").rstrip("/")


def spread(rows: DataFrame, key: str, a_task: int = 2000, enough: int = 200) -> DataFrame:
    """The rows dealt by a hash of ``key``, about ``a_task`` a task, where a row makes far more work than its bytes tell.

    A reader cuts a file by its bytes, so a small table is few tasks whatever is made of its rows. From
    ``enough`` tasks on each takes up to four times as many rows, as starting one costs as much as some
    hundred rows. The count is read from the files' footers.
    """
    n = rows.count()
    tasks = max(min(-(-n // a_task), enough), -(-n // (4 * a_task)))
    return rows.repartition(tasks, key) if tasks > 1 else rows


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage, is read by every executor and survives the loss of any of them. The
    shuffle files of the write go as soon as it ends, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/parcela/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@lru_cache(maxsize=8)
def _ship(app_id: str) -> None:
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="parcela-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    SparkContext.getOrCreate().addPyFile(str(archive))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python tasks can import it."""
    _ship(spark.sparkContext.applicationId)

"""JSON-lines scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of JSON lines: blank lines are skipped, bad ones dropped."""
    parsed = lines.where(F.trim(column) != "").select(F.from_json(column, schema + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}).alias("__r"))
    return parsed.where(F.col("__r").isNotNull() & F.col("__r._corrupt").isNull()).select("__r.*").drop("_corrupt")


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON-lines files, with the rules of ``parse_lines``."""
    return parse_lines(spark.read.text(path), schema)


def append_new(rows: DataFrame, path: str, key: str, schema: T.StructType) -> DataFrame:
    """Append the rows whose ids the files at ``path`` do not have; returns what was written."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    fresh = rows.dropDuplicates([key])
    if there:
        fresh = fresh.join(spark.read.schema(schema).json(path).select(key), key, "left_anti")
    fresh.write.mode("append").json(path)
    return fresh

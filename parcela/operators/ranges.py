"""Ordered work on keys of any size: rows in ranges of (key, order) of even size, and small summaries of ranges.

A window over a key is one task for all of its rows. Here rows are dealt by ranges first, so a key with
many rows lies in several; windows run inside a range, and what a range hands on to the next is folded
over one summary a key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: The column of a row's range; ranges of a key are in its order.
RANGE = "__range"


def by_ranges(rows: DataFrame, key: str, order: list[str], label: str, ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range in ``__range``, as a written table, so that the numbers stay what they are.

    Rows of equal key and order share a range; nulls come first. ``ranges``: how many; by default as many as shuffle partitions.
    """
    dealt = rows.repartitionByRange(ranges, key, *order) if ranges else rows.repartitionByRange(key, *order)
    return materialize(dealt.withColumn(RANGE, F.spark_partition_id()), label)


def with_summary(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of the one summary of their key and range; a null key is a key."""
    theirs = summary.select(F.col(key).alias("__key"), F.col(RANGE).alias("__of"), *[c for c in summary.columns if c not in (key, RANGE)])
    return rows.join(theirs, rows[key].eqNullSafe(F.col("__key")) & (rows[RANGE] == F.col("__of")), "left").drop("__key", "__of")


def spread_join(rows: DataFrame, small: DataFrame, key: str, by: Column, salts: int = 32) -> DataFrame:
    """Left join with one row a key, which is repeated for each of ``salts`` parts that ``by`` deals a key's rows into."""
    theirs = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed(key, "__key").withColumnRenamed("__salt", "__of")
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(theirs, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__of")), "left").drop("__key", "__of", "__salt")

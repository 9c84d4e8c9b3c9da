"""Small expression helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

#: The contract's white space and its word pattern, as Java and RE2 read them.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once: a one-element array binds it to a lambda variable.

    A column that a lambda captures is inlined into it by the optimizer and then evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The maximal runs of anything but ASCII white space; no words for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hash_place(column: str) -> Column:
    """A fixed place of a value between 0 and 1, spread evenly: rows under a share make a sample of that share."""
    return F.shiftrightunsigned(F.xxhash64(column), 1) / F.lit(2.0**63)


def named(column: str) -> Column:
    """A column by its whole name, which may hold dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def id_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def arrow_map(df: DataFrame, columns: list[str], body: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | pa.Table]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over the named columns only, so nothing else leaves the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in body(batch):
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    ship_package(df.sparkSession)
    # columns are named by place: mapInArrow does not take names with dots
    return df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)


def text_slices(texts: list[str | None], most_chars: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``most_chars`` characters each; a longer text is a range of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and held + size > most_chars:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)

"""Packing by power-of-two decomposition.

Every document's ids, closed by one id, are cut into pieces whose lengths are powers of two: as
many pieces of the longest length as fit, then one for each set bit of the rest. A piece is a
sequence of its own, so none crosses documents and none is padded; equal lengths go to one bucket
(Pouransari et al. 2024, "Dataset Decomposition"). The work is one pass without a shuffle: a
document is cut where it is read, whatever its source or length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import arrow_map, id_type

END_ID = 0


def binary_lengths(n: int, longest: int) -> Iterator[int]:
    """Powers of two that add up to ``n``, the largest first, none over ``longest`` (itself a power of two)."""
    yield from [longest] * (n // longest)
    rest = n % longest
    while rest:
        yield (piece := 1 << (rest.bit_length() - 1))
        rest -= piece


def pack_documents(docs: DataFrame, seq_len: int = 1024, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids (binary, little-endian uint32), ids_crc32, doc_tokens, bucket, sequence_id, offset``.

    ``bucket`` is log2 of the length. A null or empty text is one piece that holds only the end
    id. Null and repeated ``doc_id`` values are kept: each row is cut by itself, and
    ``sequence_id`` (partition and place) is unique for every piece. An empty table gives no rows.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    path = tokenizer_path or bpe.default_path()
    schema = T.StructType([
        T.StructField(id_col, id_type(docs, id_col)), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("bucket", T.IntegerType()),
    ])
    end = np.uint32(END_ID).astype("<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        keys = batch.column(0)
        rows: list[int] = []
        starts: list[int] = []
        lengths: list[int] = []
        totals: list[int] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            size = np.array(lengths, dtype=np.int64)
            out = pa.RecordBatch.from_arrays([
                keys.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(size), pa.array(parts, pa.binary()),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(totals, pa.int64()), pa.array(np.log2(np.maximum(size, 1)).astype(np.int32)),
            ], names=[id_col, "start", "length", "ids", "ids_crc32", "doc_tokens", "bucket"])
            for held in (rows, starts, lengths, totals, parts):
                held.clear()
            return out

        held = 0
        for i, text in enumerate(batch.column(1)):
            ids = encoder.ids(text.as_py() or "") + end
            total, at = len(ids) // 4, 0
            for length in binary_lengths(total, seq_len):
                rows.append(i)
                starts.append(at)
                lengths.append(length)
                totals.append(total)
                parts.append(ids[4 * at : 4 * (at + length)])
                at += length
            held += len(ids)
            if held > 16_000_000:
                yield flush()
                held = 0
        yield flush()

    pieces = arrow_map(docs, [id_col, text_col], cut, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, for loaders that draw batches of one length."""
    pieces.write.mode("overwrite").partitionBy("length").parquet(path)

"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds of ``seed_words`` consecutive words; an item
of fewer words is its own seed. For every pair that shares a seed, running Karp-Rabin matching marks the longest non-overlapping
matches on both sides, longest first, so a passage is found in whatever order its parts stand. A
document is contaminated by an item when the tiles cover enough of the item (Wise 1993).

The benchmark is cut into blocks of bounded size; each block is broadcast to one pass over the
documents. Documents are never shuffled, so a hot source, copies and long texts cost their own size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, id_type

_WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class TilingConfig:
    """``coverage`` is the share of an item's words that tiles must cover; ``block_chars`` bounds what is broadcast at once."""

    seed_words: int = 5
    coverage: float = 0.5
    block_chars: int = 16_000_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64, mixed) of all runs of ``k`` ids."""
    h = np.zeros(max(0, len(ids) - k + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k if len(h) else 0):
            h = (h ^ (h >> np.uint64(29))) * _MULT + ids[i : i + len(h)].astype(np.uint64) + np.uint64(1)
    return h


class Block:
    """Benchmark items as word numbers, with an index of their seeds; both are built in the worker, once."""

    def __init__(self, keys: pa.Array, texts: list[str], config: TilingConfig):
        self.keys, self.texts, self.config = keys, texts, config

    @cached_property
    def _index(self) -> tuple[dict[str, int], list[np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]]:
        """Word numbers, the items, and for each length of a seed the sorted seeds and their items."""
        number: dict[str, int] = {}
        items = [np.array([number.setdefault(w, len(number)) for w in words(text)], dtype=np.int64) for text in self.texts]
        full = self.config.seed_words
        sizes = sorted({min(len(x), full) for x in items} - {0})
        seeds = []
        for k in sizes:
            hashes = [_windows(x, k) if min(len(x), full) == k else np.zeros(0, dtype=np.uint64) for x in items]
            owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
            flat = np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)])
            order = np.argsort(flat, kind="stable")
            seeds.append((k, flat[order], owner[order]))
        return number, items, seeds

    def item_words(self, item: int) -> int:
        return len(self._index[1][item])

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, covered words, tiles) of each item that shares a seed with the text."""
        number, items, seeds = self._index
        ids = np.array([number.get(w, -1) for w in words(text)], dtype=np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        found: list[tuple[int, int, int]] = []
        for k, hashes, owners in seeds:
            at = np.flatnonzero(known[k:] - known[:-k] == k)  # runs of words that all occur in the benchmark
            h = _windows(ids, k)[at] if len(at) else np.zeros(0, dtype=np.uint64)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(high > low)
            places: dict[int, list[int]] = {}
            for p, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                for item in set(owners[a:b].tolist()):
                    places.setdefault(item, []).append(p)
            found += [(item, *tile(self._around(ids, where, k), items[item], k)) for item, where in places.items()]
        return sorted(found)

    @staticmethod
    def _around(ids: np.ndarray, where: list[int], size: int) -> np.ndarray:
        """The words inside the seeds, separate runs kept apart by -1: no match reaches outside them."""
        held = np.zeros(len(ids) + 1, dtype=bool)
        starts = np.array(where)
        for i in range(size):
            held[starts + i] = True
        kept = np.flatnonzero(held)
        gap = np.flatnonzero(np.diff(kept) > 1) + 1
        return np.insert(ids[kept], gap, -1)


def tile(text: np.ndarray, item: np.ndarray, shortest: int) -> tuple[int, int]:
    """Running Karp-Rabin greedy string tiling: (words of the item that are covered, tiles).

    Matches of at least the current length are looked up by rolling hashes of unmarked words,
    verified and extended; a match over twice as long restarts the search at its length. The
    longest are marked first (ties: first in the item, then in the text), and what an earlier tile
    leaves of a match goes back into the queue. Then the length is halved down to ``shortest``.
    """
    free_text, free_item = text >= 0, np.ones(len(item), dtype=bool)
    length, covered, tiles = max(shortest, len(item) // 2), 0, 0
    while True:
        longest, found = _scan(text, item, free_text, free_item, length)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-size, b, a) for size, a, b in found]
        heapq.heapify(queue)
        while queue:
            size, b, a = heapq.heappop(queue)
            free = free_text[a : a - size] & free_item[b : b - size]
            if free.all():
                free_text[a : a - size] = False
                free_item[b : b - size] = False
                covered -= size
                tiles += 1
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if j - i >= length:  # shorter rests are found again when their length is due
                    heapq.heappush(queue, (i - j, b + i, a + i))
        if length == shortest:
            return covered, tiles
        length = max(shortest, length // 2)


def _scan(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, length: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The longest match and all maximal matches of at least ``length`` unmarked words: (size, place in text, place in item)."""

    def open_windows(ids: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) < length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        run = np.concatenate([[0], np.cumsum(free)])
        at = np.flatnonzero(run[length:] - run[:-length] == length)
        return at, _windows(ids, length)[at]

    at, h = open_windows(text, free_text)
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    places, wanted = open_windows(item, free_item)
    low, high = np.searchsorted(h, wanted, "left"), np.searchsorted(h, wanted, "right")
    room_text, room_item = _open_ahead(free_text), _open_ahead(free_item)
    longest, found = 0, []
    for k in np.flatnonzero(high > low):
        q, p = int(places[k]), at[low[k] : high[k]]
        if q and free_item[q - 1]:  # the others are parts of longer matches that began earlier
            p = p[(p == 0) | ~free_text[p - 1] | (text[p - 1] != item[q - 1])]
        for start in p.tolist():
            room = int(min(room_text[start], room_item[q]))
            differs = text[start : start + room] != item[q : q + room]
            size = int(differs.argmax()) if differs.any() else room
            if size >= length:
                longest = max(longest, size)
                found.append((size, start, q))
    return longest, found


def _open_ahead(free: np.ndarray) -> np.ndarray:
    """The number of unmarked words in a row from each place on."""
    stops = np.append(np.flatnonzero(~free), len(free))
    places = np.arange(len(free))
    return stops[np.searchsorted(stops, places)] - places


def benchmark_blocks(benchmark: DataFrame, config: TilingConfig, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """Broadcast blocks of the benchmark, each of about ``block_chars`` characters: as many as its measured size needs."""
    usable = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    chars = usable.agg(F.coalesce(F.sum(F.length("__text")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-chars // config.block_chars)
    for k in range(blocks):
        part = usable.where(F.pmod(F.xxhash64("__id", "__text"), F.lit(blocks)) == k) if blocks > 1 else usable
        rows = part.orderBy("__id", "__text").toArrow().combine_chunks()
        yield benchmark.sparkSession.sparkContext.broadcast(Block(rows.column(0).combine_chunks(), rows.column(1).to_pylist(), config))


def _verdicts(text: str | None, block: Block) -> list[tuple[int, int, int]]:
    """The items that the text contaminates, with covered words and tiles."""
    return [x for x in block.find(text) if x[1] >= block.config.coverage * block.item_words(x[0])]


def find_contaminated(docs: DataFrame, benchmark: DataFrame, config: TilingConfig = TilingConfig(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, item_words, covered_words, n_tiles, coverage`` of every contaminated pair.

    Null texts and texts without words match nothing; an item of fewer words than a seed matches where
    all of them stand together. Every row of
    ``docs`` and every item row is judged by itself, so repeated rows give repeated pairs and null
    ids appear as null. Empty tables give no rows; other columns are ignored.
    """
    schema = T.StructType([
        T.StructField(id_col, id_type(docs, id_col)), T.StructField(item_col, id_type(benchmark, item_col)), T.StructField("item_words", T.LongType()),
        T.StructField("covered_words", T.LongType()), T.StructField("n_tiles", T.LongType()), T.StructField("coverage", T.DoubleType()),
    ])
    out = docs.sparkSession.createDataFrame([], schema)
    for held in benchmark_blocks(benchmark, config, item_col, item_text_col):

        def body(batch: pa.RecordBatch, held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            block = held.value
            rows = [(i, *v) for i, t in enumerate(batch.column(1)) for v in _verdicts(t.as_py(), block)]
            size = [block.item_words(r[1]) for r in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), block.keys.take(pa.array([r[1] for r in rows], pa.int64())),
                pa.array(size, pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                pa.array([round(r[2] / n, 6) for r, n in zip(rows, size, strict=True)], pa.float64()),
            ], names=schema.names)

        out = out.unionByName(arrow_map(docs, [id_col, text_col], body, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, config: TilingConfig = TilingConfig(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that no item contaminates; the rules of ``find_contaminated``."""
    at = docs.columns.index(text_col)
    for held in benchmark_blocks(benchmark, config, item_col, item_text_col):

        def body(batch: pa.RecordBatch, held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            block = held.value
            yield batch.filter(pa.array([not _verdicts(t.as_py(), block) for t in batch.column(at)], pa.bool_()))

        docs = arrow_map(docs, docs.columns, body, docs.schema)
    return docs

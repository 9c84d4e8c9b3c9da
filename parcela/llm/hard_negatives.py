"""Hard negatives of anchors, by exact integer scores from residue matrices.

A score is the inner product of two integer vectors, ``floor(scale * x)`` by component. It is found
without rounding in float32: both matrices are reduced modulo several small primes, so that every sum
of products stays below 2^23, multiplied once a prime, and the residues are put together by Chinese
remaindering in balanced mixed radix, whose digits give signed numbers at once. The primes are as
many as the product of the longest vectors asks for.

Anchors come in blocks of bounded size, each broadcast to two passes over all rows: the first finds
every anchor's positives (rows of its own label only), the second its negatives in the window that
each positive's score opens. A task keeps the best of each anchor and positive only, so what is
shuffled is a few rows an anchor and task, and each block's result is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize, ship_package

#: Components that one float32 product sums; longer vectors are summed in segments.
SEGMENT = 1024
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class MiningConfig:
    """``n_positives`` an anchor and ``n_negatives`` a positive at most. A negative's score lies between ``low_percent`` and ``high_percent`` of the positive's. ``block_components``: of the anchors that are broadcast at once; ``tile_scores``: scores that a task holds at once."""

    n_positives: int = 5
    n_negatives: int = 10
    low_percent: int = 30
    high_percent: int = 90
    scale: int = 256
    block_components: int = 1 << 20
    tile_scores: int = 1 << 20


def primes_for(dim: int, bound: float) -> list[int]:
    """Odd primes, largest first, with which float32 sums of ``dim`` products (a segment at most) are exact and that tell all numbers up to ``bound`` apart, or all of 64 bits."""
    most = 2 * int((2**23 / max(1, min(dim, SEGMENT))) ** 0.5) + 1  # so that a sum, and the multiple of a prime next to it, are exact
    found: list[int] = []
    product = 1
    p = min(most, 1021)
    while product <= min(2 * bound + 1, 2**64):
        while any(p % d == 0 for d in range(2, int(p**0.5) + 1)):
            p -= 1
        if p < 3:
            raise ValueError("no primes left")
        found.append(p)
        product *= p
        p -= 1
    return found


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p`` between -(p-1)/2 and (p-1)/2; the second step mends a quotient that float32 rounded."""
    for _ in range(2):
        x = x - np.float32(p) * np.rint(x * np.float32(1 / p))
    return x


def residues(numbers: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers of any size, held as doubles, modulo ``p`` as float32; ``fmod`` is exact."""
    return balanced(np.fmod(numbers, p).astype(np.float32), p)


class Residues:
    """A matrix of whole numbers (doubles) with its residues by prime, made when first asked for."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.length = float(np.sqrt((numbers * numbers).sum(axis=1)).max(initial=0.0)) * (1 + 1e-9)
        self._of: dict[int, np.ndarray] = {}

    def modulo(self, p: int) -> np.ndarray:
        if p not in self._of:
            self._of[p] = residues(self.numbers, p)
        return self._of[p]


def exact_scores(a: Residues, b: Residues, rows: slice = slice(None)) -> np.ndarray:
    """Inner products of ``a[rows]`` with all of ``b`` as int64; those beyond a long (by a double's sum) are its ends."""
    dim = a.numbers.shape[1]
    bound = a.length * b.length
    primes = primes_for(dim, bound if np.isfinite(bound) else 2.0**64)
    digits: list[np.ndarray] = []
    total, weight = None, 1
    for i, p in enumerate(primes):
        left, right = a.modulo(p)[rows], b.modulo(p)
        r = np.zeros((left.shape[0], right.shape[0]), dtype=np.float32)
        for s in range(0, dim, SEGMENT):
            r = balanced(r + balanced(left[:, s : s + SEGMENT] @ right[:, s : s + SEGMENT].T, p), p)
        for q, d in zip(primes[:i], digits, strict=True):  # the next digit: what is left, divided by the primes before
            r = balanced((r - d) * np.float32(pow(q, -1, p)), p)
        digits.append(r)
        term = r.astype(np.int64) * np.int64((weight + 2**63) % 2**64 - 2**63)  # sums and products modulo 2^64
        total = term if total is None else total + term
        weight *= p
    if not bound < 2.0**63:
        with np.errstate(over="ignore", invalid="ignore"):
            rough = a.numbers[rows] @ b.numbers.T
        total = np.where(rough >= 2.0**63, MOST, np.where(rough <= -(2.0**63), LEAST, total))
    return total


class Best:
    """The ``k`` best (score, id) of each group: higher scores first, ties by smaller id, equal pairs once."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.floor = np.full(groups, LEAST)  # scores below it are not among the best

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, ~s, g))  # ~s falls as s rises, and has no overflow
        g, s, i = g[order], s[order], i[order]
        new = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]))
        g, s, i = g[new], s[new], i[new]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        keep = place < self.k
        self.group, self.score, self.id = g[keep], s[keep], i[keep]
        last = place == self.k - 1
        self.floor[g[last]] = s[last]


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and matrix of the vectors of each length."""
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten())
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, flat[starts[rows, None] + np.arange(n)]


class _Anchors:
    """Anchors of one block by vector length: their places in the block, labels and matrix."""

    def __init__(self, labels: np.ndarray, vectors: pa.ListArray, scale: int):
        self.of = {n: (at, labels[at], np.floor(scale * m)) for n, at, m in _by_length(vectors)}


def _pass(rows: DataFrame, block, config: MiningConfig, positives) -> DataFrame:
    """Rows through one block of anchors. Without ``positives``: each task's best rows of the anchors' labels as
    (anchor, score, id); with them (low, high, by anchor and place): the best of other labels in each window."""
    k = config.n_negatives if positives else config.n_positives
    schema = "anchor int, place int, score long, id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        low, high = positives.value if positives else (None, None)
        count = sum(len(at) for at, _, _ in anchors.of.values())
        width = low.shape[1] if positives else 1
        best = Best(count * width, k)
        made: dict = {}  # residues of the anchors by vector length and label

        def offer(at: np.ndarray, labels: np.ndarray, ids: np.ndarray, own: np.ndarray, scores: np.ndarray) -> None:
            if not positives:
                i, a = np.nonzero(scores >= best.floor[at])
                other = ids[i] != anchor_ids[at[a]]
                best.add(at[a[other]], scores[i, a][other], ids[i[other]])
                return
            floor = np.maximum(low[at], best.floor.reshape(count, width)[at])
            i, a = np.nonzero((scores >= floor.min(axis=1)) & (scores <= high[at].max(axis=1)) & (labels[:, None] != own))
            s = scores[i, a]
            for j in range(width):
                fit = (s >= floor[a, j]) & (s <= high[at[a], j])
                best.add(at[a[fit]] * width + j, s[fit], ids[i[fit]])

        anchor_ids = anchors.ids
        for batch in batches:
            all_ids, all_labels = (np.asarray(batch.column(c)) for c in (0, 1))
            for n, rows_at, matrix in _by_length(batch.column(2)):
                if n not in anchors.of:
                    continue
                at, own, numbers = anchors.of[n]
                # positives: only the anchors of a row's label are multiplied
                for label in np.unique(all_labels[rows_at]) if not positives else [None]:
                    mine, theirs = (slice(None), slice(None)) if label is None else (all_labels[rows_at] == label, own == label)
                    if not len(at[theirs]):
                        continue
                    if (n, label) not in made:
                        made[n, label] = Residues(numbers[theirs])
                    ids, labels = all_ids[rows_at][mine], all_labels[rows_at][mine]
                    held = Residues(np.floor(config.scale * matrix[mine]))
                    step = max(1, config.tile_scores // len(at[theirs]))
                    for s in range(0, len(ids), step):
                        tile = slice(s, s + step)
                        offer(at[theirs], labels[tile], ids[tile], own[theirs], exact_scores(held, made[n, label], tile))
        columns = [pa.array((best.group // width).astype(np.int32)), pa.array((best.group % width).astype(np.int32)), pa.array(best.score), pa.array(best.id)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "place", "score", "id"])

    found = rows.mapInArrow(run, schema)
    first = F.dense_rank().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", first).where(F.col("rank") <= k).distinct()


def _blocks(anchors: DataFrame, config: MiningConfig) -> Iterator[pa.Table]:
    """The anchors in order, as many at once as ``block_components`` allow."""
    longest = anchors.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    if longest is None:
        return
    most = max(1, config.block_components // max(1, longest))
    key = F.struct("id", "label", "vector")
    left = anchors
    while True:
        block = left.orderBy("id", "label", "vector").limit(most).toArrow()
        if block.num_rows:
            yield block
        if block.num_rows < most:
            return
        last = block.slice(most - 1).to_pylist()[0]
        left = anchors.where(key > F.struct(F.lit(last["id"]).cast("long").alias("id"), F.lit(last["label"]).cast("long").alias("label"), F.lit(last["vector"]).cast("array<double>").alias("vector")))


def _windows(found: pa.Table, count: int, config: MiningConfig) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], tuple[int, int]]]:
    """Lowest and highest allowed negative score by anchor and place of the positive (none: empty window), and the positives."""
    low, high = np.full((count, config.n_positives), MOST), np.full((count, config.n_positives), LEAST)
    named = {}
    for r in found.to_pylist():
        a, j, score = r["anchor"], r["rank"] - 1, r["score"]
        named[a, j] = (r["id"], score)
        low[a, j] = max(LEAST, min(MOST, -(-config.low_percent * score // 100)))
        high[a, j] = max(LEAST, min(MOST, config.high_percent * score // 100))
    return low, high, named


def mine(rows: DataFrame, is_anchor: Column, config: MiningConfig = MiningConfig(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of each anchor, positive and negative.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Labels
    and ids are whole numbers. Vectors of different lengths have no score with each other. Ties go to
    the smaller id. Rows that repeat an id count once where their scores are the same; other rows of an
    anchor's own id are never its positives. An anchor without positives, or without rows in a window,
    gives no rows for it. Scores beyond a long count as its ends. Other columns are ignored, and an
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship_package(spark)
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    part = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), is_anchor.alias("anchor"))
    part = part.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    anchors = materialize(part.where("anchor").select("id", "label", "vector").distinct(), "anchors")
    part = part.select("id", "label", "vector")
    done = []
    for table in _blocks(anchors, config):
        vectors = table.column("vector").combine_chunks()
        held = _Anchors(np.asarray(table.column("label")), vectors, config.scale)
        held.ids = np.asarray(table.column("id"))
        block = spark.sparkContext.broadcast(held)
        low, high, named = _windows(_pass(part, block, config, None).select("anchor", "rank", "score", "id").toArrow(), len(held.ids), config)
        windows = spark.sparkContext.broadcast((low, high))
        negatives = _pass(part, block, config, windows)
        names = pa.table({
            "anchor": pa.array([a for a, _ in named], pa.int32()), "place": pa.array([j for _, j in named], pa.int32()), "anchor_id": pa.array([int(held.ids[a]) for a, _ in named], pa.int64()),
            "positive_id": pa.array([p for p, _ in named.values()], pa.int64()), "positive_score": pa.array([s for _, s in named.values()], pa.int64()),
        })
        out = negatives.join(F.broadcast(spark.createDataFrame(names)), ["anchor", "place"])
        done.append(materialize(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        block.destroy()
        windows.destroy()
    drop_materialized(anchors)
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, done)

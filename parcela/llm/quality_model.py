"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned at quantiles. Cyclic boosting fits one shallow tree a feature and round and adds
it to that feature's lookup table; then the same on the pairs of features that the residuals favour
(Lou et al. 2013, "Accurate intelligible models with pairwise interactions"). A score is the
logistic of the sum of table entries, looked up for a whole batch at once. The model is fitted on a
bounded sample of labelled rows; features and scores come from one pass over the texts without a
shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, hash_place, id_type, named

FEATURES = (
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "repeated_next", "lower", "upper", "digit", "space",
    "symbol", "exclaim", "pipe", "stop", "high_bytes", "lines", "distinct_lines", "line_length", "capital_words", "lone_symbols",
)


@dataclass(frozen=True)
class GamConfig:
    """``sample_rows`` bounds the labelled rows that are fitted: those whose ids have the smallest hashes."""

    sample_rows: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    pairs: int = 8
    rate: float = 0.15
    leaves: int = 3
    ridge: float = 5.0


@dataclass(frozen=True)
class Gam:
    """Bin edges and one lookup table a feature, then tables for pairs of coarser bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, k])]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k]) for pair in self.pairs for k in pair}
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def features(text: str) -> tuple[float, ...]:
    """The features of a whole text, from counts of its bytes, words and lines; all defined for an empty text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    c = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, dtype=np.int64)
    size = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    counted = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return (
        float(np.log1p(len(words))), float(lengths.mean()), float((lengths > 14).mean()), len(counted) / n, max(counted.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        c[97:123].sum() / size, c[65:91].sum() / size, c[48:58].sum() / size, (c[32] + c[9:14].sum()) / size,
        sum(c[ord(x)] for x in "#*$%&<>") / size, c[33] / size, c[124] / size, c[46] / size, c[128:].sum() / size,
        float(np.log1p(len(lines))), len(set(lines)) / max(1, len(lines)), float(np.log1p(len(text) / max(1, len(lines)))), sum(map(str.isupper, words)) / n, sum(len(w) == 1 and not w.isalnum() for w in words) / n,
    )


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree on one ordered feature: the best splits of summed gradients and weights, as a value a bin."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], int(m[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The best cut of each axis: four leaves on a grid of summed gradients and weights."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    rows, cols = g.shape
    i, j = np.meshgrid(np.arange(1, rows), np.arange(1, cols), indexing="ij")
    quarters = [(0, i, 0, j), (0, i, j, cols), (i, rows, 0, j), (i, rows, j, cols)]
    inside = lambda c, q: c[q[1], q[3]] - c[q[0], q[3]] - c[q[1], q[2]] + c[q[0], q[2]]
    gain = sum(inside(cg, q) ** 2 / (inside(ch, q) + ridge) for q in quarters)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    a, b = a + 1, b + 1
    out = np.empty_like(g)
    for r, c in ((slice(0, a), slice(0, b)), (slice(0, a), slice(b, cols)), (slice(a, rows), slice(0, b)), (slice(a, rows), slice(b, cols))):
        out[r, c] = g[r, c].sum() / (h[r, c].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, config: GamConfig = GamConfig()) -> Gam:
    """Cyclic boosting of the lookup tables; a constant model where a class is missing."""
    n, width = x.shape
    rate = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    intercept = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return Gam(intercept, [np.zeros(0)] * width, [np.zeros(1)] * width, [np.zeros(0)] * width, [], [])
    quantiles = lambda bins: [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) for k in range(width)]
    edges, coarse = quantiles(config.bins), quantiles(config.pair_bins)
    binned = [np.searchsorted(edges[k], x[:, k]) for k in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(config.rounds):
        for k in range(width):
            g, h = slopes()
            size = len(tables[k])
            step = config.rate * _tree(np.bincount(binned[k], g, size), np.bincount(binned[k], h, size), config.leaves, config.ridge)
            tables[k] += step
            total += step[binned[k]]
    rough = [np.searchsorted(coarse[k], x[:, k]) for k in range(width)]
    g, h = slopes()

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(rough[a] * shape[1] + rough[b], v, shape[0] * shape[1]).reshape(shape)

    able = [k for k in range(width) if len(coarse[k])]
    gains = {(a, b): float((grid(a, b, g) ** 2 / (grid(a, b, h) + config.ridge)).sum()) for a in able for b in able if a < b}
    pairs = sorted(sorted(gains, key=lambda p: (-gains[p], p))[: config.pairs])
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(config.pair_rounds):
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            step = config.rate * _pair_tree(grid(a, b, g), grid(a, b, h), config.ridge)
            pair_tables[k] += step
            total += step[rough[a], rough[b]]
    return Gam(intercept, edges, tables, coarse, pairs, pair_tables)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1: never learned from. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or "") for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, config: GamConfig = GamConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """Fit on at most ``sample_rows`` labelled documents that are not held out.

    Labels with a null id or value are ignored; an id with several labels takes the largest, and one
    with several texts counts once, with the smallest of their feature rows. The sample's ids (bounded)
    are broadcast to one scan of the texts, and only their features come back.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    # twice the share that fills the sample is sorted, so that the last task gets few rows
    share = min(1.0, 2.0 * config.sample_rows / max(1, usable.count()))
    drawn = usable.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).where(hash_place("__id") <= share)
    chosen = drawn.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(hash_place("__id"), "__id").limit(config.sample_rows)
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))  # own names: docs may have any others
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select(F.col("id").cast("string").alias("__id"), F.col("text").alias("__text"), "__y")

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["id", "x", "y"])

    rows = arrow_map(sample, ["__id", "__text", "__y"], body, "id string, x array<double>, y double").groupBy("id", "y").agg(F.min("x").alias("x")).orderBy("id").collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], dtype=float), config)


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; a higher score means label 1 is likelier.

    A null text counts as empty and is scored. Rows are scored one by one: null and repeated ids
    are kept; empty in, empty out; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), T.StructField("score", T.DoubleType())])

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(_matrix(batch.column(1))))], names=schema.names)

    scored = arrow_map(docs, [id_col, text_col], body, schema)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

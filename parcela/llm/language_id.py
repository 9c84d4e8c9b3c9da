"""Language identification by segmentation-marginalised unigrams.

A language gives every piece of a fixed public vocabulary a probability. A word's probability is
the sum over all its segmentations into pieces, which the forward algorithm adds up; a text's is
the product over its words, as no piece crosses words. Training is expectation-maximization on a
bounded sample of labelled documents: Spark counts the sample's words and runs the
forward-backward step on partitions of them, and only one number a language and piece comes back
to the driver. Scoring is one pass without a shuffle. A word is a run of letters of any length, so
pieces with anything but letters are in no segmentation and are left out of the tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_materialized, materialize
from .common import arrow_map, hash_place, id_type, named, text_slices

START = "▁"
#: The probability of a letter that no piece covers.
UNSEEN = 1e-9
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageConfig:
    """``docs_per_language`` bounds the training sample (documents of smallest hash). ``fit_gap``: how far under its language's mean a text's log probability a letter may lie; one of fewer than ``fit_letters`` letters may lie further, by the root of the letters that it lacks."""

    vocabulary: str = "piece_bpe_32k.model"
    docs_per_language: int = 1000
    rounds: int = 2
    smoothing: float = 0.05
    fit_gap: float = 1.8
    fit_letters: int = 150


@dataclass(frozen=True)
class LanguageModel:
    """Languages, a piece x language matrix of probabilities, and the mean log probability a letter of each language's own texts."""

    languages: list[str]
    probability: np.ndarray
    config: LanguageConfig
    mean: np.ndarray | None = None


class Vocabulary:
    """Pieces by a polynomial hash of their letters, so that a column of words is looked up at once."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        pieces = sorted(p for p in pieces if p and all(c.isalpha() or c == START for c in p))
        with np.errstate(over="ignore"):
            keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.pieces, self.longest = keys[order], order.astype(np.int32), pieces, max(map(len, pieces))
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")

    @staticmethod
    def _key(piece: str) -> np.uint64:
        h = np.uint64(0)
        for c in piece:
            h = h * _BASE + np.uint64(ord(c))
        return h

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """The piece ids of hashes, -1 where none."""
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return np.where(self.keys[at] == hashed, self.ids[at], -1)


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


_WORD = regex.compile(r"\p{L}+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def _by_length(distinct: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, letter codes with the start mark first) for each word length."""
    sizes = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            joined = "".join(START + distinct[i] for i in rows)
            yield rows, np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").reshape(len(rows), -1)


class _Lattice:
    """The pieces of words of one length: ``at(start, size)`` gives the rows that have a piece there, and its ids."""

    def __init__(self, codes: np.ndarray, vocab: Vocabulary):
        wide = np.ascontiguousarray(codes.T).astype(np.uint64)
        self.letters, self.rows = wide.shape
        self.all = np.arange(self.rows)
        self.ids, self.any = [], []
        h = np.zeros_like(wide)
        for size in range(1, min(vocab.longest, self.letters) + 1):
            with np.errstate(over="ignore"):
                h = h[: self.letters - size + 1] * _BASE + wide[size - 1 :]
            ids = vocab.find(h)
            self.ids.append(ids)
            self.any.append((ids >= 0).any(axis=1))

    def at(self, start: int, size: int) -> tuple[np.ndarray, np.ndarray] | None:
        ids = self.ids[size - 1][start]
        if size == 1:
            return self.all, ids  # a lone letter always has a probability, if only UNSEEN
        if not self.any[size - 1][start]:
            return None
        rows = np.flatnonzero(ids >= 0)
        return rows, ids[rows]

    def ending(self, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for size in range(1, min(len(self.ids), end) + 1):
            if (hit := self.at(end - size, size)) is not None:
                yield end - size, *hit


def _forward(found: _Lattice, p: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward sums (position, row, language) and the log of the scale of each position and row; positions wrap around after the longest piece unless ``keep``."""
    n = found.letters
    ring = n + 1 if keep else len(found.ids) + 1
    alpha = np.zeros((ring, found.rows, p.shape[1]))
    scale = np.zeros((ring, found.rows))
    alpha[0] = 1.0
    for j in range(1, n + 1):
        before = scale[(j - 1) % ring].copy()
        total = np.zeros(alpha.shape[1:])
        for i, rows, ids in found.ending(j):
            total[rows] += alpha[i % ring, rows] * np.exp(scale[i % ring, rows] - before[rows])[:, None] * p[ids]
        top = np.maximum(total.max(axis=1), 1e-300)
        alpha[j % ring] = total / top[:, None]
        scale[j % ring] = before + np.log(top)
    return (alpha, scale) if keep else (alpha[n % ring], scale[n % ring])


def word_scores(distinct: list[str], model: LanguageModel) -> np.ndarray:
    """Log probability (word x language), summed over all segmentations."""
    vocab = vocabulary(model.config.vocabulary)
    p = np.vstack([model.probability, np.full((1, len(model.languages)), UNSEEN)])  # id -1 is the last row
    out = np.zeros((len(distinct), len(model.languages)))
    for rows, codes in _by_length(distinct):
        alpha, scale = _forward(_Lattice(codes, vocab), p, keep=False)
        out[rows] = np.log(np.maximum(alpha, 1e-300)) + scale[:, None]
    return out


def expected_counts(distinct: list[str], weight: np.ndarray, p: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Expected uses (piece x language) of each piece in words that occur ``weight`` (word x language) times."""
    p1 = np.vstack([p, np.full((1, p.shape[1]), UNSEEN)])
    out = np.zeros_like(p1)
    for rows, codes in _by_length(distinct):
        found = _Lattice(codes, vocab)
        alpha, scale = _forward(found, p1, keep=True)
        n = found.letters
        beta = np.zeros_like(alpha)
        beta[n] = 1.0
        share = weight[rows] / np.maximum(alpha[n], 1e-300)
        for j in range(n, 0, -1):
            for i, r, ids in found.ending(j):
                # beta shares the forward scale, so that alpha * p * beta / total is a probability
                step = beta[j, r] * p1[ids] * np.exp(scale[i, r] - scale[j, r])[:, None]
                beta[i, r] += step
                np.add.at(out, ids, alpha[i, r] * step * share[r])
    return out[:-1]


def training_rows(id_col: str = "doc_id") -> Column:
    """Documents that may be learned from: crc32 of the id as text, mod 5, is not 0. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def train(docs: DataFrame, config: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn every language that the training rows have, from their text and language alone.

    The sample has ``docs_per_language`` documents of each language, those whose ids have the
    smallest hashes; it is found on two columns, pruned before the shuffle, and its bounded list of
    ids is then joined with the texts.
    """
    vocab = vocabulary(config.vocabulary)
    usable = docs.select(named(id_col).alias("id"), named(lang_col).alias("lang"), named(text_col).alias("text"))  # own names: docs may have any others
    usable = usable.where(training_rows("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["__lang"]: r["count"] for r in usable.groupBy(F.col("lang").alias("__lang")).count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((len(vocab.pieces), 0)), config)
    # twice the share that fills the sample is ranked, so that a large language sends few rows to its task
    # an Arrow table, as a list of rows would start Python workers of another kind, which stay beside those of the passes
    shares = docs.sparkSession.createDataFrame(pa.table({"__lang": pa.array(list(sizes), pa.string()), "__share": pa.array([min(1.0, 2.0 * config.docs_per_language / n) for n in sizes.values()], pa.float64())}))
    by_hash = Window.partitionBy("__lang").orderBy(hash_place("__id"), "__id")
    ids = usable.select(F.col("id").alias("__id"), F.col("lang").alias("__lang")).join(F.broadcast(shares), "__lang").where(hash_place("__id") <= F.col("__share"))
    chosen = ids.withColumn("__n", F.row_number().over(by_hash)).where(F.col("__n") <= config.docs_per_language).select("__id").distinct()
    sample = usable.join(F.broadcast(chosen), F.col("id") == F.col("__id"), "left_semi").select(F.col("lang").alias("__lang"), F.col("text").alias("__text"))
    number = {k: i for i, k in enumerate(languages)}

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[int, str]] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts.update((number[lang], w) for w in words(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "w", "n"])

    counted = arrow_map(sample, ["__lang", "__text"], count, "lang int, w string, n long").groupBy("w", "lang").agg(F.sum("n").alias("n"))
    table = materialize(counted.groupBy("w").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("uses")), "language-words")
    p = np.full((len(vocab.pieces), len(languages)), 1.0 / len(vocab.pieces))
    for _ in range(config.rounds):
        p = _maximize(table, p, config, len(languages))
    drop_materialized(table)
    return _with_limits(sample, LanguageModel(languages, p, config))


def _maximize(table: DataFrame, p: np.ndarray, config: LanguageConfig, n_languages: int) -> np.ndarray:
    """One round: expected counts of all sample words, summed by Spark, then smoothed shares."""
    held = table.sparkSession.sparkContext.broadcast(p)

    def expect(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(config.vocabulary)
        found = batch.column(0).to_pylist()
        for a, b in text_slices(found, 200_000):
            weight = np.zeros((b - a, n_languages))
            langs, uses = batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)
            weight[np.repeat(np.arange(b - a), langs.value_lengths().to_numpy()), langs.flatten().to_numpy()] = uses.flatten().to_numpy()
            use = expected_counts(found[a:b], weight, held.value, vocab)
            piece, lang = np.nonzero(use)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(use[piece, lang])], names=["piece", "lang", "uses"])

    sums = arrow_map(table, ["w", "langs", "uses"], expect, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
    total = np.full(p.shape, config.smoothing)
    for r in sums.collect():  # bounded by pieces times languages
        total[r["piece"], r["lang"]] += r["uses"]
    held.unpersist()
    return total / total.sum(axis=0)


def _with_limits(sample: DataFrame, model: LanguageModel) -> LanguageModel:
    """The model with the mean log probability a letter over each language's sample texts; texts under ``fit_letters`` letters count less."""
    held = sample.sparkSession.sparkContext.broadcast(model)
    number = {k: i for i, k in enumerate(model.languages)}

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total, letters = log_scores(batch.column(1).to_pylist(), held.value)
        lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int32)
        full = np.flatnonzero(letters)
        yield pa.RecordBatch.from_arrays([pa.array(lang[full], pa.int32()), pa.array(total[full, lang[full]] / letters[full]), pa.array(letters[full].astype(np.int64))], names=["lang", "fit", "letters"])

    fits = arrow_map(sample, ["__lang", "__text"], body, "lang int, fit double, letters long")
    weight = F.least(F.col("letters") / model.config.fit_letters, F.lit(1.0))
    found = fits.groupBy("lang").agg((F.sum(F.col("fit") * weight) / F.sum(weight)).alias("m")).collect()  # a row a language
    mean = np.full(len(model.languages), -np.inf)
    for r in found:
        mean[r["lang"]] = r["m"]
    return replace(model, mean=mean)


def log_scores(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log probability (text x language) and number of letters of each text."""
    totals, letters = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for a, b in text_slices(texts, 2_000_000):
        number: dict[str, int] = {}
        places, sizes = [], []
        for k, text in enumerate(texts[a:b], a):
            found = words(text or "")
            sizes.append(len(found))
            letters[k] = sum(map(len, found))
            places += [number.setdefault(w, len(number)) for w in found]
        if places:
            table = word_scores(list(number), model)
            full = np.flatnonzero(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
            totals[a + full] = np.add.reduceat(table[np.array(places)], starts, axis=0)
    return totals, letters


def score(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float], list[bool]]:
    """Language and posterior of each text, and whether it is as probable as that language's texts are; ``und`` and 0 without letters or without a model."""
    langs, scores, fits = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
    if not model.languages:
        return langs, scores, fits
    totals, letters = log_scores(texts, model)
    best = totals.argmax(axis=1)
    share = np.exp(totals - totals.max(axis=1, keepdims=True))
    share = share.max(axis=1) / share.sum(axis=1)
    for k in np.flatnonzero(letters):
        langs[k], scores[k] = model.languages[best[k]], float(share[k])
        if model.mean is not None:
            slack = model.config.fit_gap * max(1.0, (model.config.fit_letters / letters[k]) ** 0.5)
            fits[k] = bool(totals[k, best[k]] / letters[k] >= model.mean[best[k]] - slack)
    return langs, scores, fits


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    ``und`` with score 0 where the text is null, empty or without letters, or nothing could be
    learned. Ties go to the first language by name. Rows are scored one by one: null and repeated
    ids are kept; empty in, empty out; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, scores, _ = score(batch.column(1).to_pylist(), held.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return arrow_map(docs, [id_col, text_col], body, schema).select(id_col, (~training_rows(id_col)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that are in a learned language with more than ``least_score`` (or are all that was learned) and as probable a letter as that language's texts are.

    Texts that are null or without letters go. Repeated rows and null ids are judged one by one; empty in, empty out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = zip(*score(batch.column(at).to_pylist(), held.value), strict=True)
        yield batch.filter(pa.array([lang != "und" and s > least_score and fit for lang, s, fit in found], pa.bool_()))

    return arrow_map(docs, docs.columns, body, docs.schema)

"""Quality rules: repetition and length rules, then distribution divergence.

A document's character classes and common words are two histograms. A language's reference is the sum
of the histograms of all its documents; its common words are those that occur most often in them. A
document fails where its Jensen-Shannon distance to every reference is over a limit. Short documents
have noisy histograms, so each test has a minimum length. DataFrame expressions only: the words and
classes of each language are counted over all its documents, and one pass judges.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize
from .common import let, named, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class QualityConfig:
    """Limits of the rules; a distance is between 0 and 1. ``common_words``: the bins of a language's histogram, besides all other words."""

    min_words: int = 10
    most_repeat_percent: int = 20
    min_chars: int = 400
    most_class_distance: float = 0.22
    min_words_for_common: int = 100
    most_common_distance: float = 0.34
    common_words: int = 20


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text, the first occurrence included."""

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def spots(s: Column) -> Column:
            return F.array_sort(F.transform(F.filter(s, lambda x, j: F.get(s, j - 1)["k"].eqNullSafe(x["k"]) | F.get(s, j + 1)["k"].eqNullSafe(x["k"])), lambda x: x["i"]))

        def width(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(placed, spots), width)

    def windows(w: Column) -> Column:
        keys = let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
        )
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))

    return let(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(windows(w)))


def _class_counts(text: Column) -> Column:
    """Counts of lower-case letters, white space, upper-case letters, digits, other letters, the rest: each class is removed in turn."""

    def remove(t: Column, pattern: str) -> Column:
        return F.regexp_replace(t, pattern, "")

    def counts(steps: list[Column]) -> Column:
        sizes = [F.char_length(s) for s in steps]
        return F.array(*[(a - b).cast("long") for a, b in zip(sizes, sizes[1:], strict=False)], sizes[-1].cast("long"))

    patterns = [r"\p{Ll}+", r"\s+", r"\p{Lu}+", r"[0-9]+", r"\p{L}+"]

    def chain(steps: list[Column], rest: list[str]) -> Column:
        return let(remove(steps[-1], rest[0]), lambda t: chain([*steps, t], rest[1:])) if rest else counts(steps)

    return chain([text], patterns)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares. A bin that one side lacks adds half of the other's share."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x == 0, y / 2).when(y == 0, x / 2).otherwise((x * F.log2(x * 2 / (x + y)) + y * F.log2(y * 2 / (x + y))) / 2)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def language_references(docs: DataFrame, config: QualityConfig = QualityConfig(), text_col: str = "text", lang_col: str = "lang") -> list[Row]:
    """A row a language, by name: ``lang, classes, words, common``, the summed histograms of all its documents.

    ``common`` counts ``words``, the most frequent ones (ties by spelling), and then all others. As
    many rows as languages, each as long as the histograms.
    """
    base = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("__lang"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    counted = base.select("__lang", F.explode(words_of(F.col("__text"))).alias("__w")).groupBy("__lang", "__w").agg(F.count(F.lit(1)).alias("__n"))
    counted = materialize(counted, "language-words")
    classes = base.select("__lang", let(F.col("__text"), _class_counts).alias("__c")).groupBy("__lang").agg(F.array(*[F.sum(F.get(F.col("__c"), F.lit(i))) for i in range(6)]).alias("classes"))
    sums = counted.groupBy("__lang").agg(F.sum("__n").alias("n")).join(classes, "__lang").orderBy("__lang").collect()
    by_count = Window.partitionBy("__lang").orderBy(F.desc("__n"), "__w")
    top: dict[str, list[Row]] = {}
    for r in counted.withColumn("__k", F.row_number().over(by_count)).where(F.col("__k") <= config.common_words).orderBy("__lang", "__k").collect():
        top.setdefault(r["__lang"], []).append(r)
    drop_materialized(counted)
    rows = []
    for r in sums:
        own = top[r["__lang"]]
        rows.append(Row(lang=r["__lang"], classes=list(r["classes"]), words=[x["__w"] for x in own], common=[*(x["__n"] for x in own), r["n"] - sum(x["__n"] for x in own)]))
    return rows


def _constant(value: object, kind: str) -> Column:
    """A nested value as one folded literal, however large."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _shares(counts: list[int]) -> list[float]:
    return [x / sum(counts) for x in counts]


def _class_distance(counts: Column, references: list[Row]) -> Column:
    """The smallest distance of a document's classes to a reference."""
    refs = _constant([_shares(r["classes"]) for r in references], "array<array<double>>")
    share = let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), lambda n: F.transform(counts, lambda x: x / n))
    return let(share, lambda p: F.array_min(F.transform(refs, lambda q: js_distance(p, q))))


def _common_distance(words: Column, references: list[Row]) -> Column:
    """The smallest distance of a document's words to a reference, over that language's common words and all others."""
    refs = _constant([{"w": r["words"], "q": _shares(r["common"])} for r in references], "array<struct<w: array<string>, q: array<double>>>")
    listed = F.filter(words, lambda w: w.isin(*sorted({w for r in references for w in r["words"]})))

    def distance(found: Column, n: Column, ref: Column) -> Column:
        counts = F.transform(ref["w"], lambda b: F.size(found) - F.size(F.array_remove(found, b)))
        rest = lambda c: F.array_append(c, n - F.aggregate(c, F.lit(0), lambda a, x: a + x))
        return js_distance(F.transform(let(counts, rest), lambda c: c / n), ref["q"])

    return let(F.size(words), lambda n: let(listed, lambda found: F.array_min(F.transform(refs, lambda r: distance(found, n, r)))))


def _judged(docs: DataFrame, held: list[Column], config: QualityConfig, references: list[Row], text_col: str) -> DataFrame:
    """``held`` and the columns of the contract. The words and the classes of a text are made once."""
    references = [r for r in references if sum(r["classes"]) and sum(r["common"])]
    out = docs.select(*held, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    out = out.withColumns({"__words": words_of(F.col("__text")), "__classes": let(F.col("__text"), _class_counts), "__chars": F.char_length("__text")})
    words, text, none = F.col("__words"), F.col("__text"), F.lit(0.0)
    n = F.size(words)
    out = out.select(
        *[F.col(c) for c in out.columns if c not in ("__text", "__words", "__classes")],
        n.cast("long").alias("n_words"), (F.col("__chars") - F.get("__classes", F.lit(1))).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), _repeat_words(words).alias("n_repeat_words"),
        F.when(F.col("__chars") >= config.min_chars, F.round(_class_distance(F.col("__classes"), references), 6) if references else none).alias("class_distance"),
        F.when(n >= config.min_words_for_common, F.round(_common_distance(words, references), 6) if references else none).alias("common_distance"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < config.min_words) | (100 * F.col("n_repeat_words") > config.most_repeat_percent * F.col("n_words")))
    far = (F.coalesce("class_distance", none) > config.most_class_distance) | (F.coalesce("common_distance", none) > config.most_common_distance)
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("__chars")


def score_quality(docs: DataFrame, config: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, common_distance, base_failed, kept`` of each row.

    A distance is null where the text is shorter than its test asks for, which it then passes. A null
    or empty text has no words and fails the base rule. Rows are judged one by one, so null and
    repeated ids stay as they are; documents without a language count for no reference but are judged
    by all. With no reference at all (an empty table, or no language with a word) distances are 0.
    Other columns of ``docs`` are ignored. Windows are compared by 64-bit hashes.
    """
    return _judged(docs, [F.col(id_col)], config, language_references(docs, config, text_col, lang_col), text_col)


def keep_good(docs: DataFrame, config: QualityConfig = QualityConfig(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. The same rules as ``score_quality``; empty in, empty out."""
    references = language_references(docs, config, text_col, lang_col)
    judged = _judged(docs, [F.struct(*map(named, docs.columns)).alias("__row")], config, references, text_col)
    # a plain filter would be pushed under the columns it needs, and then split the text for each of them anew
    return judged.select(F.explode_outer(F.when(F.col("kept"), F.array("__row"))).alias("__row")).where(F.col("__row").isNotNull()).select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])

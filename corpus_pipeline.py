"""The corpus pipeline: five operators of ``parcela.llm`` applied one after another to ``documents``.

Every stage but the last returns the columns of its ``docs``, whatever others they have. Each keeps
or drops whole rows by text alone, so null and repeated ids are no matter unless a stage says so;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcela.llm import decontamination, jaccard_join, language_id, packing, quality_rules
from parcela.session import drop_materialized, materialize, table

#: Bytes of rows that a task hands to Python at once. Spark's own 64 MB are held several times by each of an executor's tasks, in the JVM and in Python.
BATCH_BYTES = "4m"

#: SQL has no byte-pair merges and no trained language model; tests hold run() against brute force.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are small; a stage is run by its caller, so this outlasts the call."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null, empty and very short texts go; repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, and as probable as its texts are. Texts without letters go, and all where no row has a language."""
    _small_batches(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (null ids last, ties by a digest): sets of five-word shingles, similar from 0.8 on. Texts without words stay, repeated rows once."""
    _small_batches(spark)
    return jaccard_join.keep_one(docs, jaccard_join.JaccardConfig(shingle_words=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts and items match nothing."""
    _small_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, each with its ids. A null text counts as empty and is one piece."""
    _small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("language id", language), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark_decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written and read again by the next, and then deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            drop_materialized(docs)
        docs = done
    return docs

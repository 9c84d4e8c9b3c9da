"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root, table
from . import decontamination, hard_negatives, jaccard_join, language_id, license_scan, oracles, packing, quality_model, quality_rules, revisits, sharding, spelling, token_counts, winnowing

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("ids")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of the captures that are derived from ``pages``; headers as one text, ``name: value`` by name."""
    found = revisits.resolve_revisits(revisits.captures_of_pages(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as eight arrivals by id, each appended and compacted into what is there, and read back from the last version."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{shared_root(spark)}/parcela/shards-{uuid.uuid4().hex}", docs.schema)
    span = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    cuts = [(span["a"] or 0) + ((span["b"] or 0) - (span["a"] or 0) + 1) * k // 8 for k in range(1, 8)]
    for k in range(8):
        arrival = F.col("doc_id").isNull() | (F.col("doc_id") < cuts[0]) if k == 0 else F.col("doc_id") >= cuts[k - 1]
        store.append(docs.where(arrival if k in (0, 7) else arrival & (F.col("doc_id") < cuts[k])))
        store.compact_fully()
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), spelling.SpellingConfig(delete_every=31))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_packing, op2_license_scan, op3_quality_classifier, op4_decontamination, op5_language_id, op6_revisits, op7_token_counts, op8_quality_rules, op9_jaccard_join, op10_sharding, op11_hard_negatives, op12_winnowing, op13_spelling_variants)}
ORACLE: dict[str, str] = oracles.all_sql()


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

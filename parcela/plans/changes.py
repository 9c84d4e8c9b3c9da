"""Queries and oracle SQL of change detection, merges and scan bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import segments as T
from ..session import table
from .views import ctes, view

NOW = "1999-06-01 00:00:00"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_now = lambda: F.lit(NOW).cast("timestamp_ntz")
_T = f"TIMESTAMP '{NOW}'"


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def _hash_sql(prefix: str = "") -> str:
    number = lambda c: f"coalesce(regexp_replace(regexp_replace(CAST(CAST({prefix}{c} AS DECIMAL(38,10)) AS VARCHAR), '0+$', ''), '\\.$', ''), 'null')"
    text = lambda c: f"coalesce(CAST(to_json({prefix}{c}) AS VARCHAR), 'null')"
    return "sha256('{' || concat_ws(', ', " + ", ".join(f"'\"{c}\": ' || {text(c) if c in L.TEXTS else number(c)}" for c in L.HASHED) + ") || '}')"


_COLUMNS = ", ".join([*[f"c.{c}, f.{c} AS in_{c}" for c in L.PAYLOAD], "c.id", "c.first_seen_at", "c.last_seen_at", "c.last_changed_at"])
_CASES = ctes("current_entities", "incoming", more={
    "fresh": "SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY page DESC, position DESC) = 1",
    "cases": f"""SELECT coalesce(c.source_id, f.source_id) AS source_id, coalesce(c.external_id, f.external_id) AS external_id, {_COLUMNS}, {_hash_sql('c.')} AS h, {_hash_sql('f.')} AS in_h,
      CASE WHEN c.external_id IS NULL THEN 'A' WHEN f.external_id IS NULL THEN 'D' WHEN {_hash_sql('c.')} = {_hash_sql('f.')} THEN 'B' ELSE 'C' END AS k
      FROM current_entities c FULL JOIN fresh f ON c.source_id = f.source_id AND c.external_id = f.external_id""",
})
_IN = lambda c: f"CAST(in_{c} AS DECIMAL(18,2))" if c == "price_amount" else f"in_{c}"
#: The current table after a merge.
MERGED = _CASES + "SELECT source_id, external_id, id, " + ", ".join(f"CASE WHEN k IN ('A','C') THEN {_IN(c)} ELSE {c} END AS {c}" for c in L.PAYLOAD) + f""",
    coalesce(first_seen_at, {_T}) AS first_seen_at, CASE WHEN k <> 'D' THEN {_T} ELSE last_seen_at END AS last_seen_at, CASE WHEN k IN ('A','C') THEN {_T} ELSE last_changed_at END AS last_changed_at,
    CASE WHEN k IN ('A','C') THEN in_h ELSE h END AS content_hash FROM cases"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify(view(spark, sf_dir, "current_entities"), view(spark, sf_dir, "incoming"))


_add("lifecycle_classify", lambda s, d: cases(s, d).select("source_id", "external_id", "case"), _CASES + "SELECT source_id, external_id, k AS \"case\" FROM cases")
_add("lifecycle_merge", lambda s, d: L.merge(view(s, d, "current_entities"), view(s, d, "incoming"), _now()), MERGED)
_add("lifecycle_snapshots", lambda s, d: L.snapshots(cases(s, d), _now()), _CASES + f"SELECT source_id, external_id, {_T} AS captured_at, " + ", ".join(f"{_IN(c)} AS {c}" for c in L.PAYLOAD) + ", in_h AS content_hash FROM cases WHERE k IN ('A','C')")
_add("lifecycle_counts", lambda s, d: L.counters(cases(s, d)), _CASES + "SELECT source_id, count(*) FILTER (k='A') AS new_count, count(*) FILTER (k='C') AS changed_count, count(*) FILTER (k='B') AS unchanged_count, count(*) FILTER (k='D') AS disappeared_count FROM cases GROUP BY 1")
_add("lifecycle_scan_counts", lambda s, d: L.scan_counters(cases(s, d), view(s, d, "incoming").withColumn("segment_id", F.col("page") % 37), "segment_id"), _CASES + """
    SELECT segment_id, found_count, coalesce(new_count, 0) AS new_count, coalesce(changed_count, 0) AS changed_count, coalesce(unchanged_count, 0) AS unchanged_count
    FROM (SELECT page % 37 AS segment_id, count(*) AS found_count FROM incoming GROUP BY 1) LEFT JOIN (SELECT f.page % 37 AS segment_id, count(*) FILTER (k = 'A') AS new_count, count(*) FILTER (k = 'C') AS changed_count, count(*) FILTER (k = 'B') AS unchanged_count
      FROM fresh f JOIN cases c ON c.source_id = f.source_id AND c.external_id = f.external_id GROUP BY 1) USING (segment_id)""")  # fmt: skip
_add("disappeared_listings", lambda s, d: cases(s, d).where(F.col("case") == "D").select("source_id", "external_id"), _CASES + "SELECT source_id, external_id FROM cases WHERE k = 'D'")

_add("content_hash", lambda s, d: view(s, d, "listings").select("id", L.content_hash(list(L.HASHED)).alias("content_hash")), ctes("listings") + f"SELECT id, {_hash_sql()} AS content_hash FROM listings")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "listings")
    return rows.withColumn("content_hash", F.when(F.col("id") % 12 == 0, "old").otherwise(L.content_hash(rows.columns)))


_add("rehash_diff", lambda s, d: L.rehash(_stored(s, d)), ctes("listings") + f"SELECT id, 'old' AS content_hash, {_hash_sql()} AS new_hash FROM listings WHERE id % 12 = 0")


_BOX = ", ".join(T.BOUNDARIES)


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the boxes again with new counts, and boxes that are not there yet."""
    rows = view(spark, sf_dir, "segments").where(F.col("id") % 3 == 0)
    moved = rows.withColumn("portal", F.concat("portal", F.lit("-"), F.col("id").cast("string")))
    again = rows.groupBy(*T.BOUNDARIES).agg(F.max("total_count").alias("total_count"), F.max("depth").alias("depth"))
    return again.unionByName(moved.select(*T.BOUNDARIES, "total_count", "depth")).withColumns({"total_count": F.col("total_count") + 1, "is_leaf": F.lit(True), "is_oversized": F.lit(False)})


_add("segment_upsert", lambda s, d: T.upsert_segments(view(s, d, "segments"), _rebuilt(s, d), _now()), ctes("segments", more={
    "rebuilt": f"SELECT {_BOX}, max(total_count) + 1 AS total_count, max(depth) AS depth FROM segments WHERE id % 3 = 0 GROUP BY {_BOX} UNION ALL SELECT portal || '-' || id, {_BOX.removeprefix('portal, ')}, total_count + 1, depth FROM segments WHERE id % 3 = 0",
}) + f"""SELECT t.id, {', '.join(f'coalesce(t.{c}, u.{c}) AS {c}' for c in T.BOUNDARIES)}, coalesce(u.depth, t.depth) AS depth, coalesce(u.total_count, t.total_count) AS total_count,
    CASE WHEN u.portal IS NOT NULL THEN true ELSE is_leaf END AS is_leaf, CASE WHEN u.portal IS NOT NULL THEN false ELSE is_oversized END AS is_oversized, CASE WHEN u.portal IS NOT NULL THEN 'active' ELSE t.status END AS status,
    t.churn_ewma, coalesce(t.churn_samples, 0) AS churn_samples, t.last_churn_observed_at, coalesce(t.created_at, {_T}) AS created_at, CASE WHEN u.portal IS NOT NULL THEN {_T} ELSE t.updated_at END AS updated_at
    FROM segments t FULL JOIN rebuilt u ON {' AND '.join(f't.{c} = u.{c}' for c in T.BOUNDARIES)}""")  # fmt: skip
_add("merge_upsert", lambda s, d: L.merge_upsert(view(s, d, "current_entities").select("external_id", "price_amount", F.col("first_seen_at").alias("created_at"), F.col("last_seen_at").alias("updated_at")), L.latest_per_key(view(s, d, "incoming"), L.KEYS, [F.desc("page"), F.desc("position")]), ["external_id"], ["price_amount"], _now()),
     _CASES + f"SELECT external_id, CASE WHEN k <> 'D' THEN in_price_amount ELSE CAST(price_amount AS DOUBLE) END AS price_amount, coalesce(first_seen_at, {_T}) AS created_at, CASE WHEN k <> 'D' THEN {_T} ELSE last_seen_at END AS updated_at FROM cases")
_add("append_row", lambda s, d: L.append_row(view(s, d, "runs").select("id", "run_type", "status", F.col("started_at").alias("created_at")), view(s, d, "runs").where("status = 'failed'").select("id", "run_type"), _now()),
     ctes("runs") + f"SELECT id, run_type, status, started_at AS created_at FROM runs UNION ALL SELECT id, run_type, NULL, {_T} FROM runs WHERE status = 'failed'")
_add("insert_if_absent", lambda s, d: L.insert_if_absent(view(s, d, "scan_queue").where(F.col("segment_id") % 2 == 0).select("segment_id", "status"), view(s, d, "segments").select(F.col("id").alias("segment_id"), F.lit("pending").alias("status")), ["segment_id"]),
     ctes("scan_queue", "segments") + "SELECT segment_id, status FROM scan_queue WHERE segment_id % 2 = 0 UNION ALL SELECT id, 'pending' FROM segments WHERE id % 2 <> 0")
_add("append_new_ids", lambda s, d: L.new_rows(view(s, d, "incoming").select("external_id"), view(s, d, "current_entities"), "external_id"), ctes("incoming", "current_entities") + "SELECT DISTINCT external_id FROM incoming WHERE external_id NOT IN (SELECT external_id FROM current_entities)")
_add("resume_anti_join", lambda s, d: L.resume(view(s, d, "listings").select("id", "seller_id"), view(s, d, "listings").where(F.col("id") % 40 < 20).select("seller_id"), "seller_id"), ctes("listings") + "SELECT id, seller_id FROM listings WHERE seller_id IS NULL OR seller_id NOT IN (SELECT seller_id FROM listings WHERE id % 40 < 20 AND seller_id IS NOT NULL)")
_add("dedupe_keep_first", lambda s, d: L.dedupe_keep_first(table(s, d, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url")), "url", "page_id"), "SELECT page_id, u AS url, n_duplicates FROM (SELECT page_id, trim(regexp_replace(url, '#.*$', '')) AS u, row_number() OVER (PARTITION BY u ORDER BY page_id) AS rn, count(*) OVER (PARTITION BY u) - 1 AS n_duplicates FROM pages WHERE u <> '') WHERE rn = 1")
_add("slice_offset_limit", lambda s, d: view(s, d, "listings").select("id", "title").orderBy("id").offset(40).limit(60), ctes("listings") + "SELECT id, title FROM listings ORDER BY id LIMIT 60 OFFSET 40")
_add("recycled_pages", lambda s, d: L.kept_pages(view(s, d, "pages_seen")), ctes("pages_seen", more={
    "items": "SELECT DISTINCT segment, page, item FROM pages_seen", "firsts": "SELECT segment, item, min(page) AS f FROM items GROUP BY ALL",
    "p": "SELECT i.segment, i.page, count(*) FILTER (i.page = f.f) AS new_items, count(*) AS n_items FROM items i JOIN firsts f USING (segment, item) GROUP BY ALL",
}) + "SELECT * FROM p WHERE page < coalesce((SELECT min(page) FROM p q WHERE q.segment = p.segment AND q.new_items = 0), 1e9)")
_add("empty_streak_cut", lambda s, d: L.before_empty_streak(view(s, d, "catalog_pages")), ctes("catalog_pages", more={
    "a": "SELECT *, count(*) FILTER (result = 'ok') OVER (PARTITION BY catalog ORDER BY page) AS island FROM catalog_pages",
    "b": "SELECT *, count(*) FILTER (result = 'empty') OVER (PARTITION BY catalog, island ORDER BY page) AS e FROM a",
    "stops": "SELECT catalog, min(page) AS stop FROM b WHERE result = 'empty' AND e = 3 GROUP BY 1",
}) + "SELECT b.catalog, page, result FROM b LEFT JOIN stops s ON b.catalog = s.catalog WHERE stop IS NULL OR page <= stop")
_add("segment_scan_stats", lambda s, d: L.scan_stats(view(s, d, "catalog_pages")), ctes("catalog_pages") + "SELECT catalog, count(*) FILTER (result <> 'error') AS pages_ok, count(*) FILTER (result = 'error') AS pages_failed, count(*) FILTER (result = 'ok') AS total_found, pages_failed > 0 AND total_found = 0 AS failed FROM catalog_pages GROUP BY 1")

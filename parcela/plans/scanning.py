"""Queries and oracle SQL of segments, the scan queue and operational rollups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as M
from ..operators import ops as O
from ..operators import queue as K
from ..operators import segments as T
from ..session import shared_root
from ..sources.versions import VersionedTable
from .market import _PENDING, _built, entities
from .views import ctes, view

NOW = "1998-04-15 06:00:00"
SINCE = "1998-03-10 00:00:00"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_TS, _SINCE = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{SINCE}'"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


# --- segments ---------------------------------------------------------------------------------

TREE = T.TreeConfig(max_count=400, max_depth=9, price_width=131_072.0, surface_width=64.0, min_price_width=4_096.0, min_surface_width=4.0)
_BIN = "lpad(bin(CAST(least(floor({0} / {1} * {2}), {2} - 1) AS BIGINT)), {3}, '0')"
_add("segment_tree", lambda s, d: T.segment_tree(view(s, d, "tree_rows"), TREE), ctes("tree_rows", more={
    "full": f"SELECT root, substr({_BIN.format('price', '131072.0e0', 32, 5)} || {_BIN.format('surface', '64.0e0', 16, 4)}, 1, 9) AS path FROM tree_rows WHERE price BETWEEN 0 AND 131072 AND surface BETWEEN 0 AND 64",
    "boxes": "SELECT root, substr(path, 1, CAST(k AS INT)) AS path, count(*) AS n FROM full, range(0, 10) t(k) GROUP BY ALL".replace("FROM full,", 'FROM "full",'),
    "splits": "SELECT root, path FROM boxes WHERE n > 400 AND length(path) < 9",
    "reached": "SELECT DISTINCT root, '' AS path FROM boxes UNION ALL SELECT root, path || b FROM splits, (VALUES ('0'), ('1')) v(b)",
}).replace("full AS (", '"full" AS (') + """SELECT r.root, r.path, CAST(length(r.path) AS INT) AS depth, coalesce(n, 0) AS n, coalesce(n, 0) > 400 AS is_oversized FROM reached r LEFT JOIN boxes b ON r.root = b.root AND r.path = b.path
    WHERE NOT (coalesce(n, 0) > 400 AND length(r.path) < 9)""")  # fmt: skip
_add("segment_leaves", lambda s, d: T.leaf_segments(view(s, d, "segments"), "portal").select("id", "operation_key", "province_key"), ctes("segments") + "SELECT id, operation_key, province_key FROM segments WHERE portal = 'portal' AND status = 'active' AND is_leaf")
_add("segment_deactivate", lambda s, d: T.deactivate(view(s, d, "segments"), "portal").groupBy("status").count().withColumnRenamed("count", "n"), ctes("segments") + "SELECT 'inactive' AS status, count(*) AS n FROM segments GROUP BY 1")
_RANKED = "SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY captured_at DESC, id DESC) AS rn FROM segment_snapshots"
_TWO = {"ranked": _RANKED, "pair": "SELECT segment_id, max(total_count) FILTER (rn = 1) AS current_count, max(total_count) FILTER (rn = 2) AS prev_count FROM ranked GROUP BY 1 HAVING max(total_count) FILTER (rn = 2) IS NOT NULL"}
_add("snapshot_delta", lambda s, d: T.latest_two(view(s, d, "segment_snapshots")), ctes("segment_snapshots", more=_TWO) + "SELECT * FROM pair")
_CHANGED = {**_TWO, "moved": """SELECT p.segment_id, q.id AS queue_id, prev_count, current_count, current_count - prev_count AS delta,
      CASE WHEN prev_count > 0 THEN abs(current_count - prev_count) * 100.0e0 / prev_count WHEN current_count > 0 THEN 100.0e0 ELSE 0.0e0 END AS pct
      FROM pair p JOIN scan_queue q ON q.segment_id = p.segment_id AND q.status = 'complete' WHERE p.segment_id IN (SELECT id FROM segments WHERE status = 'active' AND is_leaf)""",
    "judged": "SELECT *, abs(delta) >= 30 OR pct >= 2 AS invalidate, CASE WHEN abs(delta) >= 100 OR pct >= 10 THEN 'high' WHEN abs(delta) >= 30 OR pct >= 2 THEN 'normal' END AS new_priority FROM moved"}


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.invalidate(view(spark, sf_dir, "segment_snapshots"), view(spark, sf_dir, "scan_queue"), view(spark, sf_dir, "segments"))


_add("segment_invalidate", lambda s, d: changed(s, d).select("segment_id", "queue_id", "prev_count", "current_count", "delta", F.round("pct", 6).alias("pct"), "invalidate", "new_priority"),
     ctes("segment_snapshots", "scan_queue", "segments", more=_CHANGED) + "SELECT segment_id, queue_id, prev_count, current_count, delta, round(pct, 6) AS pct, invalidate, new_priority FROM judged")
_add("segment_top_delta", lambda s, d: T.top_delta(changed(s, d)).select("segment_id", "delta"), ctes("segment_snapshots", "scan_queue", "segments", more=_CHANGED) + "SELECT segment_id, delta FROM judged WHERE invalidate ORDER BY abs(delta) DESC, segment_id LIMIT 10")
_VOL = {"ranked": _RANKED, "steps": "SELECT segment_id, total_count, lag(total_count) OVER (PARTITION BY segment_id ORDER BY rn DESC) AS p FROM ranked WHERE rn <= 5",
        "vol": "SELECT segment_id, coalesce(avg(CASE WHEN p > 0 THEN abs(total_count - p) / CAST(p AS DOUBLE) WHEN p = 0 THEN CASE WHEN total_count > 0 THEN 1.0e0 ELSE 0.0e0 END END), 0.0e0) AS count_volatility FROM steps GROUP BY 1"}
_add("segment_volatility", lambda s, d: T.volatility(view(s, d, "segment_snapshots")).withColumn("count_volatility", F.round("count_volatility", 6)), ctes("segment_snapshots", more=_VOL) + "SELECT segment_id, round(count_volatility, 6) AS count_volatility FROM vol")
_EVIDENCE = "churn_samples >= 1"
_SCORED = {**_VOL, "scored": f"""SELECT s.id AS segment_id, portal, total_count, churn_ewma, churn_samples, count_volatility,
      0.5e0 * CASE WHEN {_EVIDENCE} AND churn_ewma IS NOT NULL THEN least(churn_ewma / 0.05e0, 1.0e0) ELSE 0.0e0 END + 0.25e0 * least(coalesce(count_volatility, 0.0e0) / 0.10e0, 1.0e0) + 0.25e0 * least(total_count / 2000.0e0, 1.0e0) AS raw_score,
      CAST(round(CAST(raw_score AS DECIMAL(18,10)), 4) AS DOUBLE) AS score, status, is_leaf, is_oversized
      FROM segments s LEFT JOIN vol v ON v.segment_id = s.id""",
    "tiers": f"SELECT *, CASE WHEN NOT {_EVIDENCE} THEN 'unknown' WHEN raw_score >= 0.7e0 THEN 'hot' WHEN raw_score >= 0.35e0 OR total_count >= 1500 THEN 'warm' ELSE 'cold' END AS tier FROM scored"}
_add("segment_score", lambda s, d: T.score(view(s, d, "segments").withColumnRenamed("id", "segment_id").join(T.volatility(view(s, d, "segment_snapshots")), "segment_id", "left")).select("segment_id", "score", "tier"),
     ctes("segments", "segment_snapshots", more=_SCORED) + "SELECT segment_id, score, tier FROM tiers")
_DUE = {**_SCORED, "aged": f"""SELECT t.*, (epoch_us({_TS}) - epoch_us(coalesce(completed_at, updated_at, created_at))) / 3600000000.0e0 AS age_hours, CASE tier WHEN 'hot' THEN 24.0e0 WHEN 'warm' THEN 72.0e0 WHEN 'cold' THEN 168.0e0 ELSE 72.0e0 END AS gap_hours
      FROM tiers t JOIN (SELECT segment_id, completed_at, updated_at, created_at FROM scan_queue WHERE status = 'complete') q ON q.segment_id = t.segment_id WHERE t.status = 'active' AND is_leaf AND NOT is_oversized AND total_count > 0""",
    "due": "SELECT *, age_hours / gap_hours AS overdue_ratio, CAST(greatest(ceil(total_count / 20.0e0), 1) AS INT) AS estimated_pages FROM aged WHERE age_hours >= 12 AND age_hours > gap_hours"}


def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.due(view(spark, sf_dir, "segments"), view(spark, sf_dir, "segment_snapshots"), view(spark, sf_dir, "scan_queue"), _at(NOW))


_D = ["segment_id", "tier", "score", "age_hours", "gap_hours", "overdue_ratio", "estimated_pages"]
_add("segment_due", lambda s, d: due(s, d).select(*_D), ctes("segments", "segment_snapshots", "scan_queue", more=_DUE) + f"SELECT {', '.join(_D)} FROM due")


def _greedy_sql(rows: str, order: str, max_pages: int, max_items: int) -> str:
    """A walk in order as a recursive query: (rank, pages so far, items so far, taken)."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY portal ORDER BY {order}) AS rn FROM {rows}),
    walk AS (SELECT portal, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS pages, CAST(0 AS BIGINT) AS items, CAST(NULL AS BIGINT) AS taken FROM (SELECT DISTINCT portal FROM ordered)
      UNION ALL SELECT w.portal, o.rn, w.pages + CASE WHEN w.pages + o.estimated_pages <= {max_pages} AND w.items < {max_items} THEN o.estimated_pages ELSE 0 END,
        w.items + CASE WHEN w.pages + o.estimated_pages <= {max_pages} AND w.items < {max_items} THEN 1 ELSE 0 END, CASE WHEN w.pages + o.estimated_pages <= {max_pages} AND w.items < {max_items} THEN o.segment_id END
        FROM walk w JOIN ordered o ON o.portal = w.portal AND o.rn = w.rn + 1) """


_REFRESH = ctes("segments", "segment_snapshots", "scan_queue", more=_DUE).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _greedy_sql("due", "overdue_ratio DESC, score DESC, segment_id", 1500, 50)
_add("refresh_budget", lambda s, d: T.select_refresh(due(s, d)).select("segment_id", "estimated_pages", "tier"), _REFRESH + "SELECT segment_id, estimated_pages, tier FROM due WHERE segment_id IN (SELECT taken FROM walk WHERE taken IS NOT NULL)")
_OUT = {"timed": "SELECT *, (epoch_us(scanned_at) - epoch_us(lag(scanned_at) OVER w)) / 86400000000.0e0 AS elapsed_days, total_count - lag(total_count) OVER w AS delta_total_count FROM scan_history WINDOW w AS (PARTITION BY segment_id ORDER BY scanned_at, id)",
        "outcomes": "SELECT *, CASE WHEN elapsed_days IS NOT NULL AND priority <> 'full_scan_baseline' AND listings_found > 0 THEN least((new_count + changed_count) / CAST(listings_found AS DOUBLE) / greatest(elapsed_days, 0.5e0), 1.0e0) END AS churn FROM timed"}


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scan_outcomes(view(spark, sf_dir, "scan_history"))


_H = ctes("scan_history", more=_OUT)
_add("churn_daily", lambda s, d: outcomes(s, d).select("id", F.round("elapsed_days", 6).alias("elapsed_days"), F.round("churn", 6).alias("churn_daily")), _H + "SELECT id, round(elapsed_days, 6) AS elapsed_days, round(churn, 6) AS churn_daily FROM outcomes")
_add("scan_history", lambda s, d: outcomes(s, d).select("id", "segment_id", "priority", "listings_found", F.round("churn", 4).alias("churn_daily"), T.tier_of_priority(F.col("priority")).alias("tier")), _H + "SELECT id, segment_id, priority, listings_found, round(churn, 4) AS churn_daily, nullif(regexp_extract(priority, '^refresh_(.*)$', 1), '') AS tier FROM outcomes")
_add("history_delta", lambda s, d: outcomes(s, d).select("id", "delta_total_count"), _H + "SELECT id, delta_total_count FROM outcomes")
_add("churn_ewma", lambda s, d: T.churn_ewma(outcomes(s, d)).withColumn("churn_ewma", F.round("churn_ewma", 6)), _H + "SELECT segment_id, round(list_reduce(list(churn ORDER BY scanned_at, id), lambda a, x: 0.5e0 * x + 0.5e0 * a), 6) AS churn_ewma, CAST(count(*) AS INT) AS churn_samples FROM outcomes WHERE churn IS NOT NULL GROUP BY 1")
_add("churn_inherit", lambda s, d: T.inherit_churn(view(s, d, "segments"), 2), ctes("segments") + """
    SELECT c.id, min_by(d.id, (a, d.id)) AS donor_id, min_by(d.churn_ewma, (a, d.id)) AS churn_ewma, least(min_by(d.churn_samples, (a, d.id)), 2) AS churn_samples, min_by(d.last_churn_observed_at, (a, d.id)) AS last_churn_observed_at FROM segments c
    JOIN (SELECT *, (price_max - price_min) * (surface_max - surface_min) AS a FROM segments WHERE churn_ewma IS NOT NULL) d ON c.portal = d.portal AND c.operation_key = d.operation_key AND c.province_key = d.province_key
      AND d.price_min <= c.price_min AND d.price_max >= c.price_max AND d.surface_min <= c.surface_min AND d.surface_max >= c.surface_max AND d.id <> c.id
    WHERE c.status = 'active' AND c.is_leaf AND c.churn_ewma IS NULL AND c.churn_samples = 0 GROUP BY c.id""")  # fmt: skip
_SPLIT = """SELECT portal, operation_key, province_key, price_min, CASE WHEN h = 1 THEN (price_min + price_max) / 2 ELSE price_max END AS price_max, surface_min, surface_max, CAST(total_count / 2 AS INT) AS total_count, depth + 1 AS depth, true AS is_leaf, false AS is_oversized
    FROM (SELECT *, CASE WHEN id % 4 = 1 THEN 1 END AS h FROM ONE) WHERE id % 4 <> 3"""


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new tree: of the segments' boxes, each once, a quarter goes, a quarter is halved and the rest stay."""
    one = view(spark, sf_dir, "segments").groupBy(*T.BOUNDARIES).agg(F.min("id").alias("id"), F.min_by("total_count", "id").alias("total_count"), F.min_by("depth", "id").alias("depth"))
    return spark.sql(_SPLIT.replace("ONE", "{one}"), one=one)


def _rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of distinct boxes after a new tree, without the numbers of the new ids."""
    known = view(spark, sf_dir, "segments").join(view(spark, sf_dir, "segments").groupBy(*T.BOUNDARIES).agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
    out = T.rebuild(known, _rebuilt(spark, sf_dir), "portal", _at(NOW), 2)
    largest = known.agg(F.max("id").alias("m"))
    rows = out.crossJoin(F.broadcast(largest)).withColumn("is_new", F.col("id") > F.col("m"))
    return rows.select("is_new", F.when(~F.col("is_new"), F.col("id")).alias("id"), *T.BOUNDARIES, "status", "total_count", "churn_ewma", "churn_samples", "last_churn_observed_at", "updated_at")


_KEYLIST = ", ".join(T.BOUNDARIES)
_add("segment_rebuild", _rebuild, ctes("segments", more={
    "known": f"SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY {_KEYLIST} ORDER BY id) = 1",
    "tree": _SPLIT.replace("ONE", "known").replace("CAST(total_count / 2 AS INT)", "CAST(trunc(total_count / 2) AS INT)"),
    "taken": f"""SELECT k.id IS NULL AS is_new, k.id, {", ".join(f"coalesce(k.{c}, t.{c}) AS {c}" for c in T.BOUNDARIES)}, CASE WHEN t.is_leaf THEN 'active' ELSE 'inactive' END AS status, CASE WHEN t.is_leaf THEN t.total_count ELSE k.total_count END AS total_count,
      CASE WHEN t.is_leaf THEN true ELSE k.is_leaf END AS is_leaf, k.churn_ewma, coalesce(k.churn_samples, 0) AS churn_samples, k.last_churn_observed_at, CASE WHEN t.is_leaf THEN {_TS} ELSE k.updated_at END AS updated_at
      FROM known k FULL JOIN tree t ON {" AND ".join(f"k.{c} = t.{c}" for c in T.BOUNDARIES)}""",
    "given": f"""SELECT c.is_new, {", ".join("c." + c for c in T.BOUNDARIES)}, min_by(d.churn_ewma, (d.a, d.id)) AS e, least(min_by(d.churn_samples, (d.a, d.id)), 2) AS n, min_by(d.last_churn_observed_at, (d.a, d.id)) AS seen
      FROM taken c JOIN (SELECT *, (price_max - price_min) * (surface_max - surface_min) AS a FROM taken WHERE churn_ewma IS NOT NULL) d ON c.portal = d.portal AND c.operation_key = d.operation_key AND c.province_key = d.province_key
        AND d.price_min <= c.price_min AND d.price_max >= c.price_max AND d.surface_min <= c.surface_min AND d.surface_max >= c.surface_max
      WHERE c.status = 'active' AND c.is_leaf AND c.churn_ewma IS NULL AND c.churn_samples = 0 GROUP BY ALL""",
}) + f"""SELECT t.is_new, t.id, {", ".join("t." + c for c in T.BOUNDARIES)}, status, total_count, CASE WHEN n IS NULL THEN churn_ewma ELSE e END AS churn_ewma, coalesce(n, churn_samples) AS churn_samples,
      CASE WHEN n IS NULL THEN last_churn_observed_at ELSE seen END AS last_churn_observed_at, CASE WHEN n IS NULL THEN updated_at ELSE {_TS} END AS updated_at
    FROM taken t LEFT JOIN given g ON {" AND ".join(f"t.{c} = g.{c}" for c in T.BOUNDARIES)}""")  # fmt: skip
_add("monitor_action", lambda s, d: T.latest_two(view(s, d, "segment_snapshots")).groupBy(T.monitor_action(F.col("prev_count"), F.col("current_count")).alias("action")).agg(F.count(F.lit(1)).alias("n")),
     ctes("segment_snapshots", more=_TWO) + "SELECT CASE WHEN prev_count = 0 THEN CASE WHEN current_count > 0 THEN 'full_scan' ELSE 'skip' END WHEN abs(current_count - prev_count) / CAST(prev_count AS DOUBLE) < 0.02e0 THEN 'skip' WHEN abs(current_count - prev_count) / CAST(prev_count AS DOUBLE) < 0.1e0 THEN 'partial_scan' ELSE 'full_scan' END AS action, count(*) AS n FROM pair GROUP BY 1")
_add("monitor_rollup", lambda s, d: T.monitor_rollup(view(s, d, "segments").join(T.latest_two(view(s, d, "segment_snapshots")).select(F.col("segment_id").alias("id"), "current_count"), "id", "left"), "total_count", "current_count"),
     ctes("segments", "segment_snapshots", more={**_TWO, "checked": """SELECT o, n, CASE WHEN n IS NULL THEN NULL WHEN o = 0 THEN CASE WHEN n > 0 THEN 'full_scan' ELSE 'skip' END
       WHEN abs(n - o) / CAST(o AS DOUBLE) < 0.02e0 THEN 'skip' WHEN abs(n - o) / CAST(o AS DOUBLE) < 0.1e0 THEN 'partial_scan' ELSE 'full_scan' END AS action
     FROM (SELECT coalesce(total_count, 0) AS o, current_count AS n FROM segments LEFT JOIN pair ON id = segment_id)"""})
     + """SELECT count(*) AS segments_checked, count(*) FILTER (action = 'skip') AS segments_skipped, count(*) FILTER (action = 'partial_scan') AS segments_partial_scan,
     count(*) FILTER (action = 'full_scan') AS segments_full_scan, count(n) AS snapshots_saved FROM checked""")  # fmt: skip
_add("reason_parse", lambda s, d: view(s, d, "scan_queue").select("id", T.parse_reason(F.col("reason")).alias("batch_id"), T.tier_of_priority(F.col("priority")).alias("tier")), ctes("scan_queue") + "SELECT id, nullif(regexp_extract(reason, '(?:^|;)batch_id=([^;]*)', 1), '') AS batch_id, nullif(regexp_extract(priority, '^refresh_(.*)$', 1), '') AS tier FROM scan_queue")

# --- queue ------------------------------------------------------------------------------------

_RANKSQL = "CASE coalesce(priority, 'normal') " + " ".join(f"WHEN '{p}' THEN {r}" for p, r in K.RANK.items()) + " ELSE 9 END"
_add("queue_pending", lambda s, d: K.pending(view(s, d, "scan_queue"), view(s, d, "segments"), "portal").orderBy("rank", F.asc_nulls_first("completed_at"), "id").limit(100).select("id", "segment_id", "rank", "completed_at"),
     ctes("scan_queue", "segments") + f"SELECT id, segment_id, {_RANKSQL} AS rank, completed_at FROM scan_queue WHERE status = 'pending' AND segment_id IN (SELECT id FROM segments WHERE status = 'active' AND portal = 'portal') ORDER BY rank, completed_at NULLS FIRST, id LIMIT 100")
_add("queue_counts", lambda s, d: K.counts(view(s, d, "scan_queue"), view(s, d, "segments")), ctes("scan_queue", "segments") + "SELECT portal, q.status, coalesce(priority, 'unset') AS priority, count(*) AS n FROM scan_queue q JOIN segments s ON q.segment_id = s.id GROUP BY ALL")
_add("queue_reset_stale", lambda s, d: K.reset_stale(view(s, d, "scan_queue"), _at(NOW)).select("id", "status", "locked_at"), ctes("scan_queue") + f"SELECT id, CASE WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN NOT coalesce(stale, false) THEN locked_at END AS locked_at FROM (SELECT *, status = 'running' AND locked_at < {_TS} - INTERVAL 6 HOUR AS stale FROM scan_queue)")
_OUTCOME = "case segment_id % 6 when 0 then 'started' when 1 then 'complete' when 2 then 'failed' when 3 then 'pending' end"
_add("queue_apply_outcomes", lambda s, d: K.apply_outcomes(view(s, d, "scan_queue"), view(s, d, "scan_queue").select("segment_id", F.expr(_OUTCOME).alias("outcome")).where("outcome is not null"), _at(NOW)).select("id", "status", "attempt_count", "completed_at", "locked_at", "updated_at"),
     ctes("scan_queue") + f"""SELECT id, CASE o WHEN 'started' THEN 'running' WHEN 'complete' THEN 'complete' WHEN 'pending' THEN 'pending' WHEN 'failed' THEN CASE WHEN attempt_count + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status,
    CASE WHEN o = 'failed' THEN attempt_count + 1 ELSE attempt_count END AS attempt_count, CASE WHEN o = 'complete' THEN {_TS} ELSE completed_at END AS completed_at,
    CASE WHEN o = 'started' THEN {_TS} WHEN o IS NULL THEN locked_at END AS locked_at, CASE WHEN o IS NOT NULL THEN {_TS} ELSE updated_at END AS updated_at FROM (SELECT *, {_OUTCOME} AS o FROM scan_queue)""")  # fmt: skip
_add("queue_enqueue_refresh", lambda s, d: K.enqueue_refresh(view(s, d, "scan_queue"), T.select_refresh(due(s, d)), _at(NOW)).select("id", "status", "priority", "attempt_count", "locked_at", "updated_at", "reason"),
     _REFRESH + f"""SELECT q.id, CASE WHEN hit THEN 'pending' ELSE q.status END AS status, CASE WHEN hit THEN 'refresh_' || tier ELSE priority END AS priority, CASE WHEN hit THEN 0 ELSE attempt_count END AS attempt_count, CASE WHEN NOT hit THEN locked_at END AS locked_at,
      CASE WHEN hit THEN {_TS} ELSE updated_at END AS updated_at, CASE WHEN hit THEN printf('refresh:%s;age_hours=%.1f;gap_hours=%.1f', tier, age_hours, gap_hours) || CASE WHEN tier = 'unknown' THEN ';churn_samples=' || churn_samples || ';reason=no_churn_history'
        ELSE ';score=' || score || ';churn_ewma=' || coalesce(CAST(round(churn_ewma, 4) AS VARCHAR), 'None') || ';churn_samples=' || churn_samples || ';count_volatility=' || round(count_volatility, 4) || ';volume=' || total_count END || ';estimated_pages=' || estimated_pages ELSE reason END AS reason
    FROM (SELECT q.*, tier, age_hours, gap_hours, score, churn_ewma, churn_samples, count_volatility, total_count, estimated_pages, coalesce(q.status = 'complete' AND d.segment_id IS NOT NULL, false) AS hit
      FROM scan_queue q LEFT JOIN (SELECT * FROM due WHERE segment_id IN (SELECT taken FROM walk WHERE taken IS NOT NULL)) d ON q.segment_id = d.segment_id) q""")  # fmt: skip
_add("full_scan_select", lambda s, d: T_full(s, d), ctes("segments", "scan_queue", "scan_history", more={
    "u": "SELECT s.id AS segment_id, s.portal, CAST(greatest(ceil(total_count / 20.0e0), 1) AS INT) AS estimated_pages, CASE WHEN s.id IN (SELECT segment_id FROM scan_history WHERE batch_id = 'b1' AND priority = 'normal') THEN 'already_done' WHEN q.status IN ('pending', 'running') THEN 'in_flight' WHEN q.status = 'complete' THEN 'candidate' ELSE 'not_enqueueable' END AS c FROM segments s LEFT JOIN scan_queue q ON q.segment_id = s.id WHERE s.status = 'active' AND is_leaf AND NOT is_oversized AND total_count > 0",
    "candidates": "SELECT * FROM u WHERE c = 'candidate'",
}).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _greedy_sql("candidates", "segment_id", 1500, 1_000_000_000) + "SELECT segment_id, estimated_pages, CASE WHEN c = 'candidate' THEN CASE WHEN segment_id IN (SELECT taken FROM walk WHERE taken IS NOT NULL) THEN 'enqueued' ELSE 'skipped_budget' END ELSE c END AS class FROM u")


def T_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.full_scan_select(view(spark, sf_dir, "segments"), view(spark, sf_dir, "scan_queue"), view(spark, sf_dir, "scan_history"), "b1", "normal")


# --- rollups ----------------------------------------------------------------------------------

_Q, _E = ctes("scan_queue"), ctes("errors")
_add("ops_performance", lambda s, d: O.performance(view(s, d, "scan_queue"), _at(SINCE)), _Q + f"""
    SELECT CAST(sum(listings_found) AS BIGINT) AS urls_discovered, CAST(sum(new_count) AS BIGINT) AS urls_new, CAST(sum(changed_count) AS BIGINT) AS urls_changed, CAST(sum(requests_total) AS BIGINT) AS requests_total, CAST(sum(requests_success) AS BIGINT) AS requests_success,
      CAST(sum(requests_failed) AS BIGINT) AS requests_failed, round(avg(avg_latency_ms), 6) AS avg_latency_ms, max(max_latency_ms) AS max_latency_ms, count(*) FILTER (cooldown_triggered) AS cooldowns,
      CASE WHEN sum(requests_total) > 0 THEN round(sum(requests_success) * 100.0e0 / sum(requests_total), 1) END AS success_rate FROM scan_queue WHERE status = 'complete' AND completed_at >= {_SINCE}""")  # fmt: skip
_add("ops_cooldowns_today", lambda s, d: O.cooldowns_today(view(s, d, "scan_queue"), _at("1998-03-20 17:30:00")), _Q + "SELECT count(*) AS cooldowns_today FROM scan_queue WHERE cooldown_triggered AND completed_at >= TIMESTAMP '1998-03-20 00:00:00'")
_add("ops_errors_by_type", lambda s, d: O.errors_by_type(view(s, d, "errors"), _at("1998-01-01 00:00:00")), _E + "SELECT error_type, count(*) AS n FROM errors WHERE failed_at >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1")
_add("ops_recent_errors", lambda s, d: O.recent_errors(view(s, d, "errors"), 20, 5, error_type="http"), _E + "SELECT * FROM errors WHERE error_type = 'http' ORDER BY id DESC LIMIT 20 OFFSET 5")
_add("http_error_class", lambda s, d: view(s, d, "errors").select("id", *[c.alias(n) for n, c in O.error_class(F.col("http_status")).items()]), _E + "SELECT id, CASE WHEN http_status IS NULL THEN 'timeout_or_connection' ELSE 'http_' || http_status END AS error_class, CASE WHEN http_status IS NULL THEN true WHEN http_status IN (403, 404) THEN false WHEN http_status = 429 THEN true ELSE http_status >= 500 END AS retryable FROM errors")
_add("ops_problem_segments", lambda s, d: O.problem_segments(view(s, d, "scan_queue")).select("id", "segment_id", "updated_at"), _Q + "SELECT id, segment_id, updated_at FROM scan_queue WHERE status = 'failed' ORDER BY updated_at DESC, id LIMIT 10")
_add("ops_daily_trends", lambda s, d: O.daily_trends(view(s, d, "scan_queue"), view(s, d, "errors"), _at(SINCE)), ctes("scan_queue", "errors") + f"""
    SELECT coalesce(q.day, e.day) AS day, urls, avg_latency_ms, errors FROM (SELECT CAST(completed_at AS DATE) AS day, CAST(sum(listings_found) AS BIGINT) AS urls, round(avg(avg_latency_ms), 1) AS avg_latency_ms FROM scan_queue WHERE status = 'complete' AND completed_at >= {_SINCE} GROUP BY 1) q
    FULL JOIN (SELECT CAST(failed_at AS DATE) AS day, count(*) AS errors FROM errors WHERE failed_at >= {_SINCE} GROUP BY 1) e ON q.day = e.day""")  # fmt: skip
_add("ops_pipeline_tables", lambda s, d: O.table_totals(entities(s, d), view(s, d, "snapshots"), M.pending_ids(entities(s, d), _built(s, d))), ctes("listings", "snapshots") + f"SELECT 'listings' AS name, count(*) AS n FROM listings UNION ALL SELECT 'snapshots', count(*) FROM snapshots UNION ALL SELECT 'pending', count(*) FROM ({_PENDING})")
_add("ops_segment_totals", lambda s, d: O.segment_totals(view(s, d, "segments")), ctes("segments") + "SELECT count(*) AS total, count(*) FILTER (is_leaf) AS leaves, count(*) FILTER (is_oversized) AS oversized FROM segments WHERE status = 'active'")
_add("ops_progress", lambda s, d: O.progress(view(s, d, "scan_queue")), _Q + "SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS complete, round(count(*) FILTER (status = 'complete') * 100.0e0 / nullif(count(*), 0), 1) AS progress_pct FROM scan_queue")
_R = ctes("runs")
_add("ops_last_run", lambda s, d: O.last_runs(view(s, d, "runs")), _R + "SELECT run_type, max(id) AS id, max_by(status, id) AS status, max_by(finished_at, id) AS finished_at FROM runs WHERE status IN ('success', 'failed', 'partial') GROUP BY 1")
_add("ops_run_duration", lambda s, d: O.run_durations(O.fail_unfinished(view(s, d, "runs"), _at(NOW))), _R + f"""
    SELECT *, (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0e0 AS duration_seconds
    FROM (SELECT * EXCLUDE (stale) REPLACE (CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN {_TS} ELSE finished_at END AS finished_at) FROM (SELECT *, status IN ('running', 'stopping', 'force_stopping') AS stale FROM runs))""")  # fmt: skip
_add("ops_request_metrics", lambda s, d: O.request_metrics(view(s, d, "requests")), ctes("requests") + """SELECT segment_id, count(*) AS requests_total, count(*) FILTER (http_status = 200) AS requests_success, count(*) FILTER (http_status IS NULL OR http_status <> 200) AS requests_failed,
    count(*) FILTER (http_status = 403) AS requests_403, count(*) FILTER (http_status = 429) AS requests_429, count(*) FILTER (http_status >= 500) AS requests_5xx, count(*) FILTER (http_status IS NULL) AS timeouts,
    round(avg(latency_ms), 1) AS avg_latency_ms, round(max(latency_ms), 1) AS max_latency_ms FROM requests GROUP BY 1""")  # fmt: skip
_BATCH = "SELECT batch_id, count(*) AS processed, count(*) FILTER (listings_found <> 0) AS successful, count(*) FILTER (listings_found = 0) AS failed, coalesce(round(count(*) FILTER (listings_found = 0) * 100.0e0 / nullif(count(*), 0), 2), 0) AS error_rate_pct FROM scan_history GROUP BY 1"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.batch_summary(view(spark, sf_dir, "scan_history"), "batch_id", F.col("listings_found") == 0)


_add("batch_run_summary", batches, ctes("scan_history") + _BATCH)
_add("error_rate_alert", lambda s, d: O.alerts(batches(s, d), 5.0), ctes("scan_history", more={"b": _BATCH}) + "SELECT * FROM b WHERE error_rate_pct >= 5")
_add("ops_top_errors", lambda s, d: O.top_errors(view(s, d, "errors"), 3), _E + "SELECT error_type, count(*) AS n FROM errors GROUP BY 1 ORDER BY n DESC, error_type LIMIT 3")
_add("ops_active_runs", lambda s, d: O.active_runs(view(s, d, "runs")), _R + "SELECT * FROM runs WHERE status IN ('running', 'stopping', 'force_stopping')")
_add("ops_recent_runs", lambda s, d: O.recent_runs(view(s, d, "runs"), "facts", 15, 5, 1), _R + "SELECT * FROM runs WHERE run_type = 'facts' AND source_id = 1 ORDER BY id DESC LIMIT 15 OFFSET 5")
_add("listings_page", lambda s, d: O.listings_page(view(s, d, "listings").select("id", "source_id", "status", "title", "last_seen_at"), "active", 25, 3, 2), ctes("listings") + "SELECT id, source_id, status, title, last_seen_at FROM listings WHERE status = 'active' AND source_id = 2 ORDER BY id DESC LIMIT 25 OFFSET 3")
_add("listing_snapshots", lambda s, d: O.snapshots_of(view(s, d, "snapshots"), 7, None), ctes("snapshots") + "SELECT * FROM snapshots WHERE listing_id = 7")


def _run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the scan batches, written twice by the same runs and read back."""
    made = O.run_records(view(spark, sf_dir, "scan_history"), "batch_id", F.col("listings_found") == 0, F.concat(F.lit("empty_"), "priority"), _at("1999-01-01 00:00:00"), _at("1999-01-01 01:00:00"))
    out = VersionedTable(spark, f"{shared_root(spark)}/parcela/runs-{uuid.uuid4().hex}", made.schema, ["run_id"], 4)
    O.append_run_records(out, made)
    O.append_run_records(out, made)
    return out.read()


_add("run_records", _run_records, ctes("scan_history", more={
    "kinds": "SELECT batch_id, 'empty_' || priority AS error, count(*) AS n FROM scan_history WHERE listings_found = 0 GROUP BY ALL", "tops": "SELECT batch_id, string_agg(error || ': ' || n, ', ' ORDER BY n DESC, error) AS t FROM kinds GROUP BY 1",
    "sums": "SELECT batch_id, count(*) AS n, count(*) FILTER (listings_found = 0) AS f FROM scan_history GROUP BY 1",
}) + """SELECT s.batch_id AS run_id, CASE WHEN f = n THEN 'failed' WHEN f > 0 THEN 'partial' ELSE 'success' END AS status, n AS processed, n - f AS successful, f AS failed, round(f * 100.0e0 / n, 2) AS error_rate_pct, coalesce(t, '') AS top_errors,
      TIMESTAMP '1999-01-01 00:00:00' AS started_at, TIMESTAMP '1999-01-01 01:00:00' AS finished_at, 3600.0e0 AS elapsed_seconds, round(n / 60.0e0, 1) AS avg_rate_per_min FROM sums s LEFT JOIN tops USING (batch_id)""")  # fmt: skip
_add("latest_snapshot", lambda s, d: O.latest_snapshot(view(s, d, "snapshots")), ctes("snapshots") + "SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY captured_at DESC, id DESC, price_amount DESC) = 1")

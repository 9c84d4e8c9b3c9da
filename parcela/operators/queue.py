"""Scan queue: priorities, state transitions and enqueueing, as set-wise updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import take_within_budget

# The order of priorities; no priority counts as normal, an unknown one comes last.
RANK = {"high": 1, "refresh_hot": 2, "full_scan_compare": 3, "full_scan_baseline": 4, "normal": 5, "refresh_unknown": 6, "refresh_warm": 7, "refresh_cold": 8}
MAX_ATTEMPTS = 3


def priority_rank(priority: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(priority, F.lit("normal"))), F.lit(9))


def pending(queue: DataFrame, segments: DataFrame, portal: str | None = None) -> DataFrame:
    """Pending rows of active segments, of one portal or of all, with their rank; the caller orders by ``rank, completed_at nulls first, id``."""
    of = F.lit(True) if portal is None else F.col("portal") == portal
    active = segments.where((F.col("status") == "active") & of).select(F.col("id").alias("segment_id"))
    return queue.where(F.col("status") == "pending").join(active, "segment_id", "left_semi").withColumn("rank", priority_rank(F.col("priority")))


def counts(queue: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows by portal, status and priority; no priority shows as ``unset``."""
    portal = segments.select(F.col("id").alias("segment_id"), "portal")
    return queue.join(portal, "segment_id").groupBy("portal", "status", F.coalesce("priority", F.lit("unset")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def reset_stale(queue: DataFrame, now: Column, hours: int | None = 6) -> DataFrame:
    """Running rows that were locked too long ago (all of them with None) are pending again."""
    stale = F.col("status") == "running"
    if hours is not None:
        stale = stale & (F.col("locked_at") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return queue.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "locked_at": F.when(~F.coalesce(stale, F.lit(False)), F.col("locked_at"))})


# What a finished scan reports, with what stands where it does not.
COUNTERS = {
    "pages_scanned": 0, "listings_found": 0, "new_count": 0, "changed_count": 0, "requests_total": 0, "requests_success": 0, "requests_failed": 0, "requests_403": 0, "requests_429": 0, "requests_5xx": 0,
    "timeouts": 0, "avg_latency_ms": None, "max_latency_ms": None, "cooldown_triggered": False,
}


def apply_outcomes(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Rows with an outcome (``segment_id, outcome``: started, complete, pending or failed) change state; a third failure is final.

    A start sets ``started_at``, a finished scan the counters that the queue has, and one that goes
    back its ``last_error`` if it brings one. ``outcomes`` has a segment once.
    """
    brought = [c for c in (*COUNTERS, "last_error") if c in outcomes.columns]
    rows = queue.join(outcomes.select("segment_id", "outcome", *[F.col(c).alias(f"__{c}") for c in brought]), "segment_id", "left")
    o, tries = F.col("outcome"), F.col("attempt_count") + 1
    status = F.when(o == "started", "running").when(o == "complete", "complete").when(o == "pending", "pending").when(o == "failed", F.when(tries >= MAX_ATTEMPTS, "failed").otherwise("pending")).otherwise(F.col("status"))
    changed = {
        "status": status, "attempt_count": F.when(o == "failed", tries).otherwise(F.col("attempt_count")), "completed_at": F.when(o == "complete", now).otherwise(F.col("completed_at")),
        "locked_at": F.when(o == "started", now).when(o.isNull(), F.col("locked_at")), "updated_at": F.when(o.isNotNull(), now).otherwise(F.col("updated_at")),
    }
    for c, none in COUNTERS.items():
        if c in queue.columns:
            changed[c] = F.when(o == "complete", F.coalesce(F.col(f"__{c}") if c in brought else F.lit(None), F.lit(none)).cast(queue.schema[c].dataType)).otherwise(F.col(c))
    if "started_at" in queue.columns:
        changed["started_at"] = F.when(o == "started", now).otherwise(F.col("started_at"))
    if {"last_error"} <= {*queue.columns} & {*brought}:
        changed["last_error"] = F.when(o.isin("pending", "failed"), F.coalesce("__last_error", "last_error")).otherwise(F.col("last_error"))
    return rows.withColumns(changed).drop("outcome", *[f"__{c}" for c in brought])


def refresh_reason() -> Column:
    """Why a segment is refreshed: with churn figures, or that it has none."""
    base = F.format_string("refresh:%s;age_hours=%.1f;gap_hours=%.1f", "tier", "age_hours", "gap_hours")
    number = lambda c: F.coalesce(F.round(F.col(c).cast("double"), 4).cast("string"), F.lit("None"))
    known = F.concat(
        base, F.lit(";score="), number("score"), F.lit(";churn_ewma="), number("churn_ewma"), F.lit(";churn_samples="), F.col("churn_samples").cast("string"), F.lit(";count_volatility="), number("count_volatility"),
        F.lit(";volume="), F.col("total_count").cast("string"), F.lit(";estimated_pages="), F.col("estimated_pages").cast("string"),
    )
    none = F.concat(base, F.lit(";churn_samples="), F.col("churn_samples").cast("string"), F.lit(";reason=no_churn_history;estimated_pages="), F.col("estimated_pages").cast("string"))
    return F.when(F.col("tier") == "unknown", none).otherwise(known)


def enqueue_refresh(queue: DataFrame, selected: DataFrame, now: Column) -> DataFrame:
    """Finished rows of the selected segments are pending again now, with priority ``refresh_<tier>``, a reason (numbers at four digits) and no attempts."""
    s = selected.select("segment_id", F.concat(F.lit("refresh_"), "tier").alias("__priority"), refresh_reason().alias("__reason"))
    rows = queue.join(s, "segment_id", "left")
    hit = F.col("__priority").isNotNull() & (F.col("status") == "complete")
    return rows.withColumns({
        "priority": F.when(hit, F.col("__priority")).otherwise(F.col("priority")), "reason": F.when(hit, F.col("__reason")).otherwise(F.col("reason")),
        "attempt_count": F.when(hit, 0).otherwise(F.col("attempt_count")), "locked_at": F.when(~hit, F.col("locked_at")), "status": F.when(hit, "pending").otherwise(F.col("status")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).drop("__priority", "__reason")


def full_scan_select(segments: DataFrame, queue: DataFrame, history: DataFrame, batch_id: str, priority: str, max_pages: int = 1500, page_size: int = 20) -> DataFrame:
    """Every segment of the universe with its class: done, in flight, not enqueueable, enqueued, or over the budget."""
    universe = segments.where((F.col("status") == "active") & F.col("is_leaf") & ~F.col("is_oversized") & (F.col("total_count") > 0)).select(F.col("id").alias("segment_id"), "portal", "total_count")
    done = history.where((F.col("batch_id") == batch_id) & (F.col("priority") == priority)).select("segment_id").distinct().withColumn("__done", F.lit(True))
    q = queue.select("segment_id", F.col("status").alias("__status"))
    rows = universe.join(done, "segment_id", "left").join(q, "segment_id", "left").withColumn("estimated_pages", F.greatest(F.ceil(F.col("total_count") / page_size), F.lit(1)).cast("int"))
    kind = F.when(F.col("__done"), "already_done").when(F.col("__status").isin("pending", "running"), "in_flight").when(F.col("__status") == "complete", "candidate").otherwise("not_enqueueable")
    rows = rows.withColumn("class", kind)
    taken = take_within_budget(rows.where(F.col("class") == "candidate"), "portal", [F.col("segment_id")], max_pages, None).select("segment_id", F.lit(True).alias("__taken"))
    out = rows.join(taken, "segment_id", "left")
    return out.select("segment_id", "estimated_pages", F.when(F.col("class") == "candidate", F.when(F.col("__taken"), "enqueued").otherwise("skipped_budget")).otherwise(F.col("class")).alias("class"))

"""Operational rollups over runs, errors, queue rows and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import VersionedTable


def performance(queue: DataFrame, since: Column) -> DataFrame:
    """Sums over the rows completed since a time: listings found, new and changed, requests, mean and largest latency, cooldowns, and the success rate in percent (null without requests)."""
    total, success = F.sum("requests_total"), F.sum("requests_success")
    done = queue.where((F.col("status") == "complete") & (F.col("completed_at") >= since))
    return done.agg(
        F.sum("listings_found").alias("urls_discovered"), F.sum("new_count").alias("urls_new"), F.sum("changed_count").alias("urls_changed"), total.alias("requests_total"), success.alias("requests_success"),
        F.sum("requests_failed").alias("requests_failed"), F.round(F.avg("avg_latency_ms"), 6).alias("avg_latency_ms"), F.max("max_latency_ms").alias("max_latency_ms"), F.count_if("cooldown_triggered").alias("cooldowns"),
        F.round(F.coalesce(success, F.lit(0)) * 100.0 / F.nullif(total, F.lit(0)), 1).alias("success_rate"),
    )


def cooldowns_today(queue: DataFrame, now: Column) -> DataFrame:
    """Rows with a cooldown that were completed since midnight, whatever their state."""
    return queue.where(F.col("cooldown_triggered") & (F.col("completed_at") >= F.date_trunc("day", now))).agg(F.count(F.lit(1)).alias("cooldowns_today"))


def errors_by_type(errors: DataFrame, since: Column) -> DataFrame:
    return errors.where(F.col("failed_at") >= since).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def recent_errors(errors: DataFrame, limit: int, offset: int = 0, **equal) -> DataFrame:
    """The latest errors by id, filtered by the given columns."""
    for name, value in equal.items():
        errors = errors.where(F.col(name) == value)
    return errors.orderBy(F.desc("id")).offset(offset).limit(limit)


def error_class(status: Column) -> dict[str, Column]:
    """``error_class, retryable`` of a response status; no response counts as a lost connection."""
    kind = F.when(status.isNull(), "timeout_or_connection").otherwise(F.concat(F.lit("http_"), status.cast("string")))
    return {"error_class": kind, "retryable": F.when(status.isNull(), True).when(status.isin(403, 404), False).when(status == 429, True).otherwise(status >= 500)}


def problem_segments(queue: DataFrame, limit: int = 10) -> DataFrame:
    """Failed rows, the latest first."""
    return queue.where(F.col("status") == "failed").orderBy(F.desc("updated_at"), "id").limit(limit)


def daily_trends(queue: DataFrame, errors: DataFrame, since: Column) -> DataFrame:
    """A row a day with anything: listings found and mean latency (one digit) of the rows completed, and errors; null where a day has none of a kind."""
    done = queue.where((F.col("status") == "complete") & (F.col("completed_at") >= since)).groupBy(F.to_date("completed_at").alias("day"))
    found = done.agg(F.sum("listings_found").alias("urls"), F.round(F.avg("avg_latency_ms"), 1).alias("avg_latency_ms"))
    failed = errors.where(F.col("failed_at") >= since).groupBy(F.to_date("failed_at").alias("day")).agg(F.count(F.lit(1)).alias("errors"))
    return found.join(failed, "day", "full_outer")


def segment_totals(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("status") == "active").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_leaf").alias("leaves"), F.count_if("is_oversized").alias("oversized"))


def progress(queue: DataFrame) -> DataFrame:
    """Finished share of the queue in percent, null if it is empty."""
    n, done = F.count(F.lit(1)), F.count_if(F.col("status") == "complete")
    return queue.agg(n.alias("total"), done.alias("complete"), F.round(done * 100.0 / F.nullif(n, F.lit(0)), 1).alias("progress_pct"))


def last_runs(runs: DataFrame) -> DataFrame:
    """The last finished run of each type."""
    return runs.where(F.col("status").isin("success", "failed", "partial")).groupBy("run_type").agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"), F.max_by("finished_at", "id").alias("finished_at"))


#: States of a run that has not ended.
UNFINISHED = ("running", "stopping", "force_stopping")


def active_runs(runs: DataFrame) -> DataFrame:
    """Runs that have not ended, the newest id first; the first is the active one."""
    return runs.where(F.col("status").isin(*UNFINISHED)).orderBy(F.desc("id"))


def recent_runs(runs: DataFrame, run_type: str | None = None, limit: int = 20, offset: int = 0, source_id: int | None = None) -> DataFrame:
    """The last runs by id, of one type and source or of all."""
    kept = runs.where(F.col("run_type") == run_type) if run_type else runs
    kept = kept.where(F.col("source_id") == source_id) if source_id is not None else kept
    return kept.orderBy(F.desc("id")).offset(offset).limit(limit)


def listings_page(entities: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0, source_id: int | None = None) -> DataFrame:
    """A page of listings, the newest id first, of one source and state or of all."""
    kept = entities.where(F.col("status") == status) if status else entities
    kept = kept.where(F.col("source_id") == source_id) if source_id is not None else kept
    return kept.orderBy(F.desc("id")).offset(offset).limit(limit)


def snapshots_of(snapshots: DataFrame, listing_id: int, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """A page of a listing's history, the latest capture first; its whole history from ``offset`` without a limit."""
    rows = snapshots.where(F.col("listing_id") == listing_id).orderBy(F.desc("captured_at"), F.desc("id")).offset(offset)
    return rows if limit is None else rows.limit(limit)


def run_records(items: DataFrame, group: str, failed: Column, error: Column, started: Column, finished: Column, n_top: int = 5) -> DataFrame:
    """A run record for each batch: its numbers, the most frequent errors of its failures (by count, then name), seconds and items a minute."""
    seconds = (F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / F.lit(1_000_000.0)
    kinds = items.where(failed & error.isNotNull()).groupBy(group, error.alias("error")).agg(F.count(F.lit(1)).alias("n"))
    ranked = kinds.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "error"))).where(F.col("k") <= n_top)
    top = ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "error", "n"))), lambda x: F.concat(x["error"], F.lit(": "), x["n"].cast("string"))), ", ").alias("top_errors"))
    status = F.when((F.col("processed") > 0) & (F.col("failed") == F.col("processed")), "failed").when(F.col("failed") > 0, "partial").otherwise("success")
    return batch_summary(items, group, failed).join(top, group, "left").select(
        F.col(group).alias("run_id"), status.alias("status"), "processed", "successful", "failed", "error_rate_pct", F.coalesce("top_errors", F.lit("")).alias("top_errors"), started.alias("started_at"), finished.alias("finished_at"),
        F.round(seconds, 1).alias("elapsed_seconds"), F.round(F.col("processed") * 60.0 / F.nullif(seconds, F.lit(0.0)), 1).alias("avg_rate_per_min"),
    )


def append_run_records(table: VersionedTable, records: DataFrame) -> int:
    """Add run records to their table, a run once however often it reports, and return the version."""
    return table.append_new(records)


def run_durations(runs: DataFrame) -> DataFrame:
    """Seconds that each run took from start to end; null for one that has not ended."""
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(1_000_000.0)
    return runs.withColumn("duration_seconds", seconds)


def fail_unfinished(runs: DataFrame, now: Column) -> DataFrame:
    """The runs at a new start: those that have not ended failed now, however long ago they began."""
    stale = F.col("status").isin(*UNFINISHED)
    return runs.withColumns({"finished_at": F.when(stale, now).otherwise(F.col("finished_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def request_metrics(requests: DataFrame) -> DataFrame:
    """Requests of each segment by outcome, with mean and largest latency; a request without a response has none."""
    s = F.col("http_status")
    return requests.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("requests_total"), F.count_if(s == 200).alias("requests_success"), F.count_if(s.isNull() | (s != 200)).alias("requests_failed"), F.count_if(s == 403).alias("requests_403"),
        F.count_if(s == 429).alias("requests_429"), F.count_if(s >= 500).alias("requests_5xx"), F.count_if(s.isNull()).alias("timeouts"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"), F.round(F.max("latency_ms"), 1).alias("max_latency_ms"),
    )


def batch_summary(items: DataFrame, group: str, failed: Column) -> DataFrame:
    """Items, successes and failures of each batch, with the failure rate in percent, 0 for none."""
    n, bad = F.count(F.lit(1)), F.count_if(failed)
    return items.groupBy(group).agg(n.alias("processed"), (n - bad).alias("successful"), bad.alias("failed"), F.coalesce(F.round(bad * 100.0 / F.nullif(n, F.lit(0)), 2), F.lit(0.0)).alias("error_rate_pct"))


def top_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_type").limit(n)


def alerts(summary: DataFrame, threshold_pct: float = 20.0) -> DataFrame:
    """Batches whose failure rate reaches the threshold."""
    return summary.where(F.col("error_rate_pct") >= threshold_pct)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each listing."""
    w = Window.partitionBy("listing_id").orderBy(F.desc("captured_at"), F.desc("id"), F.desc("price_amount"))
    return snapshots.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def table_totals(entities: DataFrame, snapshots: DataFrame, pending: DataFrame) -> DataFrame:
    """Row counts of the tables and of what waits for a build, one row a table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("listings", entities), ("snapshots", snapshots), ("pending", pending))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

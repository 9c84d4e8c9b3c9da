"""Queries that run the streaming jobs over the given tables, and the SQL of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as M
from ..operators import segments as T
from ..operators.lifecycle import KEYS
from ..session import shared_root
from ..sources.versions import VersionedTable
from ..streaming import jobs as J
from .changes import MERGED, _now
from .changes import ORACLE as CHANGES
from .market import _HISTORY_SQL
from .scanning import _OUT
from .views import ctes, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def _final(stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """The last state of what a stream wrote: with a key (update mode) each key's row of its last batch, else all rows of the last batch that had any."""
    out = J.drain(stream, mode)
    if key:
        return out.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch_id").alias("last")).select("last.*")
    last = out.agg(F.max("batch_id").alias("b")).first()["b"]
    return out.where(F.col("batch_id") == F.lit(last)).drop("batch_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stream_table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame, column: str) -> DataFrame:
    """A time without a zone again, as UTC."""
    return df.withColumn(column, F.to_utc_timestamp(column, F.current_timezone()).cast("timestamp_ntz"))


_add("stream_daily_trends", lambda s, d: _plain(_final(J.daily_trends(_events(s, d), "at", "value"), "complete"), "day"), "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
_add("stream_error_windows", lambda s, d: _plain(_final(J.error_windows(_events(s, d).where("event_type = 'error'"), "at", 2), "complete"), "hour"), "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2")
_add("stream_rolling_errors", lambda s, d: _plain(_final(J.rolling_errors(_events(s, d).where("event_type = 'error'"), "at", "event_type"), "complete"), "until"),
     "SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') + k * INTERVAL 5 MINUTE AS until, event_type, count(*) AS n FROM events, range(1, 13) t(k) WHERE event_type = 'error' GROUP BY ALL")
_add("stream_dedupe", lambda s, d: J.drain(J.distinct_postings(_events(s, d), "at", ["user_id", "event_type"], "36500 days"), "append").select("user_id", "event_type"), "SELECT DISTINCT user_id, event_type FROM events")


def stream_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of scans come as a stream of a written table."""
    path = f"{shared_root(spark)}/parcela/outcomes-{uuid.uuid4().hex}"
    T.scan_outcomes(view(spark, sf_dir, "scan_history")).select("segment_id", "id", "scanned_at", "churn").write.parquet(path)
    out = _final(J.churn_ewma(spark.readStream.schema("segment_id long, id long, scanned_at timestamp_ntz, churn double").parquet(path)), "update", "segment_id")
    return out.withColumn("churn_ewma", F.round("churn_ewma", 6))


_add("stream_churn_ewma", stream_churn, ctes("scan_history", more=_OUT) + "SELECT segment_id, round(list_reduce(list(churn ORDER BY scanned_at, id), lambda a, x: 0.5e0 * x + 0.5e0 * a), 6) AS churn_ewma, CAST(count(*) AS INT) AS churn_samples FROM outcomes WHERE churn IS NOT NULL GROUP BY 1")


def stream_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.stream_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("listing_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("captured_at"),
        F.col("l_extendedprice").alias("price"), F.when(F.col("l_returnflag") == "R", "ARS").otherwise("USD").alias("price_currency"),
    )
    return _final(J.price_history(rows), "update", "listing_id")


_add("stream_price_history", stream_prices, ctes("snapshots") + """SELECT listing_id, min_by(p, (captured_at, id, p)) AS initial_price, max_by(p, (captured_at, id, p)) AS last_price, min(p) AS min_price, max(p) AS max_price,
    CAST(count(*) FILTER (prev IS NOT NULL AND p <> prev) AS INT) AS price_change_count, CAST(0 AS INT) AS n_late
    FROM (SELECT *, CAST(price_amount AS DOUBLE) AS p, lag(CAST(price_amount AS DOUBLE)) OVER (PARTITION BY listing_id ORDER BY captured_at, id, price_amount) AS prev FROM snapshots WHERE price_currency = 'USD') GROUP BY 1""")  # fmt: skip


def _deal(rows: DataFrame, part: Column, path: str, n: int = 3) -> DataFrame:
    """The rows as a stream that gets them in about ``n`` batches, written part by part, each by all tasks that read it."""
    spark = rows.sparkSession
    for k in range(n):
        rows.where(part == k).write.mode("append").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())  # names only
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // n)).parquet(path)


def _buckets(rows: DataFrame, a_bucket: int = 500_000) -> int:
    """So many buckets that one of them, which is one task of a merge, does not grow with the table; at least 8. The count is read from the files' footers."""
    return max(8, -(-rows.count() // a_bucket))


def stream_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price histories after the snapshots came in three parts, dealt by id, so that most listings get late ones."""
    root = f"{shared_root(spark)}/parcela/histories-{uuid.uuid4().hex}"
    rows = view(spark, sf_dir, "snapshots")
    stream = _deal(rows, F.pmod("id", F.lit(3)), f"{root}/in")
    states = VersionedTable(spark, f"{root}/states", M.history_state(rows).schema, ["listing_id"], _buckets(rows))
    J.merge_histories(stream, states, f"{root}/kept", f"{root}/checkpoint").awaitTermination()
    return M.history_of(states.read())


_add("stream_price_states", stream_histories, ctes("snapshots", more={"history": _HISTORY_SQL}) + "SELECT * FROM history")


def _in_files(spark: SparkSession, rows: DataFrame, by: str, n: int = 3) -> DataFrame:
    """The rows as a stream that gets them in about ``n`` batches, dealt by a hash of a column."""
    return _deal(rows, F.pmod(F.xxhash64(by), F.lit(n)), f"{shared_root(spark)}/parcela/dealt-{uuid.uuid4().hex}", n)


def stream_recycled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages before a recycled one, where pages come in any order."""
    return J.kept_pages(J.drain(J.page_deltas(_in_files(spark, view(spark, sf_dir, "pages_seen"), "page")), "update"))


def stream_empty_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages up to a run of empty ones, where pages come in any order."""
    return J.pages_read(J.drain(J.page_results(_in_files(spark, view(spark, sf_dir, "catalog_pages"), "page")), "update"))


_add("stream_recycled_pages", stream_recycled, CHANGES["recycled_pages"])
_add("stream_empty_streak", stream_empty_streak, CHANGES["empty_streak_cut"])


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table after a stream of postings has been merged into it."""
    root = f"{shared_root(spark)}/parcela/lifecycle-{uuid.uuid4().hex}"
    known = view(spark, sf_dir, "current_entities").withColumn("content_hash", F.lit(None).cast("string"))
    current = VersionedTable(spark, f"{root}/current", known.schema, list(KEYS), _buckets(known, 100_000))
    current.merge(known, lambda _, rows: rows)
    view(spark, sf_dir, "incoming").write.parquet(f"{root}/incoming")
    incoming = spark.readStream.schema(view(spark, sf_dir, "incoming").schema).parquet(f"{root}/incoming")
    J.merge_batches(incoming, current, f"{root}/snapshots", f"{root}/checkpoint", _now()).awaitTermination()
    return current.read()


_add("stream_lifecycle_merge", stream_lifecycle, MERGED)

"""Streaming forms of the polling work: merges a micro-batch at a time, windows, and keyed state.

Every job takes a streaming DataFrame; the same functions as in the batch operators do the work
where they can. Stateful jobs keep one small record a key.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import lifecycle as L
from ..operators.facts import advance_history
from ..session import shared_root, ship_package
from ..sources.versions import VersionedTable


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema)
    if any(f.endswith(f"/{name}.parquet") for f in batch.inputFiles()):  # one file: streams read folders
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and return what it wrote, with the number of its batch in ``batch_id``.

    Batches are written to a folder each, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    root = f"{shared_root(spark)}/parcela/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema, StructField("batch_id", LongType())])).option("basePath", f"{root}/out").parquet(f"{root}/out")


def merge_batches(incoming: DataFrame, current: VersionedTable, snapshot_path: str, checkpoint: str, now) -> Any:
    """Start the lifecycle merge of a stream of postings into a versioned table with the keys of a listing.

    A batch rewrites only the buckets that its keys fall into, and its snapshots go into a folder of
    its own before the version is made. The version carries the batch's number, so a batch that is run
    again, before or after its version was made, leaves the same tables.
    """

    def merge(batch: DataFrame, n: int) -> None:
        held = batch.persist()

        def history(known: DataFrame, rows: DataFrame) -> None:
            L.snapshots(L.classify(known, rows), now).write.mode("overwrite").parquet(f"{snapshot_path}/batch={n}")

        current.merge(held, lambda known, rows: L.merge(known, rows, now), mark=n, also=history)
        held.unpersist()

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_histories(snapshots: DataFrame, states: VersionedTable, kept_path: str, checkpoint: str) -> Any:
    """Start keeping the mergeable price history of each listing over a stream of snapshots, in a versioned table by listing.

    A batch's snapshots are kept first, in a folder of its own. Prices that follow the known ones are
    merged into the history; a listing that gets one from before is built again from all that is kept,
    for it alone. So the table equals the batch form whatever the order of arrival.
    """

    def merge(batch: DataFrame, n: int) -> None:
        held = batch.persist()

        def keep(_: DataFrame, rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(f"{kept_path}/batch={n}")

        def advance(known: DataFrame, rows: DataFrame) -> DataFrame:
            return advance_history(known, rows, batch.sparkSession.read.parquet(kept_path).drop("batch"))

        states.merge(held, advance, mark=n, also=keep)
        held.unpersist()

    return snapshots.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_postings(stream: DataFrame, time: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark; its state is dropped after that."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def page_deltas(seen: DataFrame, time: str | None = None, hours: int = 24, parts: int = 8) -> DataFrame:
    """Changes to ``operators.lifecycle.page_counts`` after each batch of ``segment, page, item``: ``segment, page, new_items, n_items`` to add up.

    State is kept a segment and part of its items, so a segment that holds most rows is ``parts`` keys. It
    knows the pages of each item: a repeated row changes nothing, and an item that turns up on an earlier
    page than before is taken off the later one, so the sums are right in any order of arrival. With
    ``time``, a part that gets no rows for ``hours`` is dropped, and the segment's next rows are a new
    scan. Rows without a page or an item take no part, with ``time`` those without one neither.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = dict.fromkeys(zip(*state.get)) if state.exists else {}  # pairs, in order of arrival
        first: dict[str, int] = {}
        for name, page in known:
            first[name] = min(page, first.get(name, page))
        new, shown, last = Counter(), Counter(), None
        for rows in frames:
            if time is not None:
                latest = rows["__at"].max()
                last = latest if last is None else max(last, latest)
            for pair in zip(rows["item"].tolist(), rows["page"].tolist()):
                if pair in known:
                    continue
                known[pair] = None
                name, page = pair
                shown[page] += 1
                before = first.get(name)
                if before is None or page < before:
                    new[page] += 1
                    first[name] = page
                    if before is not None:
                        new[before] -= 1
        state.update(([x for x, _ in known], [p for _, p in known]))
        if time is not None:
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        if shown:
            pages = sorted({*new, *shown})
            yield pd.DataFrame({"segment": key[0], "page": pages, "new_items": [new[p] for p in pages], "n_items": [shown[p] for p in pages]})

    item = F.col("item").cast("string")
    rows = seen.where(F.col("page").isNotNull() & F.col("item").isNotNull())
    rows = rows.select("segment", F.pmod(F.xxhash64(item), F.lit(parts)).alias("__part"), item.alias("item"), F.col("page").cast("long").alias("page"), *([F.col(time).cast("timestamp").alias("__at")] if time else []))
    if time:
        rows = rows.where(F.col("__at").isNotNull()).withWatermark("__at", "1 minute")
    ship_package(seen.sparkSession)
    kind = seen.schema["segment"].dataType.simpleString()
    limit = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return rows.groupBy("segment", "__part").applyInPandasWithState(step, f"segment {kind}, page long, new_items long, n_items long", "items array<string>, pages array<long>", "update", limit)


def kept_pages(deltas: DataFrame) -> DataFrame:
    """The pages before a segment's first recycled one, of all changes written so far: ``lifecycle.kept_pages`` of the same rows."""
    return L.before_recycled(deltas.groupBy("segment", "page").agg(F.sum("new_items").alias("new_items"), F.sum("n_items").alias("n_items")))


def page_results(stream: DataFrame, width: int = 1000) -> DataFrame:
    """The distinct results by page of each catalog and range of ``width`` page numbers, after each batch: ``catalog, range, results``.

    A range is one small record of state, however long its catalog.
    """
    at = F.floor(F.col("page") / F.lit(width)).alias("range")
    return stream.groupBy("catalog", at).agg(F.array_sort(F.collect_set(F.struct("page", "result"))).alias("results"))


def pages_read(ranges: DataFrame, streak: int = 3) -> DataFrame:
    """``lifecycle.before_empty_streak`` of the last record of each range; ``ranges`` is what ``page_results`` wrote, with ``batch_id``."""
    last = ranges.groupBy("catalog", "range").agg(F.max_by("results", "batch_id").alias("results"))
    return L.before_empty_streak(last.select("catalog", F.inline("results")), streak)


def daily_trends(stream: DataFrame, time: str, value: str, delay: str = "1 day") -> DataFrame:
    """Rows and mean value a day."""
    day = F.window(time, "1 day")
    return stream.withWatermark(time, delay).groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("avg_value")).select(F.col("window.start").alias("day"), "n", "avg_value")


def error_windows(stream: DataFrame, time: str, least: int = 10, delay: str = "1 hour") -> DataFrame:
    """Hours with at least ``least`` errors."""
    hour = F.window(time, "1 hour")
    return stream.withWatermark(time, delay).groupBy(hour).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("window.start").alias("hour"), "n")


def rolling_errors(stream: DataFrame, time: str, kind: str, delay: str = "1 hour") -> DataFrame:
    """Errors of each kind in the hour that ends at every fifth minute."""
    span = F.window(time, "1 hour", "5 minutes")
    return stream.withWatermark(time, delay).groupBy(span, kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("until"), kind, "n")


def _keyed(stream: DataFrame, key: str, step: Callable, out: str, state: str, timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    ship_package(stream.sparkSession)
    return stream.groupBy(key).applyInPandasWithState(step, out, state, "update", timeout)


def churn_ewma(outcomes: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``segment_id, churn_ewma, churn_samples`` after each batch; scans older than the last one seen are ignored."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n, last = state.get if state.exists else (None, 0, -1)
        rows = pd.concat(list(frames)).dropna(subset=["churn"])
        rows["at"] = rows["scanned_at"].astype("datetime64[us]").astype("int64")
        for at, churn in rows.sort_values(["at", "id"])[["at", "churn"]].itertuples(index=False):
            if at >= last:
                value = churn if value is None else alpha * churn + (1 - alpha) * value
                n, last = n + 1, int(at)
        if n:
            state.update((value, n, last))
            yield pd.DataFrame({"segment_id": [key[0]], "churn_ewma": [value], "churn_samples": [n]})

    return _keyed(outcomes, "segment_id", step, "segment_id long, churn_ewma double, churn_samples int", "value double, n int, last long")


def price_history(snapshots: DataFrame, width: int = 1000) -> DataFrame:
    """First, last, least and largest dollar price and the number of changes of each listing after each batch.

    Snapshots older than the last one seen are counted in ``n_late``: they need the batch rebuild. State
    is kept a range of ``width`` listing ids, as columns, so that a batch's work goes by ranges and not by listings.
    """
    kinds = {"first": "double", "last": "double", "low": "double", "high": "double", "changes": "int", "at": "long", "late": "int"}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, *held = state.get if state.exists else ([] for _ in ("ids", *kinds))
        known = pd.DataFrame(dict(zip(kinds, map(list, held))), index=pd.Index(list(ids), dtype="int64"))
        rows = pd.concat(list(frames))
        rows["listing_id"] = rows["listing_id"].fillna(0).astype("int64")  # null ids are a range of their own
        seen = rows["listing_id"].unique()
        rows = rows[(rows["price_currency"] == "USD") & rows["price"].notna()].copy()
        rows["at"] = rows["captured_at"].astype("datetime64[us]").astype("int64")
        times = dict(zip(known.index.tolist(), known["at"].tolist()))
        codes, which = pd.factorize(rows["listing_id"])
        late = rows["at"] < np.array([times.get(i, -1) for i in which], "int64")[codes]
        counted = rows.loc[late, "listing_id"].value_counts()
        rows = rows[~late].sort_values(["listing_id", "at", "id", "price"])
        before = rows.groupby("listing_id")["price"].shift().fillna(rows["listing_id"].map(known["last"]))
        rows["change"] = before.notna() & (rows["price"] != before)
        new = rows.groupby("listing_id").agg(first=("price", "first"), last=("price", "last"), low=("price", "min"), high=("price", "max"), changes=("change", "sum"))
        every = known.index.union(new.index)
        old, new = known.reindex(every), new.reindex(every)
        both = {
            "first": old["first"].fillna(new["first"]), "last": new["last"].fillna(old["last"]), "low": np.fmin(old["low"], new["low"]), "high": np.fmax(old["high"], new["high"]),
            "changes": old["changes"].fillna(0) + new["changes"].fillna(0), "late": old["late"].fillna(0) + counted.reindex(every).fillna(0),
        }
        times |= rows.groupby("listing_id")["at"].last().to_dict()
        out = pd.DataFrame(both, index=every)
        if len(out):
            out["at"] = [times[i] for i in every]
            out = out.astype({"changes": "int64", "late": "int64"})
            state.update((every.tolist(), *[out[k].tolist() for k in kinds]))
            told = out[every.isin(seen)]
            if len(told):
                ids = told.index if not pd.isna(key[0]) else [None] * len(told)
                yield pd.DataFrame({"listing_id": ids, "initial_price": told["first"].values, "last_price": told["last"].values, "min_price": told["low"].values, "max_price": told["high"].values, "price_change_count": told["changes"].values, "n_late": told["late"].values})

    out = "listing_id long, initial_price double, last_price double, min_price double, max_price double, price_change_count int, n_late int"
    dealt = snapshots.withColumn("__range", F.floor(F.col("listing_id") / F.lit(width)))
    return _keyed(dealt, "__range", step, out, ", ".join(["ids array<long>", *[f"{k} array<{v}>" for k, v in kinds.items()]]))


def stale_work(events: DataFrame, time: str = "at", hours: int = 6) -> DataFrame:
    """Work that started and did not end within ``hours`` of event time: ``segment_id, status`` pending again.

    ``events`` has ``segment_id, status`` (started or complete) and the time; an end clears the timer.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"segment_id": [key[0]], "status": ["pending"]})
            return
        rows = pd.concat(list(frames)).sort_values(time)
        last = rows.iloc[-1]
        if last["status"] == "started":
            started = int(pd.Timestamp(last[time]).timestamp() * 1000)
            state.update((started,))
            state.setTimeoutTimestamp(max(started + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    marked = events.withWatermark(time, "1 minute")
    return _keyed(marked, "segment_id", step, "segment_id long, status string", "started long", GroupStateTimeout.EventTimeTimeout)

"""Location normalization and market facts of listings.

Everything is one pass of joins on ``listing_id``: entities, an aggregate of the snapshots (one
window and one aggregation on the same key) and the location rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DAY_MICROS = 86_400_000_000


def normalize_location(entities: DataFrame) -> DataFrame:
    """One location row a listing: both coordinates give a confident row, anything less a pending one without coordinates."""
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()

    def when_both(c: Column) -> Column:
        return F.when(both, c)

    return entities.select(
        F.col("id").alias("listing_id"), F.col("province_name").alias("raw_province"), F.col("city").alias("raw_city"), F.col("neighborhood").alias("raw_neighborhood"), F.col("address").alias("raw_address"),
        when_both(F.col("lat")).alias("raw_latitude"), when_both(F.col("lon")).alias("raw_longitude"),
        when_both(F.lit("AR")).alias("normalized_country"), when_both(F.col("province_name")).alias("normalized_province"), when_both(F.col("city")).alias("normalized_city"),
        when_both(F.col("neighborhood")).alias("normalized_neighborhood"), when_both(F.col("address")).alias("normalized_address"),
        when_both(F.col("lat")).alias("normalized_latitude"), when_both(F.col("lon")).alias("normalized_longitude"),
        when_both(F.lit("portal")).alias("geo_provider"), when_both(F.lit("high")).alias("geo_confidence"), F.when(both, "coordinates").otherwise("pending").alias("geo_status"),
    )


def pending_ids(entities: DataFrame, derived: DataFrame, source_id: int | None = None) -> DataFrame:
    """Listings without a derived row, or changed after it; ``derived`` has ``listing_id`` and ``updated_at``."""
    e = entities if source_id is None else entities.where(F.col("source_id") == source_id)
    d = derived.select("listing_id", F.col("updated_at").alias("__built"))
    return e.join(d, e["id"] == d["listing_id"], "left").where(F.col("__built").isNull() | (F.col("updated_at") > F.col("__built"))).select("id")


def usd_price() -> Column:
    """The entity's price if it is in dollars; no exchange rates are applied."""
    return F.when(F.col("price_currency") == "USD", F.col("price_amount"))


def per_m2(price: Column, surface: Column) -> Column:
    """Price over surface, null where either is missing or the surface is 0."""
    return F.try_divide(price.cast("double"), F.nullif(surface.cast("double"), F.lit(0.0)))


def price_history(snapshots: DataFrame) -> DataFrame:
    """First, least and largest dollar price, number and last time of changes, and last capture and count of all snapshots, for each listing.

    One window and one aggregation share a single shuffle by listing.
    """
    priced = (F.col("price_currency") == "USD") & F.col("price_amount").isNotNull()
    rows = snapshots.select("listing_id", "id", "captured_at", F.coalesce(priced, F.lit(False)).alias("__usd"), F.when(priced, F.col("price_amount")).alias("__price"))
    earlier = Window.partitionBy("listing_id").orderBy("captured_at", "id", "__price").rowsBetween(Window.unboundedPreceding, -1)
    moved = rows.withColumn("__moved", F.col("__usd") & (F.col("__price") != F.last("__price", ignorenulls=True).over(earlier)))
    when_usd = F.struct("captured_at", "id", "__price")
    return moved.groupBy("listing_id").agg(
        F.min_by("__price", F.when(F.col("__usd"), when_usd)).alias("initial_price_usd"), F.min("__price").alias("min_price_usd"), F.max("__price").alias("max_price_usd"),
        F.count_if("__moved").alias("price_change_count"), F.max(F.when(F.col("__moved"), F.col("captured_at"))).alias("last_price_change_at"),
        F.max("captured_at").alias("last_snapshot_at"), F.count(F.lit(1)).alias("snapshot_count"),
    )


#: A listing's history as a mergeable record; ``first`` and ``last`` are its first and last dollar prices with their places.
POINT = "STRUCT<captured_at: TIMESTAMP_NTZ, id: BIGINT, price: DECIMAL(18,2)>"


def history_state(snapshots: DataFrame) -> DataFrame:
    """``listing_id, first, last, low, high, changes, changed_at, seen_at, n``: what a history comes to, in a form that a later part can be merged into."""
    point = F.struct("captured_at", "id", F.col("price_amount").cast("decimal(18,2)").alias("price")).cast(POINT)
    usd = (F.col("price_currency") == "USD") & F.col("price_amount").isNotNull()
    rows = snapshots.select("listing_id", "captured_at", F.when(usd, point).alias("p"))
    before = F.last("p", ignorenulls=True).over(Window.partitionBy("listing_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("moved", F.coalesce(F.col("p.price") != before["price"], F.lit(False)))
    return rows.groupBy("listing_id").agg(
        F.min("p").alias("first"), F.max("p").alias("last"), F.min("p.price").alias("low"), F.max("p.price").alias("high"), F.count_if("moved").alias("changes"),
        F.max(F.when(F.col("moved"), F.col("captured_at"))).alias("changed_at"), F.max("captured_at").alias("seen_at"), F.count(F.lit(1)).alias("n"),
    )


def merge_history(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two states of a history, where ``fresh`` follows ``state``, as one; ``late`` where a fresh price stands before a known one, so that the merged row does not hold."""
    a, b = state.alias("a"), fresh.alias("b")
    both = a.join(b, F.col("a.listing_id") == F.col("b.listing_id"), "full_outer")
    seam = F.coalesce(F.col("a.last.price") != F.col("b.first.price"), F.lit(False))
    count = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0))
    return both.select(
        F.coalesce("a.listing_id", "b.listing_id").alias("listing_id"), F.coalesce("a.first", "b.first").alias("first"), F.coalesce("b.last", "a.last").alias("last"), F.least("a.low", "b.low").alias("low"), F.greatest("a.high", "b.high").alias("high"),
        (count("changes") + seam.cast("int")).alias("changes"), F.greatest("a.changed_at", "b.changed_at", F.when(seam, F.col("b.first.captured_at"))).alias("changed_at"), F.greatest("a.seen_at", "b.seen_at").alias("seen_at"),
        count("n").alias("n"), F.coalesce(F.col("b.first") < F.col("a.last"), F.lit(False)).alias("late"),
    )


def advance_history(state: DataFrame, fresh: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The state after new snapshots. Only listings that got a price from before a known one are built again, from all of ``snapshots``, which is read for them alone."""
    merged = materialize(merge_history(state, history_state(fresh)), "history")
    late = merged.where("late").select("listing_id")
    kept = merged.where(~F.col("late")).drop("late")
    if late.limit(1).count() == 0:
        return kept
    return kept.unionByName(history_state(snapshots.join(late, "listing_id", "left_semi")))


def history_of(state: DataFrame) -> DataFrame:
    """A state in the columns of ``price_history``."""
    return state.select(
        "listing_id", F.col("first.price").alias("initial_price_usd"), F.col("low").alias("min_price_usd"), F.col("high").alias("max_price_usd"), F.col("changes").alias("price_change_count"),
        F.col("changed_at").alias("last_price_change_at"), F.col("seen_at").alias("last_snapshot_at"), F.col("n").alias("snapshot_count"),
    )


def price_delta(current: Column, initial: Column) -> Column:
    return current - initial


def price_delta_pct(current: Column, initial: Column) -> Column:
    """Percent change, rounded half to even at two digits; null from a price of 0."""
    return F.bround(F.try_divide((current - initial) * 100, F.nullif(initial, F.lit(0))).cast("decimal(28,8)"), 2).cast("decimal(18,2)")


def days_between(start: Column, end: Column) -> Column:
    """Whole elapsed days, rounded down, not calendar days."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(DAY_MICROS)).cast("int")


def quality_flags() -> dict[str, Column]:
    """The four flags of a listing's completeness."""
    return {
        "has_price": F.col("price_amount").isNotNull(),
        "has_surface": F.col("surface_total").isNotNull(),
        "has_location": (F.col("lat").isNotNull() & F.col("lon").isNotNull()) | F.col("neighborhood").isNotNull(),
        "has_seller": F.col("seller_id").isNotNull() | F.col("seller_name").isNotNull(),
    }


def quality_score() -> Column:
    """0 to 100, 25 for each flag."""
    return sum((c.cast("int") * 25 for c in quality_flags().values()), F.lit(0))


def geo_cell(lat: Column, lon: Column) -> Column:
    """``lat:lon`` at two digits without trailing zeros; null where either is missing."""
    return F.concat(F.bround(lat, 2).cast("double").cast("string"), F.lit(":"), F.bround(lon, 2).cast("double").cast("string"))


def market_bucket() -> Column:
    """The parts that are not empty, joined; null without any."""
    return F.nullif(F.concat_ws("_", F.nullif("operation_type", F.lit("")), F.nullif("property_type", F.lit(""))), F.lit(""))


def choose_location(facts: DataFrame) -> DataFrame:
    """The normalized block where it has coordinates, else the raw one, never column by column."""
    done = F.col("normalized_latitude").isNotNull()

    def pick(normalized: str, raw: str) -> Column:
        return F.when(done, F.col(normalized)).otherwise(F.col(raw))

    return facts.withColumns({
        "f_province": pick("normalized_province", "province_name"), "f_city": pick("normalized_city", "city"), "f_neighborhood": pick("normalized_neighborhood", "neighborhood"),
        "f_latitude": pick("normalized_latitude", "lat"), "f_longitude": pick("normalized_longitude", "lon"), "location_source": F.when(done, "normalized").otherwise("raw"),
    })


def build_market_facts(entities: DataFrame, snapshots: DataFrame, locations: DataFrame, as_of: str) -> DataFrame:
    """One facts row a listing, as of a time given by the caller."""
    return facts_of(entities, price_history(snapshots), locations, as_of)


def build_incrementally(facts: DataFrame, entities: DataFrame, state: DataFrame, fresh: DataFrame, snapshots: DataFrame, locations: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The facts and the histories after new snapshots: rows of listings that have any, that were not built, or that changed since are built again, the others stay as they are.

    ``facts`` has its build time in ``updated_at``; so has the result. Old snapshots are read only for listings with late ones.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    ahead = materialize(advance_history(state, fresh, snapshots), "history")
    due = pending_ids(entities, facts).union(fresh.select("listing_id")).distinct().withColumnRenamed("id", "listing_id")
    due = materialize(due, "pending")
    some = entities.join(due.withColumnRenamed("listing_id", "id"), "id", "left_semi")
    built = facts_of(some, history_of(ahead.join(due, "listing_id", "left_semi")), locations, as_of).withColumn("updated_at", now)
    return facts.join(due, "listing_id", "left_anti").unionByName(built.select(*facts.columns)), ahead


def facts_of(entities: DataFrame, history: DataFrame, locations: DataFrame, as_of: str) -> DataFrame:
    """Facts from listings, their price histories and their places."""
    place = locations.select("listing_id", "normalized_province", "normalized_city", "normalized_neighborhood", "normalized_latitude", "normalized_longitude")
    rows = entities.withColumnRenamed("id", "listing_id").join(history, "listing_id", "left").join(place, "listing_id", "left")
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = choose_location(rows).withColumns({"price_usd": usd_price(), **quality_flags()})
    current, initial = F.col("price_usd"), F.col("initial_price_usd")
    return rows.select(
        "listing_id", "source_id", "external_id", "status", "operation_type", "property_type", "price_usd", "price_currency", "surface_total", "surface_covered",
        F.round(per_m2(current, F.col("surface_total")), 6).alias("price_per_m2_total"), F.round(per_m2(current, F.col("surface_covered")), 6).alias("price_per_m2_covered"),
        "first_seen_at", "last_seen_at", days_between(F.col("first_seen_at"), now).alias("days_observed"), days_between(F.col("first_seen_at"), now).alias("days_on_market"),
        "initial_price_usd", current.alias("current_price_usd"), "min_price_usd", "max_price_usd", F.coalesce("price_change_count", F.lit(0)).cast("long").alias("price_change_count"), "last_price_change_at",
        price_delta(current, initial).cast("decimal(18,2)").alias("price_delta_usd"), price_delta_pct(current, initial).alias("price_delta_pct"),
        "has_price", "has_surface", "has_location", "has_seller", quality_score().alias("data_quality_score"),
        F.col("f_province").alias("province"), F.col("f_city").alias("city"), F.col("f_neighborhood").alias("neighborhood"), F.col("f_latitude").alias("latitude"), F.col("f_longitude").alias("longitude"),
        geo_cell(F.col("f_latitude"), F.col("f_longitude")).alias("geo_cell_id"), "location_source", market_bucket().alias("market_bucket"),
        "last_snapshot_at", F.coalesce("snapshot_count", F.lit(0)).cast("long").alias("snapshot_count"),
    )

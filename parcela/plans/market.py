"""Queries and oracle SQL of location, market facts and search."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as M
from ..operators import geo
from ..operators import lifecycle
from ..operators import search as S
from ..session import shared_root
from .views import ctes, view

AS_OF = "2000-01-01 12:00:00"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "listings")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.normalize_location(entities(spark, sf_dir))


def market_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.build_market_facts(entities(spark, sf_dir), view(spark, sf_dir, "snapshots"), locations(spark, sf_dir), AS_OF)


_HISTORY_SQL = """SELECT listing_id, min_by(price_amount, (captured_at, id, price_amount)) FILTER (usd) AS initial_price_usd, min(price_amount) FILTER (usd) AS min_price_usd, max(price_amount) FILTER (usd) AS max_price_usd,
    count(*) FILTER (usd AND prev IS NOT NULL AND price_amount <> prev) AS price_change_count, max(captured_at) FILTER (usd AND prev IS NOT NULL AND price_amount <> prev) AS last_price_change_at,
    max(captured_at) AS last_snapshot_at, count(*) AS snapshot_count
    FROM (SELECT *, price_currency = 'USD' AS usd, lag(price_amount) OVER (PARTITION BY listing_id, price_currency = 'USD' ORDER BY captured_at, id, price_amount) AS prev FROM snapshots) GROUP BY listing_id"""
_CELL = "CAST(CAST(round_even({0}, 2) AS DOUBLE) AS VARCHAR) || ':' || CAST(CAST(round_even({1}, 2) AS DOUBLE) AS VARCHAR)"
_DAYS = f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(first_seen_at)) / 86400000000.0) AS INT)"
_FLAGS = "price_amount IS NOT NULL AS has_price, surface_total IS NOT NULL AS has_surface, ((lat IS NOT NULL AND lon IS NOT NULL) OR neighborhood IS NOT NULL) AS has_location, (seller_id IS NOT NULL OR seller_name IS NOT NULL) AS has_seller"
_SCORE = "CAST(25 * (CAST(price_amount IS NOT NULL AS INT) + CAST(surface_total IS NOT NULL AS INT) + CAST((lat IS NOT NULL AND lon IS NOT NULL) OR neighborhood IS NOT NULL AS INT) + CAST(seller_id IS NOT NULL OR seller_name IS NOT NULL AS INT)) AS INT)"
_BUCKET = "nullif(concat_ws('_', nullif(operation_type, ''), nullif(property_type, '')), '')"
_USD = "CASE WHEN price_currency = 'USD' THEN price_amount END"
_PCT = "CAST(round_even(CAST(({0} - initial_price_usd) * 100 AS DOUBLE) / nullif(CAST(initial_price_usd AS DOUBLE), 0), 2) AS DECIMAL(18,2))"
_FACTS_SQL = f"""SELECT l.id AS listing_id, source_id, external_id, status, operation_type, property_type, {_USD} AS price_usd, price_currency, surface_total, surface_covered,
    round(CAST({_USD} AS DOUBLE) / nullif(CAST(surface_total AS DOUBLE), 0), 6) AS price_per_m2_total, round(CAST({_USD} AS DOUBLE) / nullif(CAST(surface_covered AS DOUBLE), 0), 6) AS price_per_m2_covered,
    first_seen_at, last_seen_at, {_DAYS} AS days_observed, {_DAYS} AS days_on_market, initial_price_usd, {_USD} AS current_price_usd, min_price_usd, max_price_usd,
    coalesce(price_change_count, 0) AS price_change_count, last_price_change_at, CAST({_USD} - initial_price_usd AS DECIMAL(18,2)) AS price_delta_usd, {_PCT.format(_USD)} AS price_delta_pct,
    {_FLAGS}, {_SCORE} AS data_quality_score, province_name AS province, city, neighborhood, lat AS latitude, lon AS longitude, {_CELL.format("lat", "lon")} AS geo_cell_id,
    CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'normalized' ELSE 'raw' END AS location_source, {_BUCKET} AS market_bucket, last_snapshot_at, coalesce(snapshot_count, 0) AS snapshot_count
    FROM listings l LEFT JOIN history h ON l.id = h.listing_id"""
_WITH_FACTS = ctes("sources", "listings", "snapshots", more={"history": _HISTORY_SQL, "facts": _FACTS_SQL, "found": """SELECT f.*, l.rooms, l.bedrooms, l.bathrooms, l.title, l.address, s.code AS source_code
    FROM facts f JOIN listings l ON f.listing_id = l.id LEFT JOIN sources s ON f.source_id = s.id"""})  # fmt: skip


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def _on_listings(*columns):
    """A query that selects expressions over the listings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = columns[0]() if len(columns) == 1 and callable(columns[0]) else columns
        return entities(spark, sf_dir).select(F.col("id").alias("listing_id"), *made)

    return run


_L = ctes("listings")
_add("location_normalize", locations, _L + """SELECT id AS listing_id, province_name AS raw_province, city AS raw_city, neighborhood AS raw_neighborhood, address AS raw_address,
    CASE WHEN ok THEN lat END AS raw_latitude, CASE WHEN ok THEN lon END AS raw_longitude, CASE WHEN ok THEN 'AR' END AS normalized_country, CASE WHEN ok THEN province_name END AS normalized_province,
    CASE WHEN ok THEN city END AS normalized_city, CASE WHEN ok THEN neighborhood END AS normalized_neighborhood, CASE WHEN ok THEN address END AS normalized_address,
    CASE WHEN ok THEN lat END AS normalized_latitude, CASE WHEN ok THEN lon END AS normalized_longitude, CASE WHEN ok THEN 'portal' END AS geo_provider, CASE WHEN ok THEN 'high' END AS geo_confidence,
    CASE WHEN ok THEN 'coordinates' ELSE 'pending' END AS geo_status FROM (SELECT *, lat IS NOT NULL AND lon IS NOT NULL AS ok FROM listings)""")  # fmt: skip
_add("facts_price_m2", _on_listings(lambda: [M.usd_price().alias("price_usd"), F.round(M.per_m2(M.usd_price(), F.col("surface_total")), 6).alias("m2_total"), F.round(M.per_m2(M.usd_price(), F.col("surface_covered")), 6).alias("m2_covered")]),
     _L + f"SELECT id AS listing_id, {_USD} AS price_usd, round(CAST({_USD} AS DOUBLE) / nullif(CAST(surface_total AS DOUBLE), 0), 6) AS m2_total, round(CAST({_USD} AS DOUBLE) / nullif(CAST(surface_covered AS DOUBLE), 0), 6) AS m2_covered FROM listings")
_add("facts_price_history", lambda s, d: M.price_history(view(s, d, "snapshots")).drop("last_snapshot_at", "snapshot_count"), ctes("snapshots", more={"history": _HISTORY_SQL}) + "SELECT * EXCLUDE (last_snapshot_at, snapshot_count) FROM history")
_add("facts_snapshot_meta", lambda s, d: M.price_history(view(s, d, "snapshots")).select("listing_id", "last_snapshot_at", "snapshot_count"), ctes("snapshots") + "SELECT listing_id, max(captured_at) AS last_snapshot_at, count(*) AS snapshot_count FROM snapshots GROUP BY 1")
_add("facts_price_delta", lambda s, d: market_facts(s, d).select("listing_id", "price_delta_usd", "price_delta_pct"), _WITH_FACTS + "SELECT listing_id, price_delta_usd, price_delta_pct FROM facts")
_add("facts_days_on_market", _on_listings(lambda: [M.days_between(F.col("first_seen_at"), F.lit(AS_OF).cast("timestamp_ntz")).alias("days_on_market")]), _L + f"SELECT id AS listing_id, {_DAYS} AS days_on_market FROM listings")
_add("facts_quality", _on_listings(lambda: [*[c.alias(n) for n, c in M.quality_flags().items()], M.quality_score().alias("data_quality_score")]), _L + f"SELECT id AS listing_id, {_FLAGS}, {_SCORE} AS data_quality_score FROM listings")
_add("facts_location", lambda s, d: market_facts(s, d).select("listing_id", "province", "city", "neighborhood", "latitude", "longitude", "location_source"), _WITH_FACTS + "SELECT listing_id, province, city, neighborhood, latitude, longitude, location_source FROM facts")
_add("facts_geo_cell", _on_listings(lambda: [M.geo_cell(F.col("lat"), F.col("lon")).alias("geo_cell_id")]), _L + f"SELECT id AS listing_id, {_CELL.format('lat', 'lon')} AS geo_cell_id FROM listings")
_add("facts_bucket", _on_listings(lambda: [M.market_bucket().alias("market_bucket")]), _L + f"SELECT id AS listing_id, {_BUCKET} AS market_bucket FROM listings")
_add("market_facts", market_facts, _WITH_FACTS + "SELECT * FROM facts")


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived rows of an earlier build, a part of them out of date."""
    return entities(spark, sf_dir).where(F.col("id") % 3 != 0).select(F.col("id").alias("listing_id"), (F.col("updated_at") + F.expr("make_dt_interval(case when id % 4 = 0 then -1 else 1 end)")).alias("updated_at"))


_PENDING = "SELECT l.id FROM listings l LEFT JOIN (SELECT id, updated_at + to_days(CASE WHEN id % 4 = 0 THEN -1 ELSE 1 END) AS built FROM listings WHERE id % 3 <> 0) b ON l.id = b.id WHERE built IS NULL OR updated_at > built"
_add("incremental_pending", lambda s, d: M.pending_ids(entities(s, d), _built(s, d)), _L + _PENDING)
_add("location_build", lambda s, d: M.normalize_location(entities(s, d).join(M.pending_ids(entities(s, d), _built(s, d), 2), "id", "left_semi")).select("listing_id", "geo_status", "normalized_city"),
     _L + f"SELECT id AS listing_id, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'coordinates' ELSE 'pending' END AS geo_status, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN city END AS normalized_city FROM listings WHERE source_id = 2 AND id IN ({_PENDING})")


def _search(request: S.SearchRequest, columns: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a request, or a page where the request limits itself."""
    rows = S.page(market_facts(spark, sf_dir), entities(spark, sf_dir), view(spark, sf_dir, "sources"), request)
    return rows.select(*columns)


def _all(request: S.SearchRequest, columns: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.joined(market_facts(spark, sf_dir), entities(spark, sf_dir), view(spark, sf_dir, "sources"))
    for c in S.conditions(request.validate()):
        rows = rows.where(c)
    return rows.select(*columns)


_EQUAL = S.SearchRequest(status="active", operation_type="venta", province="Santa Fe", city="Rosario", location_source="normalized")
_FLAGSHIP = S.SearchRequest(operation_type="venta", surface_min=20, surface_max=90, price_min=900, require_price=True, require_surface=True, min_quality=50, limit=50)
for _name, _request, _columns, _where in (
    ("search_equality", _EQUAL, ["listing_id", "status", "operation_type", "province", "city"], "status = 'active' AND operation_type = 'venta' AND province = 'Santa Fe' AND city = 'Rosario' AND location_source = 'normalized'"),
    ("search_ranges", S.SearchRequest(surface_min=20, surface_max=80, price_min=905, price_max=960), ["listing_id", "surface_total", "price_usd"], "surface_total BETWEEN 20 AND 80 AND price_usd BETWEEN 905 AND 960"),
    ("search_rooms", S.SearchRequest(rooms_min=2, rooms_max=4, bedrooms_min=1, bathrooms_max=2), ["listing_id", "rooms", "bedrooms", "bathrooms"], "rooms BETWEEN 2 AND 4 AND bedrooms >= 1 AND bathrooms <= 2"),
    ("search_quality", S.SearchRequest(min_quality=75, market_bucket="venta_large"), ["listing_id", "data_quality_score", "market_bucket"], "data_quality_score >= 75 AND market_bucket = 'venta_large'"),
    ("search_required", S.SearchRequest(require_price=True, require_surface=True, require_coordinates=True), ["listing_id", "price_usd", "surface_total", "latitude", "longitude"], "price_usd IS NOT NULL AND surface_total IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL"),
    ("search_radius", S.SearchRequest(lat=-34.6, lon=-58.4, radius_m=6000), ["listing_id", "latitude", "longitude"], "latitude BETWEEN -34.6 - 6000/111000.0e0 AND -34.6 + 6000/111000.0e0 AND 2 * 6371000 * asin(sqrt(least(pow(sin(radians(CAST(latitude AS DOUBLE) + 34.6e0) / 2), 2) + cos(radians(CAST(latitude AS DOUBLE))) * cos(radians(-34.6e0)) * pow(sin(radians(CAST(longitude AS DOUBLE) + 58.4e0) / 2), 2), 1.0))) <= 6000"),
    ("search_join", S.SearchRequest(), ["listing_id", "source_code", "title", "rooms"], "true"),
):
    _add(_name, partial(_all, _request, _columns), f"{_WITH_FACTS}SELECT {', '.join(_columns)} FROM found WHERE {_where}")
_RANK = "ORDER BY data_quality_score DESC NULLS FIRST, last_seen_at DESC NULLS FIRST, listing_id"
_FLAGSHIP_WHERE = "operation_type = 'venta' AND surface_total BETWEEN 20 AND 90 AND price_usd >= 900 AND surface_total IS NOT NULL AND data_quality_score >= 50"
_KEYS = ["listing_id", "price_per_m2_total", "data_quality_score", "last_seen_at"]
_add("search_sorted", partial(_search, S.SearchRequest(sort_by="price_per_m2_total", descending=True, limit=500), _KEYS), f"{_WITH_FACTS}SELECT {', '.join(_KEYS)} FROM found ORDER BY price_per_m2_total DESC NULLS FIRST, listing_id LIMIT 500")
_add("search_default_order", partial(_search, S.SearchRequest(limit=200), _KEYS), f"{_WITH_FACTS}SELECT {', '.join(_KEYS)} FROM found {_RANK} LIMIT 200")
_add("search_page", partial(_search, S.SearchRequest(sort_by="surface_total", limit=50, offset=100), _KEYS), f"{_WITH_FACTS}SELECT {', '.join(_KEYS)} FROM found ORDER BY surface_total ASC NULLS LAST, listing_id LIMIT 50 OFFSET 100")
_add("search_total", lambda s, d: S.total(market_facts(s, d), entities(s, d), view(s, d, "sources"), _FLAGSHIP), f"{_WITH_FACTS}SELECT count(*) AS total FROM found WHERE {_FLAGSHIP_WHERE}")
_add("search_result", lambda s, d: S.result(S.page(market_facts(s, d), entities(s, d), view(s, d, "sources"), _FLAGSHIP)), f"""{_WITH_FACTS}SELECT listing_id, source_code, external_id, status, operation_type, property_type, title, address, CAST(price_usd AS DOUBLE) AS price_usd,
    CAST(surface_total AS DOUBLE) AS surface_total, CAST(surface_covered AS DOUBLE) AS surface_covered, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, price_per_m2_total, rooms, bedrooms, bathrooms,
    data_quality_score, market_bucket, CAST(NULL AS VARCHAR) AS thumbnail_url, 0 AS image_count, false AS has_images FROM found WHERE {_FLAGSHIP_WHERE} {_RANK} LIMIT 50""")  # fmt: skip


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market facts, filtered, ranked and cut to fifty."""
    return QUERIES["search_result"](spark, sf_dir)


def _facts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the even listings as they stood, then those of a third of the listings merged in by listing."""
    built = QUERIES["market_facts"](spark, sf_dir).select("listing_id", "price_usd", "market_bucket")
    was = built.where(F.col("listing_id") % 2 == 0).select("listing_id", F.lit(1.5).alias("price_usd"), "market_bucket", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    rows = built.where(F.col("listing_id") % 3 == 0).withColumn("price_usd", F.col("price_usd").cast("double"))
    return lifecycle.merge_upsert(was, rows, ["listing_id"], ["price_usd", "market_bucket"], F.lit("1999-06-01 00:00:00").cast("timestamp_ntz"))


QUERIES["facts_upsert"] = _facts_upsert
ORACLE["facts_upsert"] = f"""SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN CAST(price_usd AS DOUBLE) ELSE 1.5e0 END AS price_usd, market_bucket,
    CASE WHEN listing_id % 2 = 0 THEN TIMESTAMP '1998-01-01 00:00:00' ELSE TIMESTAMP '1999-06-01 00:00:00' END AS created_at, CASE WHEN listing_id % 3 = 0 THEN TIMESTAMP '1999-06-01 00:00:00' ELSE TIMESTAMP '1998-01-01 00:00:00' END AS updated_at
    FROM ({ORACLE["market_facts"]}) f WHERE listing_id % 2 = 0 OR listing_id % 3 = 0"""


def _facts_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after three generations of snapshots, the last of which brings late ones too; of the listings a third is built only in the second."""
    rows, kept = entities(spark, sf_dir), view(spark, sf_dir, "snapshots")
    made = F.when(F.col("id") % 50 == 0, 3).when(F.col("captured_at") < F.lit("1994-01-01").cast("timestamp_ntz"), 1).when(F.col("captured_at") < F.lit("1996-06-01").cast("timestamp_ntz"), 2).otherwise(3)
    part = [kept.where(made == g) for g in (1, 2, 3)]
    state, place = M.history_state(part[0]), locations(spark, sf_dir)
    facts = M.facts_of(rows.where("id % 3 <> 0"), M.history_of(state), place, AS_OF).withColumn("updated_at", F.lit(AS_OF).cast("timestamp_ntz"))
    for g in (1, 2):
        facts, state = M.build_incrementally(facts, rows, state, part[g], kept.where(made <= g + 1), place, AS_OF)
    return facts.drop("updated_at")


QUERIES["facts_incremental"] = _facts_incremental
ORACLE["facts_incremental"] = ORACLE["market_facts"]


def _search_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius search over facts that were written by place first."""
    path = f"{shared_root(spark)}/parcela/places-{uuid.uuid4().hex}"
    geo.write_by_place(market_facts(spark, sf_dir), path, 16)
    return geo.within_radius(spark, path, -34.6, -58.4, 6000).select("listing_id", "latitude", "longitude")


QUERIES["search_radius_by_place"] = _search_by_place
ORACLE["search_radius_by_place"] = ORACLE["search_radius"]

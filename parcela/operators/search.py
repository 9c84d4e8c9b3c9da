"""Market search: predicates, joins, order, pages and totals over market facts."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000
METRES_PER_DEGREE = 111_000
# The sort columns that a request may name.
SORTABLE = ("data_quality_score", "days_on_market", "last_seen_at", "price_per_m2_total", "price_usd", "surface_total")


@dataclass(frozen=True)
class SearchRequest:
    """Filters apply where they are given; ``validate`` checks bounds before a plan is built."""

    status: str | None = None
    operation_type: str | None = None
    property_type: str | None = None
    province: str | None = None
    city: str | None = None
    neighborhood: str | None = None
    location_source: str | None = None
    surface_min: float | None = None
    surface_max: float | None = None
    price_min: float | None = None
    price_max: float | None = None
    rooms_min: int | None = None
    rooms_max: int | None = None
    bedrooms_min: int | None = None
    bedrooms_max: int | None = None
    bathrooms_min: int | None = None
    bathrooms_max: int | None = None
    min_quality: int | None = None
    market_bucket: str | None = None
    require_price: bool = False
    require_surface: bool = False
    require_coordinates: bool = False
    lat: float | None = None
    lon: float | None = None
    radius_m: float | None = None
    sort_by: str | None = None
    descending: bool = False
    limit: int = 100
    offset: int = 0

    def validate(self) -> SearchRequest:
        if self.sort_by is not None and self.sort_by not in SORTABLE:
            raise ValueError(f"sort_by must be one of {SORTABLE}")
        if len({x is None for x in (self.lat, self.lon, self.radius_m)}) > 1:
            raise ValueError("lat, lon and radius_m go together")
        if self.lat is not None and not (-90 <= self.lat <= 90 and -180 <= self.lon <= 180 and self.radius_m > 0):
            raise ValueError("coordinates or radius out of range")
        if self.min_quality is not None and not 0 <= self.min_quality <= 100:
            raise ValueError("min_quality is 0 to 100")
        if not (1 <= self.limit <= 500 and self.offset >= 0):
            raise ValueError("limit is 1 to 500, offset 0 or more")
        return self


def _between(column: Column, low, high) -> list[Column]:
    return [column >= low] * (low is not None) + [column <= high] * (high is not None)


def distance_m(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Haversine distance in metres."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def radius_filter(lat: Column, lon: Column, lat0: float, lon0: float, radius_m: float) -> list[Column]:
    """A box, which reaches the scan, then the exact distance."""
    dlat = radius_m / METRES_PER_DEGREE
    dlon = radius_m / (METRES_PER_DEGREE * math.cos(math.radians(lat0)))
    return [lat.between(lat0 - dlat, lat0 + dlat), lon.between(lon0 - dlon, lon0 + dlon), distance_m(lat.cast("double"), lon.cast("double"), lat0, lon0) <= radius_m]


def conditions(r: SearchRequest) -> list[Column]:
    """The predicates of a request over the join of facts and entities."""
    equal = [F.col(n) == getattr(r, n) for n in ("status", "operation_type", "property_type", "province", "city", "neighborhood", "location_source", "market_bucket") if getattr(r, n) is not None]
    ranges = _between(F.col("surface_total"), r.surface_min, r.surface_max) + _between(F.col("price_usd"), r.price_min, r.price_max)
    for n in ("rooms", "bedrooms", "bathrooms"):
        ranges += _between(F.col(n), getattr(r, f"{n}_min"), getattr(r, f"{n}_max"))
    quality = [F.col("data_quality_score") >= r.min_quality] if r.min_quality is not None else []
    needed = [F.col(c).isNotNull() for flag, cs in (("require_price", ["price_usd"]), ("require_surface", ["surface_total"]), ("require_coordinates", ["latitude", "longitude"])) if getattr(r, flag) for c in cs]
    near = radius_filter(F.col("latitude"), F.col("longitude"), r.lat, r.lon, r.radius_m) if r.lat is not None else []
    return equal + ranges + quality + needed + near


def joined(facts: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their entities and, where known, the source code. The optimizer broadcasts ``sources`` where its size allows."""
    e = entities.select(F.col("id").alias("listing_id"), "rooms", "bedrooms", "bathrooms", "title", "address")
    s = sources.select(F.col("id").alias("source_id"), F.col("code").alias("source_code"))
    return facts.join(e, "listing_id").join(s, "source_id", "left")


def ordering(r: SearchRequest) -> list[Column]:
    """Nulls come first in descending order and last in ascending; ``listing_id`` makes pages stable."""
    if r.sort_by is None:
        return [F.desc_nulls_first("data_quality_score"), F.desc_nulls_first("last_seen_at"), F.asc("listing_id")]
    return [F.desc_nulls_first(r.sort_by) if r.descending else F.asc_nulls_last(r.sort_by), F.asc("listing_id")]


def _matching(facts: DataFrame, entities: DataFrame, sources: DataFrame, r: SearchRequest) -> DataFrame:
    rows = joined(facts, entities, sources)
    for c in conditions(r.validate()):
        rows = rows.where(c)
    return rows


def page(facts: DataFrame, entities: DataFrame, sources: DataFrame, r: SearchRequest) -> DataFrame:
    """One page of results: a top-k, never a full sort."""
    return _matching(facts, entities, sources, r).orderBy(*ordering(r)).offset(r.offset).limit(r.limit)


def total(facts: DataFrame, entities: DataFrame, sources: DataFrame, r: SearchRequest) -> DataFrame:
    """The number of results on all pages."""
    return _matching(facts, entities, sources, r).agg(F.count(F.lit(1)).alias("total"))


def result(rows: DataFrame) -> DataFrame:
    """The public shape of a page: amounts as doubles, and constants for pictures."""
    amounts = ("price_usd", "surface_total", "surface_covered", "latitude", "longitude")
    return rows.select(
        "listing_id", "source_code", "external_id", "status", "operation_type", "property_type", "title", "address", *[F.col(c).cast("double").alias(c) for c in amounts], "price_per_m2_total",
        "rooms", "bedrooms", "bathrooms", "data_quality_score", "market_bucket", F.lit(None).cast("string").alias("thumbnail_url"), F.lit(0).alias("image_count"), F.lit(False).alias("has_images"),
    )


def filter_names() -> list[str]:
    return [f.name for f in fields(SearchRequest)]

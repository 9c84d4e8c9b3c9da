"""Raw posting JSON: pages of postings, and their normalization to listing rows.

Postings are parsed once with a fixed schema; every field is an expression over the parsed struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_nul

_PLACE = "STRUCT<depth: INT, name: STRING>"
for _ in range(4):
    _PLACE = f"STRUCT<depth: INT, name: STRING, parent: {_PLACE}>"
PAIR = "STRUCT<value STRING, label STRING, measure STRING>"
POSTING = f"""postingId STRING, id STRING, url STRING, link STRING, status STRING, modified_date STRING, generatedTitle STRING, descriptionNormalized STRING,
  realEstateType STRUCT<realEstateTypeId: STRING, name: STRING>,
  priceOperationTypes ARRAY<STRUCT<operationType: STRUCT<name: STRING>, lowPricePercentage: DOUBLE, prices: ARRAY<STRUCT<amount: DOUBLE, currency: STRING>>>>,
  expenses STRUCT<amount: DOUBLE, currency: STRING>, mainFeatures MAP<STRING, {PAIR}>,
  postingLocation STRUCT<address: STRUCT<name: STRING, visibility: STRING>, postingGeolocation: STRUCT<geolocation: STRUCT<latitude: DOUBLE, longitude: DOUBLE>>, location: {_PLACE}>,
  publisher STRUCT<publisherId: STRING, name: STRING, publisherTypeId: STRING, url: STRING, mainPhone: STRING, premier: BOOLEAN, created_date: STRING>, postingCode STRING, reserved BOOLEAN, premier BOOLEAN,
  hasVideos BOOLEAN, hasTour BOOLEAN, hasPlans BOOLEAN, triggerPill STRING, alphanumeric_key STRING, whatsApp STRING, publicationAreaId STRING"""
# Feature ids of the listing columns, codes of sellers and states, categories that are not homes.
FEATURES = {"surface_total": "CFT100", "surface_covered": "CFT101", "rooms": "CFT1", "bedrooms": "CFT2", "bathrooms": "CFT3", "toilettes": "CFT4", "antiquity_years": "CFT5", "garages": "CFT7"}
TEXT_FEATURES = {"disposition": "1000019", "orientation": "1000029"}
# Fields that go into the residue under new names.
RESIDUE = {
    "address_visibility": "postingLocation.address.visibility", "posting_code": "postingCode", "reserved": "reserved", "premier": "premier", "has_videos": "hasVideos", "has_tour": "hasTour", "has_plans": "hasPlans",
    "trigger_pill": "triggerPill", "alphanumeric_key": "alphanumeric_key", "whatsapp": "whatsApp", "publication_area_id": "publicationAreaId", "real_estate_type_id": "realEstateType.realEstateTypeId",
    "publisher_url": "publisher.url", "publisher_phone": "publisher.mainPhone", "publisher_premier": "publisher.premier", "publisher_created_date": "publisher.created_date",
}
SELLERS = {"1": "particular", "2": "inmobiliaria", "3": "developer"}
STATES = {"ONLINE": "active", "OFFLINE": "offline", "PAUSED": "paused", "RESERVED": "reserved"}
EXCLUDED_TYPES = ("33", "34")
LIST_KEYS = ("listPostings", "listObjects", "postings", "items", "results", "data")


def postings_of_page(pages: DataFrame, column: str = "body") -> DataFrame:
    """One row a posting, as JSON text: the first list that is not empty under the known keys."""
    schema = ", ".join(f"{k} ARRAY<VARIANT>" for k in LIST_KEYS)
    parsed = pages.withColumn("__page", F.from_json(column, schema))
    lists = [F.when(F.size(F.col("__page")[k]) > 0, F.col("__page")[k]) for k in LIST_KEYS]
    return parsed.withColumn("__list", F.coalesce(*lists)).select(*pages.columns, F.posexplode("__list").alias("position", "__p")).withColumn("posting", F.to_json("__p")).drop("__p")


def total_count(column: str = "body") -> Column:
    """The total that a page states, from the first place that has one."""

    def at(path: str) -> Column:
        return F.get_json_object(column, f"$.{path}")

    grouped = [F.translate(at(k), ".,", "").try_cast("int") for k in ("totalPosting", "totalPostings")]
    return F.coalesce(at("paging.total").try_cast("int"), *grouped, *[at(k).try_cast("int") for k in ("totalCount", "total", "count")])


def mapped(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def offset_time(text: Column) -> Column:
    """An ISO time with an offset, in UTC without a zone; null if it is not one."""
    return F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz")


def feature_int(features: Column, feature: str) -> Column:
    """A feature's number, cut to whole; null if it is missing or no number."""
    return F.try_element_at(features, F.lit(feature))["value"].try_cast("double").try_cast("int")


def place_names(location: Column) -> dict[str, Column]:
    """Province, city and neighborhood from the chain of places (depth 1, 2, 3); the innermost link of a depth gives way to an outer one."""
    links, at = [], location
    for _ in range(5):
        links.append(F.struct(at["depth"].alias("depth"), at["name"].alias("name")))
        at = at["parent"] if len(links) < 5 else at
    chain = F.array(*links)
    return {n: F.try_element_at(F.filter(chain, _at_depth(d)), F.lit(-1))["name"] for n, d in (("province_name", 1), ("city", 2), ("neighborhood", 3))}


def _at_depth(depth: int):
    return lambda x: x["depth"] == depth


def canonical_url(url: Column, id_: Column, base: str) -> Column:
    """An address relative to the site, one as it is, or one made from the id."""
    root = base.rstrip("/")
    return F.when(url.startswith("/"), F.concat(F.lit(root), url)).when(url.startswith("http"), url).otherwise(F.concat(F.lit(f"{root}/propiedades/"), id_, F.lit(".html")))


def extra_data(p: Column) -> Column:
    """A JSON object of what no column holds: further fields under new names and unmapped features; null if there is nothing."""

    def field(path: str) -> Column:
        out = p
        for name in path.split("."):
            out = out[name]
        return out

    as_json = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
    named = {name: field(path) for name, path in RESIDUE.items()} | {"low_price_percentage": F.try_element_at(p["priceOperationTypes"], F.lit(1))["lowPricePercentage"]}
    plain = F.array(*[F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f'"{name}":'), as_json(v))) for name, v in named.items()])
    known = [*FEATURES.values(), *TEXT_FEATURES.values()]
    rest = F.map_entries(F.map_filter(p["mainFeatures"], lambda k, v: ~k.isin(*known) & v["value"].isNotNull()))
    features = F.transform(rest, lambda e: F.concat(as_json(F.concat(F.lit("feature_"), e["key"])), F.lit(":"), F.to_json(F.struct(F.coalesce(e["value"]["label"], e["key"]).alias("label"), e["value"]["value"].alias("value")))))
    packed = F.array_compact(F.concat(plain, F.coalesce(features, F.array().cast("array<string>"))))
    return F.when(F.size(packed) > 0, F.concat(F.lit("{"), F.array_join(packed, ","), F.lit("}")))


def normalize(postings: DataFrame, base: str = "https://portal.example", column: str = "posting") -> DataFrame:
    """Listing rows of posting JSON. Postings without an id, and of excluded categories, are dropped; unreadable JSON counts as no id."""
    p = F.col("__p")
    # a generator's output: a filter on it stays above it, while one on a projection is pushed below with a parse for each of its parts
    rows = postings.select(F.explode(F.array(F.from_json(F.translate(column, "\x00", ""), POSTING))).alias("__p"))
    key = F.trim(F.coalesce(F.nullif(p["postingId"], F.lit("")), p["id"]))
    rows = rows.withColumn("external_id", key).where((F.col("external_id") != "") & F.coalesce(~p["realEstateType"]["realEstateTypeId"].isin(*EXCLUDED_TYPES), F.lit(True)))
    offer = F.try_element_at(p["priceOperationTypes"], F.lit(1))
    price = F.try_element_at(offer["prices"], F.lit(1))
    spent = p["expenses"]["amount"]
    geo = p["postingLocation"]["postingGeolocation"]["geolocation"]
    features = {n: feature_int(p["mainFeatures"], f) for n, f in FEATURES.items()}
    return rows.select(
        "external_id", canonical_url(F.coalesce(F.nullif(p["url"], F.lit("")), p["link"], F.lit("")), F.col("external_id"), base).alias("canonical_url"), mapped(p["status"], STATES, "unknown").alias("status"), offset_time(p["modified_date"]).alias("source_modified_at"),
        F.nullif(F.lower(offer["operationType"]["name"]), F.lit("")).alias("operation_type"), F.nullif(F.lower(p["realEstateType"]["name"]), F.lit("")).alias("property_type"),
        strip_nul(p["generatedTitle"]).alias("generated_title"), strip_nul(p["descriptionNormalized"]).alias("description"),
        price["amount"].cast("decimal(18,2)").alias("price_amount"), price["currency"].alias("price_currency"),
        F.when(spent != 0, spent).cast("decimal(18,2)").alias("expenses_amount"), F.when(spent != 0, p["expenses"]["currency"]).alias("expenses_currency"),
        *[(c.cast("decimal(18,2)") if n.startswith("surface") else c).alias(n) for n, c in features.items()],
        F.nullif(F.try_element_at(p["mainFeatures"], F.lit(FEATURES["surface_total"]))["measure"], F.lit("")).alias("surface_unit"),
        *[F.nullif(F.try_element_at(p["mainFeatures"], F.lit(f))["value"], F.lit("")).alias(n) for n, f in TEXT_FEATURES.items()],
        p["postingLocation"]["address"]["name"].alias("address"), *[c.alias(n) for n, c in place_names(p["postingLocation"]["location"]).items()],
        geo["latitude"].cast("decimal(10,6)").alias("lat"), geo["longitude"].cast("decimal(10,6)").alias("lon"),
        p["publisher"]["publisherId"].alias("seller_id"), p["publisher"]["name"].alias("seller_name"), mapped(p["publisher"]["publisherTypeId"], SELLERS).alias("seller_type"), extra_data(p).alias("extra_data"),
    )

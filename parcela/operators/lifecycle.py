"""Change detection of listings, merges, and set operations of a scan.

A table format with MERGE is not assumed: a merge is a join whose result is written as a new
version by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_nul
from .ranges import RANGE, by_ranges, spread_join, with_summary

# The fields that make a listing's content, numbers and texts, in alphabetical order.
NUMBERS = ("bathrooms", "bedrooms", "expenses_amount", "garages", "price_amount", "rooms", "surface_total")
TEXTS = ("price_currency", "seller_id", "status")
HASHED = tuple(sorted(NUMBERS + TEXTS))
# All fields that a posting brings.
PAYLOAD = (
    "canonical_url", "status", "source_modified_at", "operation_type", "property_type", "generated_title", "description", "price_amount", "price_currency", "expenses_amount", "expenses_currency",
    "surface_total", "surface_covered", "surface_unit", "rooms", "bedrooms", "bathrooms", "toilettes", "garages", "antiquity_years", "disposition", "orientation", "address", "neighborhood", "city",
    "province_name", "lat", "lon", "seller_id", "seller_name", "seller_type", "extra_data",
)
KEYS = ("source_id", "external_id")


def content_hash(columns: list[str], prefix: str = "") -> Column:
    """SHA-256 of the hashed fields as a JSON object in alphabetical order.

    A field that the table lacks counts as null. A number is written in its shortest decimal form, so
    its type makes no difference.
    """

    def value(c: str) -> Column:
        if c not in columns:
            return F.lit("null")
        if c in TEXTS:
            quoted = F.regexp_extract(F.to_json(F.struct(F.col(prefix + c).cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
            return F.when(F.col(prefix + c).isNull(), "null").otherwise(quoted)
        digits = F.col(prefix + c).try_cast("decimal(38,10)").cast("string")
        return F.coalesce(F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ""), F.lit("null"))

    fields = [F.concat(F.lit(f'"{c}": '), value(c)) for c in HASHED]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")), 256)


def latest_per_key(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row a key, the last in ``order``."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__n") == 1).drop("__n")


def _payload(current: DataFrame) -> list[str]:
    return [c for c in PAYLOAD if c in current.columns]


def classify(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each key's case: A new, B seen again unchanged, C changed, D not in the incoming rows. One full outer join on the key.

    Incoming rows that repeat a key count once, the last by page and position. A payload field that
    they lack is null, and the others come in the current table's types, texts without NUL. A stored
    ``content_hash`` is what a current row is compared by; without one it is computed.
    """
    kinds = {f.name: f.dataType for f in current.schema}

    def brought(c: str) -> Column:
        if c not in incoming.columns:
            return F.lit(None).cast(kinds[c])
        value = F.col(c).cast(kinds[c])
        return strip_nul(value) if kinds[c].simpleString() == "string" else value

    payload = _payload(current)
    fresh = latest_per_key(incoming, KEYS, [F.desc("page"), F.desc("position")]).withColumn("in_hash", content_hash(incoming.columns)).select(*KEYS, "in_hash", *[brought(c).alias(f"in_{c}") for c in payload])
    computed = content_hash(current.columns)
    known = current.withColumn("hash", F.coalesce("content_hash", computed) if "content_hash" in current.columns else computed)
    both = known.join(fresh, list(KEYS), "full_outer")
    case = F.when(F.col("hash").isNull(), "A").when(F.col("in_hash").isNull(), "D").when(F.col("hash") == F.col("in_hash"), "B").otherwise("C")
    return both.withColumn("case", case)


def merge(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The new current table. A changed listing takes the whole incoming payload, nulls too; one seen again only a new ``last_seen_at``. Columns that no posting brings stay."""
    payload = _payload(current)
    rest = [c for c in current.columns if c not in (*KEYS, *payload, "first_seen_at", "last_seen_at", "last_changed_at", "content_hash")]
    case = F.col("case")
    changed, seen = case.isin("A", "C"), case.isin("A", "B", "C")
    return classify(current, incoming).select(
        *KEYS,
        *rest,
        *[F.when(changed, F.col(f"in_{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(changed, now).otherwise(F.col("last_changed_at")).alias("last_changed_at"),
        F.when(changed, F.col("in_hash")).otherwise(F.col("hash")).alias("content_hash"),
    )


def snapshots(classified: DataFrame, now: Column) -> DataFrame:
    """Rows to append to the history: new and changed listings with their whole payload."""
    payload = [c.removeprefix("in_") for c in classified.columns if c.startswith("in_") and c != "in_hash"]
    return classified.where(F.col("case").isin("A", "C")).select(*KEYS, now.alias("captured_at"), *[F.col(f"in_{c}").alias(c) for c in payload], F.col("in_hash").alias("content_hash"))


def append_row(target: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The target and the rows after it, with ``created_at`` now; columns that they lack are null. No key is checked."""
    stamped = rows.withColumn("created_at", now.cast(target.schema["created_at"].dataType))
    return target.unionByName(stamped, allowMissingColumns=True).select(*target.columns)


def counters(classified: DataFrame) -> DataFrame:
    """New, changed, unchanged and disappeared listings of each source."""
    return classified.groupBy("source_id").agg(*[F.count_if(F.col("case") == k).alias(n) for k, n in (("A", "new_count"), ("C", "changed_count"), ("B", "unchanged_count"), ("D", "disappeared_count"))])


def scan_counters(classified: DataFrame, incoming: DataFrame, by: str) -> DataFrame:
    """What each scan of ``by`` (such as a segment) brought: all postings it found, repeated ones too, and its new, changed and unchanged listings, each counted where its last posting was."""
    kept = latest_per_key(incoming, KEYS, [F.desc("page"), F.desc("position")]).select(*KEYS, by)
    case = kept.join(classified.select(*KEYS, "case"), list(KEYS)).groupBy(by).agg(*[F.count_if(F.col("case") == k).alias(n) for k, n in (("A", "new_count"), ("C", "changed_count"), ("B", "unchanged_count"))])
    found = incoming.groupBy(by).agg(F.count(F.lit(1)).alias("found_count"))
    return found.join(case, by, "left").fillna(0, ["new_count", "changed_count", "unchanged_count"])


def rehash(entities: DataFrame, key: str = "id", stored: str = "content_hash") -> DataFrame:
    """Rows whose stored hash is not the hash of their content, with the new one."""
    return entities.withColumn("new_hash", content_hash(entities.columns)).where(~F.col("new_hash").eqNullSafe(F.col(stored))).select(key, stored, "new_hash")


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str], now: Column) -> DataFrame:
    """Insert or update by key: the named columns from the update, ``updated_at`` now, all else kept. ``updates`` has a key once."""
    u = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    hit = F.col("__hit").isNotNull()
    rest = [c for c in target.columns if c not in (*keys, *columns, "created_at", "updated_at")]
    return target.join(u, keys, "full_outer").select(
        *keys, *[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns], *rest,
        F.coalesce("created_at", now).alias("created_at"), F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The target and those rows whose keys it does not have; keys that repeat in ``rows`` go in once."""
    return target.unionByName(rows.dropDuplicates(keys).join(target, keys, "left_anti"), allowMissingColumns=True)


def new_rows(rows: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Rows to append: ids that are not written yet, each once."""
    return rows.dropDuplicates([key]).join(written.select(key), key, "left_anti")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not done; rows without an id always stay."""
    ids = done.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key)
    return rows.join(ids, key, "left_anti")


def dedupe_keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each trimmed key, blank keys dropped, with the number of later ones."""
    trimmed = rows.withColumn(key, F.trim(key)).where(F.col(key) != "")
    w = Window.partitionBy(key)
    return trimmed.withColumns({"__n": F.row_number().over(w.orderBy(order)), "n_duplicates": F.count(F.lit(1)).over(w) - 1}).where(F.col("__n") == 1).drop("__n")


def page_counts(seen: DataFrame) -> DataFrame:
    """``segment, page, new_items, n_items``: the distinct items of each page, and those of them that no earlier page of the segment shows.

    First pages are a minimum by segment and item, so neither a segment nor an item on many pages is one task.
    """
    items = seen.select("segment", "page", "item").distinct()
    first = items.groupBy("segment", "item").agg(F.min("page").alias("page"))
    shown = items.groupBy("segment", "page").agg(F.lit(0).cast("long").alias("new_items"), F.count(F.lit(1)).alias("n_items"))
    fresh = first.where(F.col("page").isNotNull()).groupBy("segment", "page").agg(F.count(F.lit(1)).alias("new_items"), F.lit(0).cast("long").alias("n_items"))
    return shown.unionByName(fresh).groupBy("segment", "page").agg(F.sum("new_items").alias("new_items"), F.sum("n_items").alias("n_items"))


def before_recycled(pages: DataFrame) -> DataFrame:
    """Pages of a segment before its first one without a new item; all where there is none."""
    cut = pages.where(F.col("new_items") == 0).groupBy("segment").agg(F.min("page").alias("__cut"))
    cut_known = spread_join(pages, cut, "segment", F.col("page"))
    return cut_known.where(F.col("__cut").isNull() | (F.col("page") < F.col("__cut"))).select("segment", "page", "new_items", "n_items")


def kept_pages(seen: DataFrame) -> DataFrame:
    """Pages of a segment before its first recycled page, one that shows only items of earlier pages."""
    return before_recycled(page_counts(seen))


def before_empty_streak(pages: DataFrame, streak: int = 3, ranges: int | None = None) -> DataFrame:
    """Pages of a catalog up to and with the one that completes ``streak`` empty pages in a row; error pages neither count nor break a run.

    A range of pages is summed up as the empty pages that begin it (at most ``streak`` of them, as more
    end the scan), the run that it ends with, whether an ok page broke runs, and the first streak after
    one. The fold over ranges knows the run that each begins with.
    """
    dealt = by_ranges(pages.select("catalog", "page", "result"), "catalog", ["page"], "catalog-pages", ranges)
    inside, empty, page = Window.partitionBy("catalog", RANGE), F.col("result") == "empty", F.col("page")
    run = dealt.withColumn("__ok", F.count_if(F.col("result") == "ok").over(inside.orderBy("page").rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("__run", F.count_if(empty).over(Window.partitionBy("catalog", RANGE, "__ok").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)))
    part = run.groupBy("catalog", RANGE).agg(
        (F.max("__ok") > 0).alias("__broken"), F.max(F.struct("__ok", "__run"))["__run"].alias("__tail"),
        F.collect_list(F.when(empty & (F.col("__ok") == 0) & (F.col("__run") <= streak), F.struct(F.col("__run").alias("run"), page.alias("page")))).alias("__head"),
        F.min(F.when(empty & (F.col("__ok") > 0) & (F.col("__run") == streak), page)).alias("__later"),
    )
    ranged = Window.partitionBy("catalog").orderBy(RANGE)
    part = part.withColumn("__since", F.count_if(F.col("__broken")).over(ranged.rowsBetween(Window.unboundedPreceding, 0)))
    part = part.withColumn("__end", F.sum("__tail").over(Window.partitionBy("catalog", "__since").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0)))
    part = part.withColumn("__begin", F.coalesce(F.lag("__end").over(ranged), F.lit(0)))
    completing = F.filter("__head", lambda x: x["run"] + F.col("__begin") == streak)
    part = part.withColumn("__first", F.least(F.get(completing, F.lit(0))["page"], "__later"))
    stop = part.select("catalog", RANGE, F.min("__first").over(Window.partitionBy("catalog")).alias("__stop"))
    return with_summary(dealt, stop, "catalog").where(F.col("__stop").isNull() | (page <= F.col("__stop"))).select("catalog", "page", "result")


def scan_stats(pages: DataFrame) -> DataFrame:
    """Pages read and failed of each catalog, results found, and whether the scan failed: failures and nothing found."""
    out = pages.groupBy("catalog").agg(F.count_if(F.col("result") != "error").alias("pages_ok"), F.count_if(F.col("result") == "error").alias("pages_failed"), F.count_if(F.col("result") == "ok").alias("total_found"))
    return out.withColumn("failed", (F.col("pages_failed") > 0) & (F.col("total_found") == 0))

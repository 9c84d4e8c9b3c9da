"""Market segments: adaptive partitioning, count deltas, volatility, churn, scores and budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranges import RANGE, by_ranges, with_summary


@dataclass(frozen=True)
class RefreshConfig:
    """Weights, caps and limits of refresh selection."""

    churn_cap: float = 0.05
    volatility_cap: float = 0.10
    count_cap: int = 2000
    min_churn_samples: int = 1
    weight_churn: float = 0.5
    weight_volatility: float = 0.25
    weight_count: float = 0.25
    hot: float = 0.70
    warm: float = 0.35
    warm_count: int = 1500
    gap_hours: tuple[tuple[str, int], ...] = (("hot", 24), ("warm", 72), ("cold", 168), ("unknown", 72))
    min_age_hours: int = 12
    page_size: int = 20
    max_segments: int = 50
    max_pages: int = 1500
    last_counts: int = 5
    alpha: float = 0.5


@dataclass(frozen=True)
class TreeConfig:
    """The root box and the limits of its splits: price first, then surface, by halves."""

    max_count: int = 2000
    max_depth: int = 20
    price_width: float = 10_240_000.0
    surface_width: float = 10_240.0
    min_price_width: float = 10_000.0
    min_surface_width: float = 10.0


def _halvings(width: float, least: float) -> int:
    n = 0
    while width / 2**n > least:
        n += 1
    return n


def segment_tree(rows: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """The leaves of each root: ``root, path, depth, n, is_oversized``.

    Midpoints are dyadic, so a row's whole path is known at once: bits of its price bin, then of its
    surface bin. Rows are first counted by full path, so the prefixes are exploded from counts. A
    prefix is a leaf if its parent is over the limit and it is not, or it cannot be split; a missing
    child of a split box is an empty leaf. Rows outside the root box or without a value are left out.
    """
    n_price = _halvings(config.price_width, config.min_price_width)
    n_surface = _halvings(config.surface_width, config.min_surface_width)
    length = min(n_price + n_surface, config.max_depth)

    def bits(value: str, width: float, n: int) -> Column:
        cell = F.least(F.floor(F.col(value) / F.lit(width) * F.lit(2**n)), F.lit(2**n - 1)).cast("long")
        return F.lpad(F.bin(cell), n, "0")

    inside = F.col("price").between(0, config.price_width) & F.col("surface").between(0, config.surface_width)
    full = rows.where(inside).select("root", F.substring(F.concat(bits("price", config.price_width, n_price), bits("surface", config.surface_width, n_surface)), 1, length).alias("path"))
    counted = full.groupBy("root", "path").agg(F.count(F.lit(1)).alias("n"))
    prefixes = counted.select("root", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(length)), lambda k: F.substring("path", F.lit(1), k))).alias("path"))
    boxes = prefixes.groupBy("root", "path").agg(F.sum("n").alias("n"))
    split = boxes.where((F.col("n") > config.max_count) & (F.length("path") < length)).select("root", F.col("path").alias("parent"))
    children = split.select("root", F.explode(F.array(F.concat("parent", F.lit("0")), F.concat("parent", F.lit("1")))).alias("path"))
    roots = boxes.where(F.col("path") == "").select("root", "path")
    reached = roots.unionByName(children).join(boxes, ["root", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    is_split = (F.col("n") > config.max_count) & (F.length("path") < length)
    return reached.where(~is_split).select("root", "path", F.length("path").alias("depth"), "n", (F.col("n") > config.max_count).alias("is_oversized"))


def leaf_segments(segments: DataFrame, portal: str) -> DataFrame:
    """Active leaves of a portal."""
    return segments.where((F.col("portal") == portal) & (F.col("status") == "active") & F.col("is_leaf"))


def deactivate(segments: DataFrame, portal: str) -> DataFrame:
    """All active segments of a portal become inactive, before a rebuild."""
    return segments.withColumn("status", F.when((F.col("portal") == portal) & (F.col("status") == "active"), "inactive").otherwise(F.col("status")))


# The columns that make a segment one, and those that a rebuild replaces.
BOUNDARIES = ("portal", "operation_key", "province_key", "price_min", "price_max", "surface_min", "surface_max")
REBUILT = ("total_count", "depth", "parent_id", "is_leaf", "is_oversized")


def tree_boxes(leaves: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """Adds ``price_min, price_max, surface_min, surface_max`` to the leaves of ``segment_tree``: the path's bits halve the price first, then the surface."""
    n_price = _halvings(config.price_width, config.min_price_width)

    def side(bits: Column, width: float, name: str) -> dict[str, Column]:
        step = F.lit(width) / F.pow(F.lit(2.0), F.length(bits))
        place = F.coalesce(F.conv(F.when(bits != "", bits), 2, 10).cast("double"), F.lit(0.0))
        return {f"{name}_min": place * step, f"{name}_max": (place + 1) * step}

    price, surface = F.substring("path", F.lit(1), F.lit(n_price)), F.substring("path", F.lit(n_price + 1), F.length("path"))
    return leaves.withColumns({**side(price, config.price_width, "price"), **side(surface, config.surface_width, "surface")})


def with_new_ids(segments: DataFrame) -> DataFrame:
    """The segments with ids for those that have none: numbers after the largest id, by partition and place in it, so that no task sees all of them."""
    new = materialize(segments.where(F.col("id").isNull()), "new-segments").withColumn("__p", F.spark_partition_id())
    new = materialize(new, "new-segments")  # a partition's number is part of the row from here on
    first = segments.agg(F.max("id").alias("m")).first()["m"] or 0
    starts, at = [], first
    for r in new.groupBy("__p").count().orderBy("__p").collect():  # a row a partition
        starts.append((r["__p"], at))
        at += r["count"]
    if not starts:
        return segments
    held = F.broadcast(segments.sparkSession.createDataFrame(starts, "__p int, __start long"))
    order = [F.col(c) for c in BOUNDARIES if c in segments.columns]
    numbered = new.join(held, "__p").withColumn("id", (F.col("__start") + F.row_number().over(Window.partitionBy("__p").orderBy(*order))).cast(segments.schema["id"].dataType))
    return segments.where(F.col("id").isNotNull()).unionByName(numbered.select(*segments.columns))


def apply_inheritance(segments: DataFrame, sample_cap: int, now: Column) -> DataFrame:
    """The segments after churn was inherited: churn, time of the last observation and samples (capped) of the donor."""
    taken = inherit_churn(segments, sample_cap).withColumnsRenamed({"churn_ewma": "__e", "churn_samples": "__n", "last_churn_observed_at": "__at"}).drop("donor_id")
    hit = F.col("__n").isNotNull()
    made = {"churn_ewma": F.when(hit, F.col("__e")).otherwise(F.col("churn_ewma")), "churn_samples": F.when(hit, F.col("__n")).otherwise(F.col("churn_samples")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    if "last_churn_observed_at" in segments.columns:
        made["last_churn_observed_at"] = F.when(hit, F.col("__at")).otherwise(F.col("last_churn_observed_at"))
    return segments.join(taken, "id", "left").withColumns(made).select(*segments.columns)


def rebuild(segments: DataFrame, rebuilt: DataFrame, portal: str, now: Column, sample_cap: int) -> DataFrame:
    """The segments after a new tree of a portal: all become inactive, the tree's boxes are taken up or come in with ids, and new leaves inherit churn from the smallest box around them."""
    taken = upsert_segments(deactivate(segments, portal), rebuilt, now)
    return apply_inheritance(materialize(with_new_ids(materialize(taken, "segments")), "segments"), sample_cap, now)


def upsert_segments(segments: DataFrame, rebuilt: DataFrame, now: Column) -> DataFrame:
    """The segments after a rebuild: those with the same boundaries become active again and take the new counts, others come in without an id and with no churn samples, the rest stay.

    ``rebuilt`` has a box once. Churn figures stay with their segment.
    """
    columns = [c for c in REBUILT if c in segments.columns and c in rebuilt.columns]
    new = rebuilt.select(*BOUNDARIES, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    hit = F.col("__hit").isNotNull()
    made = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns} | {"status": F.when(hit, "active").otherwise(F.col("status")), "created_at": F.coalesce("created_at", now), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    if "churn_samples" in segments.columns:
        made["churn_samples"] = F.coalesce("churn_samples", F.lit(0)).cast(segments.schema["churn_samples"].dataType)
    if "last_checked_at" in segments.columns:
        made["last_checked_at"] = F.when(hit, now).otherwise(F.col("last_checked_at"))
    return segments.join(new, list(BOUNDARIES), "full_outer").withColumns(made).select(*segments.columns)


def latest_two(snapshots: DataFrame) -> DataFrame:
    """The last two counts of each segment that has two: ``segment_id, current_count, prev_count``."""
    ranked = snapshots.withColumn("__n", F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc("captured_at"), F.desc("id")))).where(F.col("__n") <= 2)
    pair = ranked.groupBy("segment_id").agg(F.max(F.when(F.col("__n") == 1, F.col("total_count"))).alias("current_count"), F.max(F.when(F.col("__n") == 2, F.col("total_count"))).alias("prev_count"))
    return pair.where(F.col("prev_count").isNotNull() & F.col("current_count").isNotNull())


def structural_change(deltas: DataFrame, abs_limit: int = 30, pct_limit: float = 2.0, abs_high: int = 100, pct_high: float = 10.0) -> DataFrame:
    """Adds ``delta, pct, invalidate, new_priority, reason`` to ``prev_count, current_count``."""
    delta = F.col("current_count") - F.col("prev_count")
    pct = F.when(F.col("prev_count") > 0, F.abs(delta) * 100.0 / F.nullif("prev_count", F.lit(0))).when(F.col("current_count") > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    out = deltas.withColumn("delta", delta).withColumn("pct", pct)
    hit = (F.abs("delta") >= abs_limit) | (F.col("pct") >= pct_limit)
    high = (F.abs("delta") >= abs_high) | (F.col("pct") >= pct_high)
    text = F.format_string("count_delta: prev=%d current=%d delta=%+d pct=%.1f%%", "prev_count", "current_count", "delta", "pct")
    return out.withColumns({"invalidate": hit, "new_priority": F.when(hit & high, "high").when(hit, "normal"), "reason": F.when(hit, text)})


def invalidate(snapshots: DataFrame, queue: DataFrame, segments: DataFrame) -> DataFrame:
    """Finished queue rows of active leaves whose count moved enough."""
    active = segments.where((F.col("status") == "active") & F.col("is_leaf")).select(F.col("id").alias("segment_id"))
    done = queue.where(F.col("status") == "complete").select(F.col("id").alias("queue_id"), "segment_id")
    return structural_change(latest_two(snapshots).join(done, "segment_id").join(active, "segment_id", "left_semi"))


def top_delta(changed: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest moves."""
    return changed.where("invalidate").orderBy(F.abs("delta").desc(), "segment_id").limit(n)


def volatility(snapshots: DataFrame, config: RefreshConfig = RefreshConfig()) -> DataFrame:
    """Mean relative move between the last counts of each segment; 0 with fewer than two."""
    last = snapshots.withColumn("__n", F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc("captured_at"), F.desc("id")))).where(F.col("__n") <= config.last_counts)
    prev = F.lag("total_count").over(Window.partitionBy("segment_id").orderBy(F.desc("__n")))
    move = last.withColumn("__p", prev).withColumn("__m", F.when(F.col("__p") > 0, F.abs(F.col("total_count") - F.col("__p")) / F.nullif("__p", F.lit(0))).when(F.col("__p") == 0, F.when(F.col("total_count") > 0, 1.0).otherwise(0.0)))
    return move.groupBy("segment_id").agg(F.coalesce(F.avg("__m"), F.lit(0.0)).alias("count_volatility"))


def score(rows: DataFrame, config: RefreshConfig = RefreshConfig()) -> DataFrame:
    """Adds ``score`` (four digits) and ``tier`` from ``churn_ewma, churn_samples, count_volatility, total_count``.

    Samples alone are evidence, as a churn value may be inherited. The tier goes by the sum itself,
    added in the order churn, volatility, volume.
    """
    evidence = F.coalesce("churn_samples", F.lit(0)) >= config.min_churn_samples
    churn = F.when(evidence & F.col("churn_ewma").isNotNull(), F.least(F.col("churn_ewma") / config.churn_cap, F.lit(1.0))).otherwise(F.lit(0.0))
    vol = F.least(F.coalesce("count_volatility", F.lit(0.0)) / config.volatility_cap, F.lit(1.0))
    size = F.least(F.col("total_count") / config.count_cap, F.lit(1.0))
    value = config.weight_churn * churn + config.weight_volatility * vol + config.weight_count * size
    tier = F.when(~evidence, "unknown").when(value >= config.hot, "hot").when((value >= config.warm) | (F.col("total_count") >= config.warm_count), "warm").otherwise("cold")
    return rows.withColumn("tier", tier).withColumn("score", F.round(value.cast("decimal(18,10)"), 4).cast("double"))


def due(segments: DataFrame, snapshots: DataFrame, queue: DataFrame, now: Column, config: RefreshConfig = RefreshConfig()) -> DataFrame:
    """Segments to scan again: finished, scored, and older than their tier's gap, with their age, overdue ratio and pages."""
    usable = segments.where((F.col("status") == "active") & F.col("is_leaf") & ~F.col("is_oversized") & (F.col("total_count") > 0)).select(F.col("id").alias("segment_id"), "portal", "total_count", "churn_ewma", "churn_samples")
    done = queue.where(F.col("status") == "complete").select("segment_id", F.coalesce("completed_at", "updated_at", "created_at").alias("__at"))
    rows = score(usable.join(done, "segment_id").join(volatility(snapshots, config), "segment_id", "left"), config)
    gap = F.element_at(F.create_map(*[F.lit(x) for pair in config.gap_hours for x in pair]), F.col("tier")).cast("double")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("__at").cast("timestamp"))) / F.lit(3_600_000_000.0)
    rows = rows.withColumns({"age_hours": age, "gap_hours": gap})
    rows = rows.where((F.col("age_hours") >= config.min_age_hours) & (F.col("age_hours") > F.col("gap_hours")))
    return rows.withColumns({"overdue_ratio": F.col("age_hours") / F.col("gap_hours"), "estimated_pages": F.greatest(F.ceil(F.col("total_count") / config.page_size), F.lit(1)).cast("int")}).drop("__at")


def take_within_budget(rows: DataFrame, group: str, order: list[Column], max_pages: int, max_items: int | None) -> DataFrame:
    """``group, segment_id`` of the items that a greedy walk takes: one that would exceed the pages is skipped, not the end.

    Skips give budget back, so this is an ordered fold. Room only shrinks, so of the items of one
    number of pages those taken come first; no more than ``max_pages / estimated_pages`` of them fit.
    Only these go into a group's array, which thus holds about ``max_pages * ln(max_pages)`` items.
    """
    pages = F.col("estimated_pages")
    fits = F.floor(F.lit(max_pages) / F.when(pages > 0, pages))
    w = Window.partitionBy(group, "estimated_pages").orderBy(*order, F.col("segment_id"))
    rows = rows.withColumn("__n", F.row_number().over(w)).where((pages <= 0) | (F.col("__n") <= fits))
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("segment_id"), F.col("estimated_pages"))
    start = F.struct(F.lit(0).cast("long").alias("pages"), F.array().cast("array<bigint>").alias("ids"))

    def step(held: Column, x: Column) -> Column:
        room = (held["pages"] + x["estimated_pages"] <= max_pages) & ((F.size(held["ids"]) < max_items) if max_items is not None else F.lit(True))
        return F.when(room, F.struct((held["pages"] + x["estimated_pages"]).cast("long").alias("pages"), F.array_append(held["ids"], x["segment_id"].cast("bigint")).alias("ids"))).otherwise(held)

    folded = rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("__items")).select(group, F.aggregate("__items", start, step)["ids"].alias("__ids"))
    return folded.select(group, F.explode("__ids").alias("segment_id"))


def select_refresh(due_rows: DataFrame, config: RefreshConfig = RefreshConfig()) -> DataFrame:
    """The due segments that fit the budget, most overdue first."""
    taken = take_within_budget(due_rows, "portal", [-F.col("overdue_ratio"), -F.col("score"), F.col("segment_id")], config.max_pages, config.max_segments)
    return due_rows.join(taken, ["portal", "segment_id"], "left_semi")


def churn_daily(new: Column, changed: Column, found: Column, elapsed_days: Column) -> Column:
    """New and changed share of the listings found, per day of at least half a day, at most 1; null if none were found."""
    return F.when(found > 0, F.least((new + changed) / F.nullif(found, F.lit(0)) / F.greatest(elapsed_days, F.lit(0.5)), F.lit(1.0)))


def scan_outcomes(history: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each scan with the days since the one before, its churn a day (not for baselines or first scans), and the count's move.

    The scan before is looked for in the scan's own range, else it is the last one of the ranges before.
    """
    dealt = by_ranges(history, "segment_id", ["scanned_at", "id"], "scans", ranges)
    seen = F.struct(F.col("scanned_at").alias("at"), F.col("total_count").alias("total"))
    near = F.lag(seen).over(Window.partitionBy("segment_id", RANGE).orderBy("scanned_at", "id"))
    last = dealt.groupBy("segment_id", RANGE).agg(F.max_by(seen, F.struct("scanned_at", "id")).alias("__last"))
    far = last.select("segment_id", RANGE, F.lag("__last").over(Window.partitionBy("segment_id").orderBy(RANGE)).alias("__far"))
    rows = with_summary(dealt.withColumn("__near", near), far, "segment_id")
    before = F.when(F.col("__near").isNotNull(), F.col("__near")).otherwise(F.col("__far"))
    days = (F.unix_micros(F.col("scanned_at").cast("timestamp")) - F.unix_micros(before["at"].cast("timestamp"))) / F.lit(86_400_000_000.0)
    rows = rows.withColumns({"elapsed_days": days, "delta_total_count": F.col("total_count") - before["total"]})
    counts = F.col("elapsed_days").isNotNull() & (F.col("priority") != "full_scan_baseline")
    churn = F.when(counts, churn_daily(F.col("new_count"), F.col("changed_count"), F.col("listings_found"), F.col("elapsed_days")))
    return rows.select(*history.columns, "elapsed_days", "delta_total_count", churn.alias("churn"))


def churn_ewma(outcomes: DataFrame, prior: DataFrame | None = None, alpha: float = 0.5, ranges: int | None = None) -> DataFrame:
    """``segment_id, churn_ewma, churn_samples``: the exponentially weighted churn in scan order, from an inherited prior where there is one.

    A run of ``n`` scans takes a value ``v`` to ``(1 - alpha)^n v + s``, so a segment's scans are cut
    into ranges of even size, each becomes its ``n`` and ``s``, and the fold goes over the ranges, of
    which there are ``ranges`` in all; by default as many as shuffle partitions.
    """
    scans = by_ranges(outcomes.where(F.col("churn").isNotNull()).select("segment_id", "scanned_at", "id", "churn"), "segment_id", ["scanned_at", "id"], "churns", ranges)
    scans = scans.withColumnRenamed(RANGE, "__c")
    inside = Window.partitionBy("segment_id", "__c")
    placed = scans.withColumns({"__k": F.row_number().over(inside.orderBy("scanned_at", "id")), "__n": F.count(F.lit(1)).over(inside)})
    # a segment's first value counts whole where there is no prior, so it is kept apart
    weight = F.pow(F.lit(1 - alpha), F.col("__n") - F.col("__k"))
    first = F.col("__k") == 1
    part = placed.groupBy("segment_id", "__c").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(first, F.col("churn"))).alias("v"), F.sum(F.when(first, F.lit(0.0)).otherwise(alpha * weight * F.col("churn"))).alias("s"),
    )
    seen = part.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("__c", "n", "v", "s"))).alias("__s"), F.sum("n").cast("int").alias("churn_samples"))
    seen = seen.join(prior.select("segment_id", F.col("churn_ewma").alias("__prior")), "segment_id", "left") if prior is not None else seen.withColumn("__prior", F.lit(None).cast("double"))

    def step(a: Column, x: Column) -> Column:
        begun = F.when(a.isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * a)
        return F.pow(F.lit(1 - alpha), x["n"] - 1) * begun + x["s"]

    return seen.select("segment_id", F.aggregate("__s", F.col("__prior"), step).alias("churn_ewma"), "churn_samples")


def _level(low: str, high: str) -> Column:
    """The power of two that a box's width, of at least 1, does not exceed."""
    return F.ceil(F.log2(F.greatest((F.col(high) - F.col(low)).cast("double"), F.lit(1.0))))


def _cell(bound: str, level: str) -> Column:
    """The place of a bound among cells of a level's width."""
    return F.floor(F.col(bound).cast("double") / F.pow(F.lit(2.0), F.col(level)))


def inherit_churn(segments: DataFrame, sample_cap: int = 0) -> DataFrame:
    """Children without churn take it from the smallest box that contains theirs: ``id, donor_id, churn_ewma, churn_samples, last_churn_observed_at`` (null where segments have none).

    Donors share portal, operation and province. A donor lies on the few grid cells, about as wide
    as itself, that its box touches, and a child looks up the cell of its lower corner on each level
    that donors have: the join is by cell, so a province with many segments is spread, and a child
    meets only donors near it. Of donors with the same box the two smallest ids are enough, as a
    child is not its own donor. Ties go to the smallest id. A box with a null bound, or an upper
    bound below its lower one, contains and is contained in none.
    """
    keys = ["portal", "operation_key", "province_key"]
    bounds = ["price_min", "price_max", "surface_min", "surface_max"]
    proper = segments.where((F.col("price_min") <= F.col("price_max")) & (F.col("surface_min") <= F.col("surface_max")))
    same_box = Window.partitionBy(*keys, *bounds).orderBy("id")
    seen = F.col("last_churn_observed_at") if "last_churn_observed_at" in segments.columns else F.lit(None).cast("timestamp_ntz").alias("last_churn_observed_at")
    donor = proper.where(F.col("churn_ewma").isNotNull()).select("id", *keys, *bounds, "churn_ewma", "churn_samples", seen).withColumn("__n", F.row_number().over(same_box)).where(F.col("__n") <= 2)
    donor = donor.withColumns({"__p": _level("price_min", "price_max"), "__s": _level("surface_min", "surface_max")})
    levels = donor.select(*keys, "__p", "__s").distinct()
    for side, level in (("price", "__p"), ("surface", "__s")):
        donor = donor.withColumn(f"__{side}", F.explode(F.sequence(_cell(f"{side}_min", level), _cell(f"{side}_max", level))))
    child = proper.where((F.col("status") == "active") & F.col("is_leaf") & F.col("churn_ewma").isNull() & (F.col("churn_samples") == 0)).select("id", *keys, *bounds)
    child = child.join(levels, keys).withColumns({"__price": _cell("price_min", "__p"), "__surface": _cell("surface_min", "__s")})

    on = F.lit(True)
    for k in (*keys, "__p", "__s", "__price", "__surface"):
        on = on & (F.col(f"c.{k}") == F.col(f"d.{k}"))
    inside = (F.col("d.price_min") <= F.col("c.price_min")) & (F.col("d.price_max") >= F.col("c.price_max")) & (F.col("d.surface_min") <= F.col("c.surface_min")) & (F.col("d.surface_max") >= F.col("c.surface_max")) & (F.col("d.id") != F.col("c.id"))
    area = (F.col("d.price_max") - F.col("d.price_min")) * (F.col("d.surface_max") - F.col("d.surface_min"))
    best = child.alias("c").join(donor.alias("d"), on & inside).groupBy(F.col("c.id").alias("id")).agg(F.min_by(F.struct(F.col("d.id").alias("id"), F.col("d.churn_ewma").alias("e"), F.col("d.churn_samples").alias("n"), F.col("d.last_churn_observed_at").alias("at")), F.struct(area.alias("a"), F.col("d.id").alias("b"))).alias("__d"))
    return best.select("id", F.col("__d.id").alias("donor_id"), F.col("__d.e").alias("churn_ewma"), F.least(F.col("__d.n"), F.lit(sample_cap)).alias("churn_samples"), F.col("__d.at").alias("last_churn_observed_at"))


def monitor_action(old: Column, new: Column, skip: float = 0.02, partial: float = 0.10) -> Column:
    """What a change of a count asks for: null where there is no new count. A missing old count is 0."""
    old = F.coalesce(old, F.lit(0))
    ratio = F.abs(new - old) / F.nullif(old, F.lit(0))
    return F.when(new.isNull(), None).when(old == 0, F.when(new > 0, "full_scan").otherwise("skip")).when(ratio < skip, "skip").when(ratio < partial, "partial_scan").otherwise("full_scan")


def monitor_rollup(rows: DataFrame, old: str, new: str) -> DataFrame:
    """One row of counts over all segments checked. One without a new count is checked, but neither skipped nor scanned, and has no snapshot."""
    action = monitor_action(F.col(old), F.col(new))
    return rows.agg(
        F.count(F.lit(1)).alias("segments_checked"), F.count_if(action == "skip").alias("segments_skipped"), F.count_if(action == "partial_scan").alias("segments_partial_scan"),
        F.count_if(action == "full_scan").alias("segments_full_scan"), F.count(new).alias("snapshots_saved"),
    )


def parse_reason(reason: Column) -> Column:
    """The batch id of a ``key=value;…`` text; null where there is none."""
    return F.nullif(F.regexp_extract(reason, "(?:^|;)batch_id=([^;]*)", 1), F.lit(""))


def tier_of_priority(priority: Column) -> Column:
    """The tier that a refresh priority names, else null."""
    return F.nullif(F.regexp_extract(priority, "^refresh_(.*)$", 1), F.lit(""))

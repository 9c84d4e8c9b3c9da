"""Ordered work by ranges against plain loops: any number of ranges, hot keys, null keys, ties, any order of arrival."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcela.operators import lifecycle
from parcela.operators import segments as T
from parcela.operators.ranges import RANGE, by_ranges
from parcela.streaming import jobs

KINDS = ("ok", "empty", "empty", "empty", "error")


def _catalogs(rng):
    """One hot catalog, one without an ok page, one of errors, a null one, and small ones."""
    rows = [("hot", p, "ok" if p % 3 == 0 and p < 290 else rng.choice(("empty", "error"))) for p in range(400)]
    rows += [("late", p, "ok" if p % 2 else "empty") for p in range(200)] + [("late", p, "empty") for p in range(200, 210)]
    rows += [("errors", p, "error") for p in range(30)] + [(None, p, rng.choice(KINDS)) for p in range(25)]
    rows += [(f"c{c}", p, rng.choice(KINDS)) for c in range(30) for p in range(rng.randrange(1, 14))]
    return rows


def _until_streak(rows, streak):
    out = []
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    for group in groups.values():
        run = 0
        for r in sorted(group, key=lambda r: r[1]):
            out.append(r)
            run = 0 if r[2] == "ok" else run + (r[2] == "empty")
            if run == streak:
                break
    return Counter(out)


@pytest.mark.parametrize(("ranges", "streak"), [(1, 3), (7, 3), (40, 1), (40, 3), (40, 30)])
def test_empty_streak_over_ranges(spark, ranges, streak):
    rows = _catalogs(random.Random(ranges))
    made = spark.createDataFrame(rows, "catalog string, page long, result string").repartition(5)
    got = lifecycle.before_empty_streak(made, streak, ranges).collect()
    assert Counter(map(tuple, got)) == _until_streak(rows, streak)
    assert lifecycle.before_empty_streak(made.where("false"), streak, ranges).count() == 0


def test_hot_key_lies_in_many_ranges(spark):
    dealt = by_ranges(spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("n")), "k", ["n"], "hot", 16)
    sizes = [r["count"] for r in dealt.groupBy(RANGE).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 12 and max(sizes) < 1000
    spans = sorted((r["a"], r["b"]) for r in dealt.groupBy(RANGE).agg(F.min("n").alias("a"), F.max("n").alias("b")).collect())
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def _history(rng):
    start = datetime(1998, 1, 1)
    rows = [(n, 1 if n % 3 == 0 else rng.choice((2, 3, 4, None)), start + timedelta(hours=n // 2) if n % 29 else None, rng.randrange(100), rng.randrange(9), rng.randrange(9), 100, rng.choice(("normal", "full_scan_baseline"))) for n in range(300)]
    return rows, "id long, segment_id long, scanned_at timestamp_ntz, total_count int, new_count int, changed_count int, listings_found int, priority string"


@pytest.mark.parametrize("ranges", [1, 5, 60])
def test_outcomes_over_ranges(spark, ranges):
    rows, schema = _history(random.Random(4))
    by_segment = defaultdict(list)
    for r in rows:
        by_segment[r[1]].append(r)
    want = {}
    for group in by_segment.values():
        before = None
        for r in sorted(group, key=lambda r: (r[2] is not None, r[2] or datetime.min, r[0])):
            days = (r[2] - before[2]).total_seconds() / 86400 if before and before[2] and r[2] else None
            want[r[0]] = (days, r[3] - before[3] if before else None)
            before = r
    got = T.scan_outcomes(spark.createDataFrame(rows, schema).repartition(3), ranges)
    assert {r["id"]: (r["elapsed_days"], r["delta_total_count"]) for r in got.collect()} == want
    assert got.columns == [*(c.split()[0] for c in schema.split(", ")), "elapsed_days", "delta_total_count", "churn"]

    folded = {r["segment_id"]: r for r in T.churn_ewma(got, ranges=ranges).collect()}
    value, n = {}, Counter()
    for r in sorted(got.where("churn is not null").collect(), key=lambda r: (r["scanned_at"], r["id"])):
        s = r["segment_id"]
        value[s], n[s] = r["churn"] if s not in value else 0.5 * r["churn"] + 0.5 * value[s], n[s] + 1
    assert folded.keys() == value.keys() and all(abs(folded[s]["churn_ewma"] - v) < 1e-9 and folded[s]["churn_samples"] == n[s] for s, v in value.items())


def _before_recycled(rows):
    pages = defaultdict(lambda: defaultdict(set))
    for segment, page, item in rows:
        pages[segment][page].add(item)
    out = Counter()
    for segment, of in pages.items():
        seen = set()
        for page in sorted(of):
            if of[page] <= seen:
                break
            out[(segment, page, len(of[page] - seen), len(of[page]))] += 1
            seen |= of[page]
    return out


def _seen(rng):
    """A hot segment, one item on every page, recycled pages, a null segment, repeated rows."""
    rows = [("hot", p, f"i{x}") for p in range(60) for x in (*rng.sample(range(p * 4, p * 4 + 6), 3), 0)] + [("hot", 60, "i0")]
    rows += [("hot", p, f"j{p}") for p in range(61, 70)]
    rows += [(s, p, f"i{rng.randrange(25)}") for s in ("a", "b", None) for p in range(1, 15) for _ in range(3)]
    return rows + rows[::7]


def test_recycled_pages_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = _seen(rng)
    schema = "segment string, page long, item string"
    want = _before_recycled(rows)
    assert Counter(map(tuple, lifecycle.kept_pages(spark.createDataFrame(rows, schema)).collect())) == want

    rng.shuffle(rows)  # pages come in any order, some rows a second time in a later batch
    blank = [("a", None, "i1"), ("a", 3, None)]
    for k in range(4):
        spark.createDataFrame(rows[k::4] + rows[:20] + blank, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    deltas = jobs.drain(jobs.page_deltas(stream, parts=3), "update")
    assert deltas.select("batch_id").distinct().count() == 4
    assert Counter(map(tuple, jobs.kept_pages(deltas).collect())) == want


def test_recycled_state_ends(spark, tmp_path):
    """A segment that is quiet for longer than the limit starts over: what it showed before is new again."""
    schema = "segment string, page long, item string, at timestamp"
    at = datetime(1998, 1, 1)
    batches = [[("a", 1, "x", at)], [("b", 1, "y", at + timedelta(hours=30))], [("b", 2, "z", at + timedelta(hours=31))], [("a", 1, "x", at + timedelta(hours=32))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    deltas = jobs.drain(jobs.page_deltas(stream, "at", hours=24, parts=1), "update").collect()
    new = Counter((r["segment"], r["page"]) for r in deltas if r["new_items"])
    assert new == {("a", 1): 2, ("b", 1): 1, ("b", 2): 1}


def test_empty_streak_of_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = _catalogs(rng)
    rng.shuffle(rows)
    schema = "catalog string, page long, result string"
    for k in range(3):
        spark.createDataFrame(rows[k::3] + rows[:9], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.pages_read(jobs.drain(jobs.page_results(stream, 16), "update"))
    assert Counter(map(tuple, got.collect())) == _until_streak(rows, 3)

"""Golden cases of the scoring and invalidation rules, search validation, and null and tie cases."""

import hashlib
import json
import math
import random
import re
import unicodedata
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parcela.functions import text as X
from parcela.operators import facts, geo, lifecycle, ops, queue
from parcela.operators import search as S
from parcela.operators import segments as T
from parcela.operators.lifecycle import insert_if_absent
from parcela.sources.versions import VersionedTable
from parcela.streaming import jobs


@pytest.mark.parametrize(
    ("prev", "current", "priority"),
    [(1000, 1000, None), (1000, 1014, None), (1000, 1035, "normal"), (1000, 1110, "high"), (1000, 1025, "normal"), (1000, 1150, "high"), (1800, 1600, "high"), (1000, 965, "normal"), (1000, 986, None), (0, 50, "high"), (0, 0, None), (1000, 1100, "high"), (1000, 1099, "normal"), (1010, 1110, "high"), (1100, 1199, "normal")],
)
def test_structural_change(spark, prev, current, priority):
    row = T.structural_change(spark.createDataFrame([(prev, current)], "prev_count int, current_count int")).first()
    assert (row["invalidate"], row["new_priority"]) == (priority is not None, priority)


def test_structural_reason_and_top(spark):
    rows = T.structural_change(spark.createDataFrame([(1, 1250, 1410)], "segment_id int, prev_count int, current_count int"))
    assert rows.first()["reason"] == "count_delta: prev=1250 current=1410 delta=+160 pct=12.8%"
    moves = [50, 200, 30, 150, 80, 40, 300, 60, 100, 120, 90]
    many = T.structural_change(spark.createDataFrame([(i, 1000, 1000 + m) for i, m in enumerate(moves)], "segment_id int, prev_count int, current_count int"))
    assert [r["delta"] for r in T.top_delta(many).collect()] == [300, 200, 150, 120, 100, 90, 80, 60, 50, 40]


def test_inherit_churn_is_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        low, wide, floor, tall = rng.choice([0, 5, 10, 64, 100]), rng.choice([0, 1, 3, 16, 64, 100, 1000]), rng.choice([-8, 0, 7, 32]), rng.choice([0, 2, 32, 70])
        rows.append((i, rng.choice(["p", "q"]), "sale", rng.choice(["a", None]), float(low), float(low + wide), float(floor), float(floor + tall), "active", i % 3 > 0, None if i % 2 else i / 1000, 0 if i % 2 else 4))
    rows += [(240, "p", "sale", "a", None, 5.0, 0.0, 2.0, "active", True, None, 0), (241, "p", "sale", "a", 9.0, 5.0, 0.0, 2.0, "active", True, None, 0), (242, "p", "sale", "a", float("-inf"), float("inf"), -100.0, 1e6, "active", False, 0.5, 9)]
    schema = "id int, portal string, operation_key string, province_key string, price_min double, price_max double, surface_min double, surface_max double, status string, is_leaf boolean, churn_ewma double, churn_samples int"
    want = set()
    for c in (r for r in rows if r[9] and r[10] is None and r[3] and r[4] is not None and r[4] <= r[5]):
        holds = [d for d in rows if d[10] is not None and d[:4][1:] == c[:4][1:] and d[4] <= c[4] and d[5] >= c[5] and d[6] <= c[6] and d[7] >= c[7]]
        for best in sorted(holds, key=lambda d: ((d[5] - d[4]) * (d[7] - d[6]), d[0]))[:1]:
            want.add((c[0], best[0], best[10], min(best[11], 3)))
    segments = spark.createDataFrame(rows, schema)
    assert {tuple(r)[:4] for r in T.inherit_churn(segments, 3).collect()} == want
    assert len({w[1] for w in want}) > 10
    assert T.inherit_churn(segments.limit(0)).count() == 0


@pytest.mark.parametrize(("new", "changed", "found", "days", "want"), [(10, 10, 200, 1.0, 0.10), (10, 10, 200, 14.0, 0.10 / 14), (5, 5, 0, 1.0, None), (10, 10, 200, 0.01, 0.20), (200, 0, 200, 0.5, 1.0)])
def test_churn(spark, new, changed, found, days, want):
    got = spark.range(1).select(T.churn_daily(F.lit(new), F.lit(changed), F.lit(found), F.lit(days)).alias("c")).first()["c"]
    assert got is want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(
    ("ewma", "samples", "vol", "count", "tiers"),
    [(0.05, 3, 0.0, 200, {"hot", "warm"}), (0.06, 3, 0.02, 1200, {"hot"}), (0.05, 0, 0.0, 200, {"unknown"}), (None, 0, 0.08, 1800, {"unknown"}), (0.001, 2, 0.0, 100, {"cold"}), (0.001, 2, 0.0, 1600, {"warm"})],
)
def test_tiers(spark, ewma, samples, vol, count, tiers):
    rows = spark.createDataFrame([(ewma, samples, vol, count)], "churn_ewma double, churn_samples int, count_volatility double, total_count int")
    assert T.score(rows).first()["tier"] in tiers


def test_ewma_with_prior(spark):
    scans = spark.createDataFrame([(1, 1, "1998-01-01", 0.10)], "segment_id long, id long, scanned_at string, churn double")
    prior = spark.createDataFrame([(1, 0.04)], "segment_id long, churn_ewma double")
    row = T.churn_ewma(scans, prior).first()
    assert row["churn_ewma"] == pytest.approx(0.07) and row["churn_samples"] == 1


def _due(spark, pages):
    return spark.createDataFrame([("p", i + 1, n, float(-i), 0.0) for i, n in enumerate(pages)], "portal string, segment_id long, estimated_pages int, overdue_ratio double, score double")


def test_budget(spark):
    assert sorted(r["segment_id"] for r in T.select_refresh(_due(spark, [1400, 2000, 90])).collect()) == [1, 3]
    assert T.select_refresh(_due(spark, [1] * 100)).count() == 50


def test_reasons(spark):
    cols = "tier string, age_hours double, gap_hours double, score double, churn_ewma double, churn_samples int, count_volatility double, total_count int, estimated_pages int"
    rows = spark.createDataFrame([("hot", 30.5, 24.0, 0.81, 0.042, 3, 0.01, 850, 43), ("unknown", 80.0, 72.0, 0.1, None, 0, 0.0, 200, 10)], cols)
    assert [r[0] for r in rows.select(queue.refresh_reason()).collect()] == [
        "refresh:hot;age_hours=30.5;gap_hours=24.0;score=0.81;churn_ewma=0.042;churn_samples=3;count_volatility=0.01;volume=850;estimated_pages=43",
        "refresh:unknown;age_hours=80.0;gap_hours=72.0;churn_samples=0;reason=no_churn_history;estimated_pages=10",
    ]


@pytest.mark.parametrize("bad", [{"sort_by": "title"}, {"lat": 1.0}, {"lat": 91.0, "lon": 0.0, "radius_m": 1.0}, {"min_quality": 101}, {"limit": 501}, {"offset": -1}])
def test_request_validation(bad):
    with pytest.raises(ValueError):
        S.SearchRequest(**bad).validate()


def test_days_floor_below_zero(spark):
    row = spark.range(1).select(facts.days_between(F.lit("2000-01-02 12:00:00").cast("timestamp_ntz"), F.lit("2000-01-01 13:00:00").cast("timestamp_ntz")).alias("d")).first()
    assert row["d"] == -1


def test_pending_order_and_stale(spark):
    rows = spark.createDataFrame([(1, "running", "1998-01-01 00:00:00"), (2, "running", "1998-01-01 11:00:00"), (3, "running", None)], "id int, status string, locked_at string").withColumn("locked_at", F.col("locked_at").cast("timestamp_ntz"))
    done = queue.reset_stale(rows, F.lit("1998-01-01 12:00:00").cast("timestamp_ntz")).orderBy("id").collect()
    assert [r["status"] for r in done] == ["pending", "running", "running"]


def test_score_tiers_by_the_sum_itself(spark):
    """0.69995 rounds to the limit but is under it; samples alone are evidence, whatever the churn."""
    near = 0.05 * (0.69995 - 0.25 - 0.25 * 0.6) / 0.5
    rows = spark.createDataFrame([(1, near, 3, 0.10, 1200), (2, None, 3, 0.0, 1800), (3, 0.05, 0, 0.2, 2000), (4, 0.05, None, 0.2, 10)], "i int, churn_ewma double, churn_samples int, count_volatility double, total_count int")
    got = {r["i"]: (r["tier"], r["score"]) for r in T.score(rows).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "warm", 2: "warm", 3: "unknown", 4: "unknown"} and got[1][1] in (0.6999, 0.7)


def test_content_hash_is_one_for_all_number_types(spark):
    content = {"price_amount": 120000, "price_currency": "US\"D", "expenses_amount": 10.5, "surface_total": 80, "rooms": 3, "bedrooms": None, "bathrooms": 1, "garages": None, "status": "active", "seller_id": "ñ1"}
    want = hashlib.sha256(json.dumps(content, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    rows = spark.range(1).select(F.lit("US\"D").alias("price_currency"), F.lit("active").alias("status"), F.lit("ñ1").alias("seller_id"), F.lit(1).alias("bathrooms"), F.lit(3).cast("long").alias("rooms"))
    for price, surface, expenses in (("decimal(18,2)", "double", "double"), ("double", "int", "decimal(12,4)"), ("string", "decimal(9,3)", "string")):
        typed = rows.select("*", F.lit(120000).cast(price).alias("price_amount"), F.lit(80).cast(surface).alias("surface_total"), F.lit("10.50").cast(expenses).alias("expenses_amount"))
        assert typed.select(lifecycle.content_hash(typed.columns)).first()[0] == want


def test_merge_carries_the_whole_payload(spark):
    at = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    cols = "id long, source_id long, external_id string, canonical_url string, generated_title string, status string, price_amount decimal(18,2), rooms int"
    old = spark.createDataFrame([(7, 1, "a", "u", "t", "active", 5, 2), (8, 1, "b", "u", "t", "active", 5, 2)], cols.replace("decimal(18,2)", "int")).withColumn("price_amount", F.col("price_amount").cast("decimal(18,2)"))
    for c in ("first_seen_at", "last_seen_at", "last_changed_at"):
        old = old.withColumn(c, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    new = spark.createDataFrame([(1, "a", "u2", "t\0 2", "active", 5.0, 2, 1, 1), (1, "b", "u2", "t2", "active", 6.0, None, 1, 2), (1, "c", "u3", "t3", "paused", 1.5, 1, 1, 3)], "source_id long, external_id string, canonical_url string, generated_title string, status string, price_amount double, rooms int, page int, position int")
    got = {r["external_id"]: r for r in lifecycle.merge(old, new, at).collect()}
    pick = lambda k: tuple(got[k][c] for c in ("id", "canonical_url", "generated_title", "price_amount", "rooms"))
    assert pick("a") == (7, "u", "t", 5, 2) and pick("b") == (8, "u2", "t2", 6, None) and pick("c")[0] is None and pick("c")[1:4] == ("u3", "t3", Decimal("1.50"))
    assert got["a"]["last_changed_at"].year == 1998 and got["b"]["last_changed_at"].year == 1999 and got["a"]["last_seen_at"].year == 1999
    assert {r["external_id"]: r["canonical_url"] for r in lifecycle.snapshots(lifecycle.classify(old, new), at).collect()} == {"b": "u2", "c": "u3"}


def test_stream_merge_replays_batches(spark, tmp_path):
    """Three batches, then the last one again from its start: the same tables as plain merges one after the other."""
    now = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    cols = "source_id long, external_id string, status string, price_amount double, generated_title string, page int, position int"
    batches = [[(1, "a", "active", 1.0, "x", 1, 1)], [(1, "a", "active", 2.0, "y", 1, 1), (1, "b", "active", 1.0, "z", 1, 2)], [(1, "b", "active", 1.0, "later", 1, 1)]]
    start = spark.createDataFrame([], "source_id long, external_id string, status string, price_amount double, generated_title string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, last_changed_at timestamp_ntz, content_hash string")
    table = VersionedTable(spark, f"file://{tmp_path}/current", start.schema, list(lifecycle.KEYS), 8)
    want = start
    for k, rows in enumerate(batches):
        made = spark.createDataFrame(rows, cols)
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.merge_batches(spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/snapshots", f"{tmp_path}/checkpoint", now).awaitTermination()
        want = spark.createDataFrame(lifecycle.merge(want, made, now).select(start.columns).collect(), start.schema)
    assert table.version() == len(batches) and table.mark() == len(batches) - 1
    once = sorted(map(tuple, table.read().collect()))
    assert table.read(1).count() == 1
    assert once == sorted(map(tuple, want.select(start.columns).collect())) and [r[4] for r in once] == ["y", "z"]
    for name in (str(len(batches) - 1), f".{len(batches) - 1}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    jobs.merge_batches(spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/snapshots", f"{tmp_path}/checkpoint", now).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == once and table.version() == len(batches)
    assert spark.read.parquet(f"{tmp_path}/snapshots").count() == 3


def test_versioned_table_merges_and_conflicts(spark, tmp_path):
    """Untouched buckets keep their files, two writers of one id leave it once, a lost job leaves nothing visible, an empty bucket stays empty."""
    rows = spark.range(100).select(F.col("id"), F.lit("old").alias("v"))
    table = VersionedTable(spark, f"file://{tmp_path}/t", rows.schema, ["id"], 16)
    assert table.read().count() == 0 and table.append_new(rows.where("false")) == 0
    assert table.append_new(rows.union(rows)) == 1 and table.read().count() == 100
    one = spark.createDataFrame([(7, "new")], rows.schema)
    before = {r["bucket"]: r["path"] for r in table.files().collect()}
    table.merge(one, lambda cur, new: cur.join(new, "id", "left_anti").union(new))
    after = {r["bucket"]: r["path"] for r in table.files().collect()}
    changed = {b for b in after if before[b] != after[b]}
    assert len(changed) == 1 and {r["v"] for r in table.read().where("id = 7").collect()} == {"new"} and table.read().count() == 100 and table.read(1).where("v = 'new'").count() == 0
    other = VersionedTable(spark, f"file://{tmp_path}/t", rows.schema, ["id"], 16)
    calls = []

    def slow(current, new):
        calls.append(1)
        if len(calls) == 1:  # another writer comes first with the same id
            other.append_new(spark.createDataFrame([(500, "other")], rows.schema))
        return insert_if_absent(current, new, ["id"])

    version = table.version()
    table.merge(spark.createDataFrame([(500, "mine"), (501, "mine")], rows.schema), slow)
    assert len(calls) == 2 and table.version() == version + 2 and sorted(tuple(r) for r in table.read().where("id >= 500").collect()) == [(500, "other"), (501, "mine")]

    def lost(current, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.merge(one, lost)
    assert table.version() == version + 2 and table.read().count() == 102
    table.merge(one, lambda cur, new: cur.where("false"))
    assert table.read(buckets=sorted(changed)).count() == 0 and table.read().count() < 102 and table.append_new(one) == table.version()
    assert table.merge(one, lambda cur, new: new, mark=3) == table.merge(one, lambda cur, new: new, mark=3) == table.version()


def test_incremental_facts_equal_the_full_build(spark):
    """Three generations in random order of arrival: the merged histories equal those of all snapshots, and without late rows no old snapshot is read."""
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 12)), datetime(1999, 1, 1) + timedelta(hours=int(rng.integers(0, 40))), Decimal(int(rng.integers(1, 4))) if rng.random() < 0.9 else None, "USD" if rng.random() < 0.8 else "ARS") for i in range(300)]
    table = spark.createDataFrame(rows, "id long, listing_id long, captured_at timestamp_ntz, price_amount decimal(18,2), price_currency string")
    columns = facts.price_history(table).columns
    want = sorted(map(tuple, facts.price_history(table).collect()), key=str)
    assert sorted(map(tuple, facts.history_of(facts.history_state(table)).select(columns).collect()), key=str) == want
    shuffled = table.withColumn("g", F.col("id") % 3)
    state = facts.history_state(shuffled.where("g = 0"))
    for g in (1, 2):
        state = facts.advance_history(state, shuffled.where(f"g = {g}"), shuffled.where(f"g <= {g}"))
    assert sorted(map(tuple, facts.history_of(state).select(columns).collect()), key=str) == want
    early, late = table.where("captured_at < '1999-01-02'"), table.where("captured_at >= '1999-01-02'")
    unread = spark.createDataFrame([], table.schema).withColumn("price_amount", F.expr("cast(raise_error('old snapshots were read') as decimal(18,2))"))
    merged = facts.advance_history(facts.history_state(early), late, unread)
    assert sorted(map(tuple, facts.history_of(merged).select(columns).collect()), key=str) == want


def test_histories_of_a_stream_in_any_order(spark, tmp_path):
    """Snapshots in three shuffled batches, late ones among them, the last batch twice: the same histories as the batch form."""
    rng = np.random.default_rng(12)
    rows = [(i, int(rng.integers(0, 9)), datetime(1999, 1, 1) + timedelta(hours=int(rng.integers(0, 50))), Decimal(int(rng.integers(1, 4))), "USD" if rng.random() < 0.8 else "ARS") for i in range(120)]
    table = spark.createDataFrame(rows, "id long, listing_id long, captured_at timestamp_ntz, price_amount decimal(18,2), price_currency string")
    states = VersionedTable(spark, f"file://{tmp_path}/states", facts.history_state(table).schema, ["listing_id"], 4)
    start = lambda: jobs.merge_histories(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), states, f"file://{tmp_path}/kept", f"{tmp_path}/checkpoint").awaitTermination()
    for k in range(3):
        table.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start()
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    start()
    columns = facts.price_history(table).columns
    assert sorted(map(tuple, facts.history_of(states.read()).select(columns).collect()), key=str) == sorted(map(tuple, facts.price_history(table).collect()), key=str)
    assert states.version() == 3 and spark.read.parquet(f"{tmp_path}/kept").count() == 120


def test_rebuilt_segments_inherit_churn(spark):
    """Split parents with churn: their halves come in with ids and no samples, and inherit churn, time and capped samples; then the first observation mixes with the prior. A loop over all pairs says the same."""
    seen, old = datetime(1999, 1, 5), datetime(1999, 1, 1)
    cols = "id long, portal string, operation_key string, province_key string, depth int, price_min double, price_max double, surface_min double, surface_max double, total_count int, is_leaf boolean, is_oversized boolean, status string, churn_ewma double, churn_samples int, last_churn_observed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
    box = lambda i, a, b, churn, n, k="v": (i, "p", k, "x", 1, a, b, 0.0, 10.0, 5, True, False, "active", churn, n, seen if churn else None, old, old)
    known = spark.createDataFrame([box(1, 0.0, 100.0, 0.04, 9), box(2, 100.0, 200.0, None, 0), box(7, 0.0, 400.0, 0.5, 1), box(9, 0.0, 100.0, 0.3, 5, "w"), (20, "other", *box(20, 0.0, 50.0, None, 0)[2:])], cols)
    tree = [("p", "v", "x", a, b, 0.0, 10.0, 3, 2, True, False) for a, b in ((0.0, 50.0), (50.0, 100.0), (100.0, 200.0), (200.0, 500.0))]
    rebuilt = spark.createDataFrame(tree, "portal string, operation_key string, province_key string, price_min double, price_max double, surface_min double, surface_max double, total_count int, depth int, is_leaf boolean, is_oversized boolean").repartition(3)
    out = T.rebuild(known, rebuilt, "p", F.lit("1999-02-01 00:00:00").cast("timestamp_ntz"), 2).collect()
    got = {(r["portal"], r["operation_key"], r["price_min"], r["price_max"]): (r["status"], r["churn_ewma"], r["churn_samples"], r["last_churn_observed_at"]) for r in out}
    assert got == {
        ("p", "v", 0.0, 100.0): ("inactive", 0.04, 9, seen), ("p", "v", 100.0, 200.0): ("active", 0.5, 1, seen), ("p", "v", 0.0, 400.0): ("inactive", 0.5, 1, seen), ("p", "w", 0.0, 100.0): ("inactive", 0.3, 5, seen), ("other", "v", 0.0, 50.0): ("active", None, 0, None),
        ("p", "v", 0.0, 50.0): ("active", 0.04, 2, seen), ("p", "v", 50.0, 100.0): ("active", 0.04, 2, seen), ("p", "v", 200.0, 500.0): ("active", None, 0, None),
    }
    ids = {r["id"] for r in out}
    assert len(ids) == 8 and None not in ids and {1, 2, 7, 9, 20} < ids and min(ids - {1, 2, 7, 9, 20}) == 21 and max(ids) == 23
    child = next(r for r in out if r["price_max"] == 50.0 and r["portal"] == "p")
    first = spark.createDataFrame([(child["id"], 1, datetime(1999, 2, 2), 0.1)], "segment_id long, id long, scanned_at timestamp_ntz, churn double")
    prior = spark.createDataFrame([(child["id"], child["churn_ewma"])], "segment_id long, churn_ewma double")
    assert T.churn_ewma(first, prior).first()["churn_ewma"] == pytest.approx(0.5 * 0.1 + 0.5 * 0.04)


def test_tree_boxes(spark):
    config = T.TreeConfig(price_width=8.0, surface_width=4.0, min_price_width=2.0, min_surface_width=2.0)
    leaves = spark.createDataFrame([("r", ""), ("r", "1"), ("r", "01"), ("r", "110"), ("r", "101")], "root string, path string")
    got = {r["path"]: (r["price_min"], r["price_max"], r["surface_min"], r["surface_max"]) for r in T.tree_boxes(leaves, config).collect()}
    assert got == {"": (0, 8, 0, 4), "1": (4, 8, 0, 4), "01": (2, 4, 0, 4), "110": (6, 8, 0, 2), "101": (4, 6, 2, 4)}


def test_radius_by_place(spark, tmp_path):
    """The same rows as all distances, at the antimeridian, at a pole and on edges too, from fewer row groups."""
    rng = np.random.default_rng(13)
    points = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(3000)] + [(5000 + i, float(-34.6 + rng.normal() / 20), float(-58.4 + rng.normal() / 20)) for i in range(2000)]
    points += [(9000 + i, float(rng.normal() / 10), float(180 - abs(rng.normal()) / 10) * (1 if i % 2 else -1)) for i in range(500)] + [(9900, 90.0, 180.0), (9901, -90.0, -180.0), (9902, 0.0, 180.0), (9903, None, 1.0), (9904, 1.0, None)]
    table = spark.createDataFrame(points, "id long, latitude double, longitude double")
    path = f"{tmp_path}/places"
    geo.write_by_place(table, f"file://{path}", 32)
    held = [g for f in sorted((tmp_path / "places").glob("*.parquet")) for m in [pq.ParquetFile(f).metadata] for g in [m.row_group(k).column(m.schema.names.index(geo.KEY)).statistics for k in range(m.num_row_groups)]]
    assert len(held) >= 24
    for lat, lon, radius in ((-34.6, -58.4, 3000), (-34.6, -58.4, 50_000), (0.0, 179.99, 20_000), (0.0, -180.0, 15_000), (89.9, 10.0, 300_000), (12.0, 13.0, 900_000), (-34.6, -58.4, 1)):
        def far(p, lat=lat, lon=lon):
            a = math.sin(math.radians(p[1] - lat) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(lat)) * math.sin(math.radians(p[2] - lon) / 2) ** 2
            return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(a)))

        want = {p[0] for p in points if None not in p and far(p) <= radius}
        assert {r["id"] for r in geo.within_radius(spark, f"file://{path}", lat, lon, radius).collect()} == want
        ranges = geo.key_ranges(lat, lon, radius)
        assert len(ranges) <= 128
        if radius <= 20_000:
            assert sum(any(s.has_min_max and s.min <= b and s.max >= a for a, b in ranges) for s in held) < len(held) / 2
    plan = geo.within_radius(spark, f"file://{path}", -34.6, -58.4, 3000)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def test_slugs_by_decomposition(spark):
    texts = ["Łódź ½ ﬁn", "Ñandú  Árbol!", "Ⅷ ㎏ Ａｂ", "ß æ", "", "--x--"]
    want = ["-".join(re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower())) for t in texts]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.slugify(F.col("t"))).collect()] == want


def test_queue_outcomes_take_counters(spark):
    cols = "segment_id long, status string, attempt_count int, completed_at timestamp_ntz, locked_at timestamp_ntz, updated_at timestamp_ntz, started_at timestamp_ntz, last_error string, pages_scanned int, avg_latency_ms double, cooldown_triggered boolean, timeouts int"
    rows = spark.createDataFrame([(i, "running", 1, None, None, None, None, "old", 9, 1.0, True, 7) for i in range(1, 6)], cols)
    done = spark.createDataFrame([(1, "complete", 4, 2.5, None), (2, "failed", None, None, "boom"), (3, "pending", None, None, None), (4, "started", None, None, None)], "segment_id long, outcome string, pages_scanned int, avg_latency_ms double, last_error string")
    got = {r["segment_id"]: r for r in queue.apply_outcomes(rows, done, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).collect()}
    pick = lambda i: tuple(got[i][c] for c in ("status", "last_error", "pages_scanned", "avg_latency_ms", "cooldown_triggered", "timeouts", "attempt_count"))
    assert pick(1) == ("complete", "old", 4, 2.5, False, 0, 1) and pick(2) == ("pending", "boom", 9, 1.0, True, 7, 2)
    assert pick(3)[:2] == ("pending", "old") and got[4]["started_at"].year == 1999 and pick(5) == ("running", "old", 9, 1.0, True, 7, 1) and got[5]["updated_at"] is None


def test_empty_batch_rate(spark):
    assert ops.batch_summary(spark.createDataFrame([], "b int, f boolean"), "b", F.col("f")).count() == 0


def test_resume_keeps_blank_ids(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "k string")
    assert lifecycle.resume(rows, spark.createDataFrame([("a",), ("",), (None,)], "k string"), "k").count() == 2


def test_text_functions(spark):
    row = spark.range(1).select(X.slugify(F.lit("Ñandú  Árbol!")), X.ar_number(F.lit("USD 1.250,5")), X.rooms_text(F.lit(1)), X.rooms_text(F.lit(4)), X.coordinate(F.lit(-346037000.0), 90)).first()
    assert tuple(row) == ("nandu-arbol", 1250.5, "1 dormitorio", "3 dormitorios", -34.6037)


def test_stale_work_timer(spark, tmp_path):
    rows = [(1, "started", "1998-01-01 00:00:00"), (2, "started", "1998-01-01 00:00:00"), (2, "complete", "1998-01-01 01:00:00"), (3, "complete", "1998-01-03 00:00:00")]
    made = spark.createDataFrame(rows, "segment_id long, status string, at string").withColumn("at", F.col("at").cast("timestamp"))
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.drain(jobs.stale_work(spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))), "update")
    assert [(r["segment_id"], r["status"]) for r in out.collect()] == [(1, "pending")]


def _bounded_lists(monkeypatch, most):
    """A collected array of more than ``most`` items fails the query."""
    collect = F.collect_list
    monkeypatch.setattr(F, "collect_list", lambda c: F.when(F.count(F.lit(1)) > most, F.raise_error(F.lit("long array"))).otherwise(collect(c)))


def test_ewma_in_chunks(spark, monkeypatch):
    """Against a plain fold, with and without prior, ties and one segment of most scans; no array of all scans."""
    churn = lambda i: (i * 7919 % 1000) / 1000
    rows = [(1 if i % 10 else 2, i, i * 37 % 2000, churn(i)) for i in range(2000)] + [(3, 5000, 4, 0.25), (4, 5001, 4, None)]
    scans = spark.createDataFrame(rows, "segment_id long, id long, s long, churn double").withColumn("scanned_at", F.timestamp_seconds("s")).drop("s")
    for given in ({}, {1: 0.9, 3: 0.5}):
        want = {}
        for seg in (1, 2, 3):
            v = given.get(seg)
            for _, _, c in sorted((at, i, c) for g, i, at, c in rows if g == seg):
                v = c if v is None else 0.3 * c + 0.7 * v
            want[seg] = v
        prior = spark.createDataFrame(list(given.items()), "segment_id long, churn_ewma double") if given else None
        with monkeypatch.context() as m:
            _bounded_lists(m, 200)
            got = {r["segment_id"]: (r["churn_ewma"], r["churn_samples"]) for r in T.churn_ewma(scans, prior, 0.3).collect()}
        assert got == {g: (pytest.approx(v, abs=1e-12), sum(r[0] == g for r in rows)) for g, v in want.items()}


@pytest.mark.parametrize("most", [None, 7])
def test_budget_arrays_are_bounded(spark, monkeypatch, most):
    """The greedy walk over 3,000 candidates of a portal, whose array holds only what may fit."""
    pages = [i * 7919 % 45 + 1 for i in range(3000)]
    room, taken = 60, []
    for i, n in enumerate(pages):
        if n <= room and (most is None or len(taken) < most):
            room, taken = room - n, [*taken, i + 1]
    _bounded_lists(monkeypatch, 300)
    got = T.take_within_budget(_due(spark, pages), "portal", [-F.col("overdue_ratio")], 60, most).collect()
    assert sorted(r["segment_id"] for r in got) == sorted(taken)


def test_monitor_counts(spark):
    rows = spark.createDataFrame([(1, 100, 101), (2, 100, 105), (3, 100, 110), (4, None, 3), (5, 0, 0), (6, 50, None)], "id int, old long, new long")
    assert tuple(T.monitor_rollup(rows, "old", "new").first()) == (6, 2, 1, 2, 5)

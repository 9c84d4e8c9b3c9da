"""Work is dealt by what a row makes, and memory does not follow a batch."""

from __future__ import annotations

import re
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcela.operators import ops
from parcela.plans import ingest, registry, streams
from parcela.plans.views import view
from parcela.session import spread
from parcela.sources import elements, pages
from parcela.streaming import jobs


@pytest.fixture(scope="module")
def large(spark, sf_dir, tmp_path_factory):
    """The part table thirty times under shifted keys, in one file."""
    root = tmp_path_factory.mktemp("large")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    copies = spark.range(30).withColumnRenamed("id", "copy")
    part.crossJoin(copies).withColumn("p_partkey", F.col("p_partkey") + F.col("copy") * 100_000).drop("copy").coalesce(1).write.parquet(f"{root}/part.parquet")
    return str(root)


@pytest.mark.parametrize("rows", [ingest.made_pages, ingest._hidden, ingest._spans, ingest.raw_postings])
def test_one_file_of_listings_is_several_tasks(spark, large, rows):
    sizes = [len(p) for p in rows(spark, large).select("id").rdd.glom().collect()]
    total = spark.read.parquet(f"{large}/part.parquet").count()
    assert sum(sizes) == total and max(sizes) < total / 2


def test_trees_of_a_batch_hold_little_beside_their_columns():
    html = pa.array([f"<div class='a{i}'>" + "<p id=x>text</p>" * 50 + "</div>" for i in range(1500)])
    tracemalloc.start()
    made = elements._trees(html)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 1500 and peak < 8_000_000


def test_trees_without_scripts_differ_in_literals_only():
    html = pa.array(["<script>tier = '1'</script><p>a &amp; b</p>", None])
    whole, bare = elements._trees(html), elements._bare_trees(html)
    assert [len(x) for x in whole.field("literals")] == [1, 0] and [len(x) for x in bare.field("literals")] == [0, 0]
    assert whole.field("nodes").equals(bare.field("nodes")) and whole.field("texts").equals(bare.field("texts"))


def test_streamed_prices_by_ranges_equal_a_fold(spark, tmp_path):
    """Batches of snapshots in any order, with ids far apart and null, late ones and other currencies: a plain fold a listing says the same after each batch; a range is one record of state."""
    rng = np.random.default_rng(5)
    ids = [0, 1, 2, 999, 1000, 5_000_000_000, -3, None]
    rows = [(i, ids[int(rng.integers(0, len(ids)))], datetime(1999, 1, 1) + timedelta(hours=int(rng.integers(0, 30))), float(rng.integers(1, 4)) if rng.random() < 0.9 else None, "USD" if rng.random() < 0.8 else "ARS") for i in range(240)]
    schema = "id long, listing_id long, captured_at timestamp_ntz, price double, price_currency string"
    dealt = [rows[0::3], rows[1::3], [r for r in rows[2::3] if r[1] in (1, 2)]]
    for batch in dealt:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = jobs.drain(jobs.price_history(stream), "update")
    want, state = [], {}
    for n, batch in enumerate(dealt):
        for key in {r[1] for r in batch}:
            first, last, low, high, changes, at_last, late = state.get(key, (None, None, None, None, 0, datetime(1970, 1, 1), 0))
            for i, _, at, price, currency in sorted((r for r in batch if r[1] == key and r[4] == "USD" and r[3] is not None), key=lambda r: (r[2], r[0])):
                if at < at_last:
                    late += 1
                    continue
                changes += last is not None and price != last
                first, low, high, last, at_last = price if first is None else first, price if low is None else min(low, price), price if high is None else max(high, price), price, at
            if first is not None:
                state[key] = (first, last, low, high, changes, at_last, late)
                want.append((key, first, last, low, high, changes, late, n))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert any(w[6] for w in want)
    query = jobs.price_history(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, n: batch.collect()).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len({None if i is None else i // 1000 for i in ids})


def test_batches_of_a_dealt_stream_are_written_by_all_tasks(spark):
    """Eight tasks' rows come in three batches of several files; no file holds a whole part."""
    rows = spark.range(0, 3000, 1, 8).withColumn("page", F.col("id") % 30)
    stream = streams._in_files(spark, rows, "page")
    out = jobs.drain(stream.withColumn("file", F.col("_metadata.file_path")), "append")
    batches = out.groupBy("batch_id").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n")).collect()
    assert len(batches) == 3 and all(b["files"] == 8 for b in batches) and sum(b["n"] for b in batches) == 3000


def test_a_bucket_does_not_grow_with_the_table(spark):
    assert [streams._buckets(spark.range(n), 100) for n in (1, 800, 801, 5000)] == [8, 8, 9, 50]


def test_a_listings_whole_history(spark, sf_dir):
    """More snapshots than a page holds, none left out; a page is still what it was."""
    rows = spark.range(150).selectExpr("id", "7L as listing_id", "timestamp_ntz'1999-01-01' + make_dt_interval(0, int(id div 2)) as captured_at")
    assert [r["id"] for r in ops.snapshots_of(rows, 7, None).collect()] == list(range(149, -1, -1))
    assert [r["id"] for r in ops.snapshots_of(rows, 7, 12, 4).collect()] == list(range(145, 133, -1))
    assert registry.QUERIES["listing_snapshots"](spark, sf_dir).count() == view(spark, sf_dir, "snapshots").where("listing_id = 7").count()


def test_numbers_beside_pictures(spark):
    html = "<span><img src='/img/ico_banios.png'><b>2</b></span><span><img src='/img/ico_cocheras.png'> {} </span>"
    rows = spark.createDataFrame([(html.format("--"),), (html.format("3"),), ("",)], "html string")
    got = [tuple(r) for r in pages.icon_images(rows).select("image_bathrooms", "image_garages", "image_garage").collect()]
    assert got == [(2, None, False), (2, 3, True), (None, None, False)]


def test_trees_leave_a_batch_some_pages_at_a_time():
    """What a task holds beside its pages does not follow the batch, in Python and in Arrow."""
    html = pa.array([f"<div class='a{i}'>" + "<p id=x>text</p>" * 200 + "</div>" for i in range(3000)])
    held, most, rows = pa.total_allocated_bytes(), 0, 0
    for made in elements._pieces([html, html.slice(0, 0)], elements.NAMES):
        rows += len(made)
        most = max(most, pa.total_allocated_bytes() - held)
    assert rows == 3000 and most < elements._trees(html).nbytes / 10


def test_trees_with_less_are_parts_of_whole_ones():
    html = "a<div class=x>b<script>tier = '1'; videos = []</script><p><a href=/u>c &amp; <b>d</b></a><style>e</style></p></div>f"
    made = lambda *args: next(elements._pieces([pa.array([html])], *args)).to_pylist()[0]
    whole, some, none = made(elements.NAMES), made(("videos",), frozenset(("script", "a")), False), made((), frozenset())
    place = lambda n: (n["tag"], n["attrs"], n["start"], n["stop"])
    assert [place(n) for n in some["nodes"]] == [place(n) for n in whole["nodes"] if n["tag"] in ("script", "a")] and [n["parent"] for n in some["nodes"]] == [None, None]
    assert some["texts"] == [t for t in whole["texts"] if t["raw"] and "tier" in t["text"]] and some["literals"] == [v for v in whole["literals"] if v["name"] == "videos"]
    assert none == {"nodes": [], "texts": [t for t in whole["texts"] if not t["raw"]], "literals": []}


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_data_script_is_read_once_for_a_path(spark):
    """Eight places of a listing, and two coordinates of two names at five places."""
    rows = spark.createDataFrame([("", "u")], "html string, url string")
    assert _plan(pages.next_data(rows)).count("get_json_object(") <= 8 + 20


def test_a_features_number_is_worked_out_once(spark):
    rows = spark.createDataFrame([("", "u")], "html string, url string")
    assert _plan(pages.features(rows)).count("split(") <= 4


def test_a_phrase_and_a_publisher_are_found_once(spark):
    rows = spark.createDataFrame([("", "u")], "html string, url string")
    plan = _plan(pages.inline_variables(rows))
    assert plan.count("= antiquity") == 1 and plan.count("= publisher") == 1


def test_icons_are_picked_once_from_a_page(spark):
    rows = spark.createDataFrame([("", "u")], "html string, url string")
    assert _plan(pages.icon_features(rows)).count(" = i)") == 1


def test_a_published_phrase_is_looked_for_once(spark):
    rows = spark.createDataFrame([("", "u")], "html string, url string")
    assert _plan(pages.text_fields(rows)).count("Publicado") == 1


def test_nothing_is_searched_around_an_element_that_is_not_there(spark):
    t, rows = elements.Tree(), elements.with_tree(spark.createDataFrame([("<p><b>x</b></p>",)], "html string"))
    missing = t.first(elements.tagged("i"))
    assert rows.select(t.around(missing, lambda n: F.raise_error(F.lit("searched")).cast("boolean")).isNull()).first()[0]


def test_a_picture_and_its_text_are_found_once(spark):
    rows = spark.createDataFrame([("", "u")], "html string, url string")
    plan = _plan(pages.icon_images(rows))
    assert [plan.count(f"ico_{name}") for name in ("banio", "cocheras", "precio_us", "mt2cub", "dire")] == [1] * 5


def test_a_text_is_evaluated_once_where_it_may_be_empty(spark):
    rows = spark.createDataFrame([("",), (" ",), ("a",), (None,)], "html string").select(elements.some(F.upper("html")).alias("x"))
    assert _plan(rows).count("upper(") == 1 and [r[0] for r in rows.collect()] == [None, " ", "A", None]


def test_texts_are_trimmed_once_as_a_whole(spark):
    """Blanks of any kind at and between the parts, parts of blanks only, scripts and missing elements."""
    t, html = elements.Tree(), " x <p> \n<b>\ta </b> <i> </i>b  c<script>d</script> </p> y\r\n<p> </p>"
    rows = elements.with_tree(spark.createDataFrame([(html,), ("",)], "html string"))
    paragraphs = t.all(elements.tagged("p"))
    got = rows.select(t.body().alias("body"), t.text(F.get(paragraphs, F.lit(0))).alias("first"), t.text(F.get(paragraphs, F.lit(1))).alias("second"), t.strings(F.get(paragraphs, F.lit(0))).alias("parts"))
    assert [tuple(r) for r in got.collect()] == [("x a b c y", "a b c", "", ["a", "b  c"]), ("", None, None, None)]
    assert _plan(got.select("body", "first")).count("regexp_replace(") == 2


def test_tasks_of_a_large_table_take_more_rows(spark):
    made = lambda n: int(re.search(r"RepartitionByExpression \[id#\d+L\], (\d+)", _plan(spread(spark.range(n), "id")))[1])
    assert [made(n) for n in (2001, 400_000, 1_600_000, 1_600_001, 7_200_000)] == [2, 200, 200, 201, 900]

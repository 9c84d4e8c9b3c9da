"""Document fingerprints by winnowing, in native expressions.

Every run of ``gram`` bytes of a text's UTF-8 form has a 64-bit hash; of each ``window`` consecutive
ones the smallest is kept, the rightmost of equal ones, with its position. Any passage of
``gram + window - 1`` bytes that two texts share therefore gives both a common hash.

A gram is kept exactly if the distance between the next smaller hash on its left and the next
smaller or equal one on its right exceeds the window, which one fold with a stack finds. The fold
sees only low hashes (some ``candidates`` a window), and all of them in stretches of a window or more
that hold no low one, so that it runs over a small part of a text and the result is exact. Texts are
cut into pieces of windows, so memory is bounded by a piece.

Neighbours by id come without a global sort of the texts: cuts are read from the ids and digests
alone, each chunk of consecutive rows is one window group, and the first row of a chunk goes to the
chunk before it too. The texts are shuffled once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize
from .common import let


@dataclass(frozen=True)
class WinnowConfig:
    """``gram`` and ``window`` in bytes and grams. ``chunk_rows``: distinct rows of a chunk, more where there would be over ``most_chunks``. Rows that occur over ``repeats`` times are collapsed before they move."""

    gram: int = 24
    window: int = 80
    candidates: int = 6
    piece: int = 2048
    chunk_rows: int = 128
    most_chunks: int = 1 << 16
    repeats: int = 100


def _hash(data: Column, at: Column, config: WinnowConfig) -> Column:
    """Hash of the gram at a place counted from 0."""
    return F.xxhash64(F.substring(data, at + 1, F.lit(config.gram)))


def _kept(data: Column, first: Column, last: Column, window: Column, config: WinnowConfig) -> Column:
    """Places that windows inside the grams ``first`` to ``last`` keep."""
    low = F.lit(min(2**63 - 1, -(2**63) + 2**64 * config.candidates // config.window))

    def with_gaps(found: Column) -> Column:
        ends = F.arrays_zip(F.concat(F.array(first - 1), found).alias("a"), F.concat(found, F.array(last + 1)).alias("b"))
        gaps = F.filter(ends, lambda e: e["b"] - e["a"] > window)
        return F.when(F.size(gaps) == 0, found).otherwise(F.array_sort(F.concat(found, F.flatten(F.transform(gaps, lambda e: F.sequence(e["a"] + 1, e["b"] - 1))))))

    def step(state: Column, x: Column) -> Column:
        stay = F.filter(state["stack"], lambda d: d["h"] < x["h"])
        gone = F.filter(state["stack"], lambda d: (d["h"] >= x["h"]) & (x["p"] - d["left"] > window))
        below = F.coalesce(F.get(state["stack"], F.size(stay) - 1)["p"], first - 1)  # hashes rise along the stack
        pushed = F.struct(x["h"].alias("h"), x["p"].alias("p"), below.alias("left"))
        return F.struct(F.concat(stay, F.array(pushed)).alias("stack"), F.concat(state["out"], F.transform(gone, lambda d: d["p"])).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.transform(F.filter(state["stack"], lambda d: last + 1 - d["left"] > window), lambda d: d["p"]))

    found = let(F.filter(F.sequence(first, last), lambda i: _hash(data, i, config) < low), with_gaps)
    elements = F.transform(found, lambda i: F.struct(_hash(data, i, config).alias("h"), i.alias("p")))
    start = F.struct(F.array().cast("array<struct<h: bigint, p: int, left: int>>").alias("stack"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(elements, start, step, finish)


def fingerprint(text: Column, config: WinnowConfig = WinnowConfig()) -> Column:
    """``array<struct<p, h>>``: kept places (bytes from 0, ascending) and hashes. A text shorter than a gram is one gram, one with fewer grams than a window is one window; null and empty texts keep nothing."""

    def of(data: Column) -> Column:
        return let(F.greatest(F.length(data) - config.gram + 1, F.lit(1)), lambda grams: over(data, grams))

    def over(data: Column, grams: Column) -> Column:
        window = F.least(F.lit(config.window), grams)
        final = grams - window  # the last window's first gram
        pieces = F.transform(F.sequence(F.lit(0), final, F.lit(config.piece)), lambda s: let(s, lambda a: _kept(data, a, F.least(a + config.piece - 1, final) + window - 1, window, config)))
        return F.transform(F.array_sort(F.array_distinct(F.flatten(pieces))), lambda p: F.struct(p.alias("p"), _hash(data, p, config).alias("h")))

    data = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) > 0, let(data, of)).otherwise(F.array().cast("array<struct<p: int, h: bigint>>"))


def as_text(kept: Column) -> Column:
    """``place:hash`` of each kept gram, parted by blanks; the hash as 16 hexadecimal digits."""
    return F.array_join(F.transform(kept, lambda x: F.concat(x["p"].cast("string"), F.lit(":"), F.lpad(F.hex(x["h"]), 16, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct hashes that two fingerprints have in common; 1 for two empty ones."""
    x, y = F.transform(a, lambda e: e["h"]), F.transform(b, lambda e: e["h"])
    return let(F.struct(F.size(F.array_intersect(x, y)).alias("both"), F.size(F.array_union(x, y)).alias("all")), lambda s: F.when(s["all"] == 0, F.lit(1.0)).otherwise(s["both"] / s["all"]))


def _cuts(docs: DataFrame, config: WinnowConfig) -> tuple[list[list[dict]], bool]:
    """First keys of the chunks in order, in groups of the root of their number, and whether some row repeats often."""
    keys = materialize(docs.groupBy(F.struct("id", "digest").alias("key")).agg(F.count(F.lit(1)).alias("n")), "keys")
    sums = keys.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
    n = max(1, min(config.most_chunks, -(-sums["n"] // config.chunk_rows)))
    dealt = keys.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    found = [json.loads(r["key"]) for r in dealt.orderBy("key").select(F.to_json("key", {"ignoreNullFields": "false"}).alias("key")).collect()]
    drop_materialized(keys)
    step = max(1, int(len(found) ** 0.5))
    return [found[i : i + step] for i in range(0, len(found), step)], (sums["most"] or 0) > config.repeats


def with_next(docs: DataFrame, columns: dict[str, Column], config: WinnowConfig = WinnowConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, own, next``: each row with the ``columns`` of its text and those of the row after it by id (after the last: the first).

    Null texts are empty. Null ids come first, equal ids go by the MD5 of the text, and repeated rows follow each other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts, repeated = _cuts(rows.select("id", F.md5(F.encode("text", "UTF-8")).alias("digest")), config)
    rows = rows.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies")) if repeated else rows.withColumn("copies", F.lit(1))
    rows = rows.withColumn("key", F.struct("id", F.md5(F.encode("text", "UTF-8")).alias("digest")))
    n = sum(map(len, cuts))
    kind = f"array<array<struct<id: {docs.schema[id_col].dataType.simpleString()}, digest: string>>>"
    width = len(cuts[0]) if cuts else 1

    def place(held: Column) -> Column:
        """The chunk of a key, and its first key: found among the groups' first keys, then in a group."""
        group = F.size(F.filter(held, lambda g: g[0] <= F.col("key"))) - 1
        return let(group, lambda g: let(F.get(held, g), lambda keys: let(F.size(F.filter(keys, lambda k: k <= F.col("key"))) - 1, lambda at: F.struct((g * width + at).alias("chunk"), (F.get(keys, at) == F.col("key")).alias("leads")))))

    rows = rows.withColumn("at", place(F.from_json(F.lit(json.dumps(cuts)), kind)))
    home = F.struct(F.col("at.chunk").alias("chunk"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("at.chunk") - 1, F.lit(max(1, n))).alias("chunk"), F.lit(True).alias("guest"))
    rows = rows.select("id", "text", "copies", "key", F.explode(F.when(F.col("at.leads"), F.array(home, before)).otherwise(F.array(home))).alias("to"))
    rows = rows.select("to.chunk", "to.guest", "key", "id", "copies", "text").repartition("chunk").select("*", F.struct(*[c.alias(k) for k, c in columns.items()]).alias("own"))
    order = Window.partitionBy("chunk").orderBy("guest", "key")
    rows = rows.withColumn("next", F.lead("own").over(order)).where(~F.col("guest"))
    # of a row that stands for copies, all but the last are followed by a copy
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("id", "text", "own", F.when(F.col("copy") < F.col("copies"), F.col("own")).otherwise(F.col("next")).alias("next"))


def fingerprints(docs: DataFrame, config: WinnowConfig = WinnowConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each row.

    The edited text is the text with its last half (rounded down) replaced by the first as many code
    points of the next row's text. Null texts are empty; an empty text keeps no grams and is like no
    text but an empty one. The only row is its own next. Repeated rows stay rows of their own. Other
    columns are ignored, and an empty table gives an empty result.
    """
    rows = with_next(docs, {"text": F.col("text"), "kept": fingerprint(F.col("text"), config)}, config, id_col, text_col)
    rows = rows.withColumn("n", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - F.col("cut")).cast("int")), F.substring(F.col("next.text"), F.lit(1), F.col("cut")))
    rows = rows.withColumn("edited", edited).withColumn("edited_kept", fingerprint(F.col("edited"), config))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("own.kept")).alias("fingerprint"),
        as_text(F.col("edited_kept")).alias("edited_fingerprint"), likeness(F.col("own.kept"), F.col("edited_kept")).alias("near_edited"), likeness(F.col("own.kept"), F.col("next.kept")).alias("near_next"),
    )

"""WARC: resolution of not-modified revisits.

A revisit record says that a page had not changed since an earlier capture. It is joined as-of, by
canonical URL, to the latest earlier full response; their validators are compared, and the headers
that a 304 response may update (RFC 9110, 15.4.5) are laid over the stored ones.

One URL may hold a third of all captures, or all of them at one time, so the as-of join has two levels.
Captures are written in chunks, ranges of (URL, time, record) of even size; a window within (URL,
chunk) finds matches of the same chunk, and a second window over one row a (URL, chunk) carries the
last response of earlier chunks forward. Payloads stay where they are: records carry a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# The header fields that a 304 response may update.
PERMITTED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that do not change a page.
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, path and query without scheme, fragment, tracking parameters and closing slash."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(query, f"(?:^|&){TRACKING}=[^&]*", ""), "^&+", "")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _strong(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored headers with the permitted fields of the update over them; names are lower case."""
    allowed = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED_HEADERS) & v.isNotNull())
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve_revisits(captures: DataFrame, chunks: int | None = None) -> DataFrame:
    """Every revisit with the response it stands for.

    ``captures``: ``record_id, url, ts (long), record_type ('response' or 'revisit'), etag,
    last_modified, headers (map), payload_digest``. Returns ``record_id, canonical_url, ts,
    target_id, outcome, headers, payload_digest``. Earlier means a smaller ``(ts, record_id)``. A
    revisit is ``resolved`` if its etag (else its date) equals the response's, ``mismatch`` if it
    has validators that do not, ``unvalidated`` if it has none, ``orphan`` without an earlier
    response; only a resolved one gets headers and digest of the response. Null URLs are orphans; a
    null ``ts`` comes before all others. Repeated revisits are resolved one by one. Other columns
    are ignored; empty in, empty out. ``chunks``: their number; by default as many as shuffle partitions.
    """
    base = captures.select("record_id", "url", "ts", "record_type", "etag", "last_modified", "headers", "payload_digest").withColumn("__u", canonical_url(F.col("url")))
    ranges = ["__u", "ts", "record_id"]
    dealt = base.repartitionByRange(chunks, *ranges) if chunks else base.repartitionByRange(*ranges)
    base = materialize(dealt.withColumn("__c", F.spark_partition_id()), "captures")

    response = F.struct(F.col("record_id").alias("id"), "etag", "last_modified", "headers", "payload_digest")
    full = F.when((F.col("record_type") == "response") & F.col("__u").isNotNull(), response)
    order = [F.asc_nulls_first("ts"), F.asc_nulls_first("record_id")]
    inside = Window.partitionBy("__u", "__c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("__near", F.last(full, ignorenulls=True).over(inside))
    last = base.where(full.isNotNull()).groupBy("__u", "__c").agg(F.max_by(response, F.struct(F.coalesce("ts", F.lit(-(2**63))), "record_id")).alias("__last"))
    heads = base.select("__u", "__c").distinct().join(last, ["__u", "__c"], "left")
    carried = heads.withColumn("__far", F.last("__last", ignorenulls=True).over(Window.partitionBy("__u").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))).select("__u", "__c", "__far")
    found = placed.where(F.col("record_type") == "revisit").join(carried, ["__u", "__c"], "left")
    found = found.withColumn("__t", F.coalesce("__near", "__far"))

    t = F.col("__t")
    same = F.when(F.col("etag").isNotNull(), _strong(F.col("etag")).eqNullSafe(_strong(t["etag"]))).when(F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(t["last_modified"]))
    outcome = F.when(t.isNull(), "orphan").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    done = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return done.select(
        "record_id", F.col("__u").alias("canonical_url"), "ts", t["id"].alias("target_id"), "outcome",
        F.when(resolved, merge_headers(t["headers"], F.col("headers"))).alias("headers"), F.when(resolved, t["payload_digest"]).alias("payload_digest"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records derived from ``pages``: each page as a full response and a later revisit, and its host's ``robots.txt``.

    ``page_id`` gives the order of time. Every fiftieth page is also a full response for
    ``robots.txt``, the others a revisit of it, so one host can hold most captures of a URL. Some
    revisits come before the response, have another tag, or only a date. A page without an id has no
    place in time, so its captures have no URL, and those of a page without a URL neither.
    """
    p, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    url = F.when(p.isNotNull(), F.col("url"))
    host = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*", 0)
    tag, day = F.substring(F.md5(html.cast("binary")), 1, 16), F.concat(F.lit("day "), (p % 365).cast("string"))

    def record(k: int, url: Column, ts: Column, kind: Column, etag: Column, date: Column, digest: Column) -> Column:
        headers = F.map_filter(
            F.create_map(
                F.lit("content-length"), F.when(kind == "response", F.octet_length(html).cast("string")).otherwise(F.lit("0")),
                F.lit("date"), ts.cast("string"), F.lit("etag"), etag, F.lit("last-modified"), date,
            ),
            lambda k, v: v.isNotNull(),
        )
        return F.struct(
            (p * 4 + k).alias("record_id"), url.alias("url"), ts.alias("ts"), kind.alias("record_type"), etag.alias("etag"), date.alias("last_modified"), headers.alias("headers"),
            F.when(kind == "response", digest).alias("payload_digest"),
        )

    none = F.lit(None).cast("string")
    late = F.when(p % 11 == 0, p * 10 - 5).otherwise(p * 10 + 7 + p % 5 * 1000)
    robots_tag = F.concat(F.lit("robots-"), (p - p % 50).cast("string"))
    is_head = p % 50 == 0
    records = F.array(
        record(0, url, p * 10, F.lit("response"), tag, day, F.md5(html.cast("binary"))),
        record(1, url, late, F.lit("revisit"), F.when(p % 13 == 0, none).when(p % 7 == 0, "stale").otherwise(F.concat(F.lit("W/"), tag)), F.when(p % 26 == 0, none).otherwise(day), none),
        record(2, F.concat(host, F.lit("/robots.txt")), p * 10 + 1, F.when(is_head, "response").otherwise("revisit"), robots_tag, none, robots_tag),
    )
    return pages.select(F.inline(records))

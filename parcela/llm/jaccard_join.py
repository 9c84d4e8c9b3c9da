"""N-gram Jaccard self-join with several global token orders.

A document is the set of its distinct word shingles. Two documents link when the Jaccard similarity
of their sets reaches the threshold. Every global order of the tokens gives a prefix filter: a linked
pair shares a token among the first ``n - ceil(t n) + 1`` of each document. The orders here put
tokens that occur once before all others and then differ (by frequency, by frequency class and hash,
by hash), and a pair is verified only if it passes all of them.

1. One pass over the texts hashes the shingles. Each chunk of documents sends its distinct tokens,
   as packed differences by token range, to the task that counts that range. Tokens of two or more documents come
   back with their frequency. A token that occurs once is in no intersection, so from here on a
   document is its repeated tokens and its size; documents with too few of them are done.
2. Documents with equal sets (a 128-bit digest) become one class, so copies are never paired.
3. In every group of classes with a common prefix token each class is tried against one pivot, the
   one with fewest tokens of its own: a linear number of pairs that joins most near copies.
4. What is left is exact: all pairs of different components with a common prefix token that pass the
   size bound, the bound by what follows the first shared token and the other orders, and were not
   tried yet, are verified.
   Components are labels spread over the links, in rounds that each end in a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_materialized, materialize, ship_package
from .common import free_name, id_type

_MULT = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)
SHARED = 0xFFFF
#: Bits of a token.
TOKEN_BITS = 56


@dataclass(frozen=True)
class JaccardConfig:
    """``percent``: linked from this similarity on. A chunk is closed at ``chunk_tokens`` tokens; token ranges are made to hold about ``range_tokens``, but a chunk and range share no fewer than ``least_share``."""

    shingle_words: int = 4
    percent: int = 85
    chunk_tokens: int = 2_000_000
    range_tokens: int = 500_000
    least_share: int = 32


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, one byte plane after the other."""
    values = values.astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, start: int = 0) -> np.ndarray:
    width = data[start]
    planes = np.frombuffer(data, dtype=np.uint8, offset=start + 1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted numbers as the first one and packed differences."""
    return values[:1].astype("<u8").tobytes() + pack(np.diff(values)) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data, dtype="<u8", count=1), unpack(data, 8)]), dtype=np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, word_hash: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes (``TOKEN_BITS`` bits) of the ``k``-word shingles; a shorter text is one shingle, no words none."""
    words = (text or "").encode().lower().split()  # both touch ASCII only, as the contract's words do
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(word_hash.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(k, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            out = (out ^ (out >> np.uint64(31))) * _MULT + h[i : i + n]
        out = (out ^ (out >> np.uint64(30))) * _FINAL
    return np.unique((out ^ (out >> np.uint64(27))) >> np.uint64(64 - TOKEN_BITS))


def _chunk_schema(docs: DataFrame, id_col: str) -> T.StructType:
    fields = [("range", T.IntegerType()), ("chunk", T.LongType()), ("place", T.IntegerType()), ("id", id_type(docs, id_col)), ("key", T.BinaryType()), ("n", T.LongType()), ("digest", T.BinaryType()), ("tokens", T.BinaryType()), ("places", T.BinaryType()), ("uses", T.BinaryType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """A batch in which the columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _distinct(tokens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The distinct ones of a chunk's tokens, sorted, with their number of documents and the document's place, or SHARED where several have it;
    and the tokens and places of those. A token costs its range one entry a chunk, however many documents hold it."""
    order = np.argsort(tokens, kind="stable")
    tokens, places = tokens[order], places[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(tokens)), dtype=bool), tokens[1:] != tokens[:-1]]))
    count = np.diff(np.append(first, len(tokens))).astype(np.uint32)
    many = np.repeat(count > 1, count)
    return tokens[first], count, np.where(count > 1, SHARED, places[first]).astype(np.uint16), (tokens[many], places[many])


def _shares(tokens: np.ndarray, places: np.ndarray, n_ranges: int) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """A chunk's tokens and places by some consecutive ranges at a time, about an eighth of them, so that a task never sorts and packs a whole chunk at once."""
    step = -(-n_ranges // 8)
    for r in range(0, n_ranges, step):
        end = min(r + step, n_ranges)
        low, high = (np.uint64(-(-(x << 32) // n_ranges)) << np.uint64(TOKEN_BITS - 32) for x in (r, end))  # the first token of a range
        own = (tokens >= low) & (tokens < high)
        yield range(r, end), tokens[own], places[own]


def _chunks(docs: DataFrame, config: JaccardConfig, n_ranges: int, id_col: str, text_col: str, key: Column) -> DataFrame:
    """Rows of three kinds: a document (chunk, place, id, key, n, digest), a chunk's tokens of one range with places and the uses of those that several of its documents have, or the places of the latter.

    Rows that only pass the counting have negative ranges, dealt evenly.
    """
    schema = _chunk_schema(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        arrow = None
        seq = 0
        passed = part * 7919
        word_hash = _WordHash()
        place: dict[bytes, int] = {}
        sets: list[np.ndarray] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal seq, held, passed
            place.clear()
            word_hash.clear()
            if sets:
                chunk = part << 32 | seq
                all_places = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
                all_tokens = np.concatenate(sets)
                sets.clear()
                several: list[tuple[np.ndarray, np.ndarray]] = []
                for ranges, tokens, places in _shares(all_tokens, all_places, n_ranges):
                    tokens, count, places, shared = _distinct(tokens, places)
                    several.append(shared)
                    where = (tokens >> np.uint64(TOKEN_BITS - 32)).astype(np.int64) * n_ranges >> 32  # tokens are sorted, so these are
                    cuts = np.searchsorted(where, np.arange(ranges.start, ranges.stop + 1))
                    full = np.flatnonzero(np.diff(cuts))
                    cut = lambda write: pa.array([write(slice(cuts[r], cuts[r + 1])) for r in full], pa.binary())  # noqa: B023, E731
                    yield _batch(
                        arrow, len(full), range=pa.array((ranges.start + full).astype(np.int32)), chunk=pa.array(np.full(len(full), chunk, dtype=np.int64)), tokens=cut(lambda r: pack_sorted(tokens[r])),  # noqa: B023
                        places=cut(lambda r: pack(places[r])), uses=cut(lambda r: pack(count[r][count[r] > 1])),  # noqa: B023
                    )
                del all_tokens, all_places
                shared = tuple(map(np.concatenate, zip(*several, strict=True)))
                passed += 1
                yield _batch(arrow, 1, range=pa.array([-1 - passed % n_ranges], pa.int32()), chunk=pa.array([chunk], pa.int64()), tokens=pa.array([pack_sorted(shared[0])], pa.binary()), places=pa.array([pack(shared[1])], pa.binary()))
            seq += 1
            held = 0

        for batch in batches:
            types = {"range": pa.int32(), "chunk": pa.int64(), "place": pa.int32(), "id": batch.column(0).type, "key": pa.binary(), "n": pa.int64(), "digest": pa.binary(), "tokens": pa.binary(), "places": pa.binary(), "uses": pa.binary()}
            arrow = arrow or pa.schema(list(types.items()))
            found: list[tuple[int, int, int, bytes]] = []  # chunk, place, size, digest
            for text in batch.column(2):
                s = shingles(text.as_py(), config.shingle_words, word_hash)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                at = place.get(digest)
                if at is None:  # copies in a chunk send their tokens once
                    at = place[digest] = len(sets)
                    sets.append(s)
                    held += len(s)
                found.append((part << 32 | seq, at, len(s), digest))
                if held >= config.chunk_tokens or len(sets) == 65_000:
                    yield from close()
            chunk, at, n, digest = ([f[i] for f in found] for i in range(4))
            spread = -1 - (passed + np.arange(len(found)) // 64) % n_ranges
            passed += len(found) // 64 + 1
            yield _batch(arrow, len(found), range=pa.array(spread.astype(np.int32)), chunk=pa.array(chunk, pa.int64()), place=pa.array(at, pa.int32()), id=batch.column(0), key=batch.column(1), n=pa.array(n, pa.int64()), digest=pa.array(digest, pa.binary()))
        yield from close()

    return docs.select(F.col(id_col).alias("id"), key.alias("key"), text_col).mapInArrow(run, schema)


def _count_range(group: pa.Table) -> pa.Table:
    """Of one token range: each chunk's tokens that two or more documents have, with their number of documents. Other rows pass."""
    if not group.num_rows or group.column("range")[0].as_py() < 0:
        return group
    tokens = [unpack_sorted(t) for t in group.column("tokens").to_pylist()]
    places = [unpack(p).astype(np.uint16) for p in group.column("places").to_pylist()]
    counts = []
    for p, u in zip(places, group.column("uses").to_pylist(), strict=True):
        c = np.ones(len(p), dtype=np.int64)
        c[p == SHARED] = unpack(u)
        counts.append(c)
    flat = np.concatenate(tokens)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    uses = np.empty(len(flat), dtype=np.int64)
    uses[order] = np.repeat(np.add.reduceat(np.concatenate(counts)[order], first), np.diff(np.append(first, len(ordered))))
    at, out = 0, {"tokens": [], "places": [], "uses": []}
    for t, p in zip(tokens, places, strict=True):
        u = uses[at : at + len(t)]
        at += len(t)
        keep = u > 1
        out["tokens"].append(pack_sorted(t[keep]))
        out["places"].append(pack(p[keep]))
        out["uses"].append(pack(np.minimum(u[keep], 65_535)))
    for name, column in out.items():
        group = group.set_column(group.schema.get_field_index(name), name, pa.array(column, pa.binary()).cast(group.schema.field(name).type))
    return group.filter(pa.array([len(t) > 0 for t in out["tokens"]], pa.bool_()))


def _mix(tokens: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (tokens ^ np.uint64(salt)) * _FINAL
        return (x ^ (x >> np.uint64(31))) * _MULT


def _prefixes(tokens: np.ndarray, uses: np.ndarray, size: int) -> list[np.ndarray]:
    """The first ``size`` repeated tokens under each order; all orders put tokens that occur once first."""
    by_use = np.lexsort((tokens, uses))
    by_class = np.lexsort((_mix(tokens, 0x5851F42D4C957F2D), np.log2(uses).astype(np.int64)))
    by_hash = np.argsort(_mix(tokens, 0x14057B7EF767814F), kind="stable")
    return [tokens[o[:size]] for o in (by_use, by_class, by_hash)]


def _assemble(percent: int):
    """Documents of one chunk. The first of each set that could still link has its repeated tokens and prefixes; they are null elsewhere."""

    def run(group: pa.Table) -> pa.Table:
        is_doc, counted = np.array(group.column("place").is_valid()), np.array(group.column("uses").is_valid())
        docs = group.filter(pa.array(is_doc))

        def read(mask: np.ndarray, name: str, decode) -> np.ndarray:
            return np.concatenate([np.zeros(0, dtype=np.uint64), *map(decode, group.filter(pa.array(mask)).column(name).to_pylist())])

        tokens, places, uses = read(counted, "tokens", unpack_sorted), read(counted, "places", unpack), read(counted, "uses", unpack)
        own = places != SHARED
        known, known_uses = tokens[~own], uses[~own]
        by_token = np.argsort(known)
        shared, shared_places = read(~is_doc & ~counted, "tokens", unpack_sorted), read(~is_doc & ~counted, "places", unpack)
        shared_uses = known_uses[by_token][np.searchsorted(known[by_token], shared)] if len(shared) else known_uses[:0]
        tokens, places, uses = np.concatenate([tokens[own], shared]), np.concatenate([places[own], shared_places]), np.concatenate([uses[own], shared_uses])
        order = np.lexsort((tokens, places))
        tokens, places, uses = tokens[order], places[order], uses[order].astype(np.int64)
        cuts = np.searchsorted(places, np.arange(65_537))
        seen: set[int] = set()
        columns: list[list] = [[], [], [], []]
        for at, n in zip(docs.column("place").to_pylist(), docs.column("n").to_pylist(), strict=True):
            made: tuple = (None,) * 4
            if at not in seen:
                seen.add(at)
                a, b = cuts[at], cuts[at + 1]
                need = -(-percent * n // 100)
                if n and b - a >= need:
                    prefix = (n - need + 1) - (n - (b - a))
                    made = tuple(x.view(np.int64) for x in (tokens[a:b], *_prefixes(tokens[a:b], uses[a:b], prefix)))
            for column, x in zip(columns, made, strict=True):
                column.append(x)
        arrays = [pa.array(c, pa.list_(pa.int64())) for c in columns]
        return pa.table([docs.column("id"), docs.column("key"), docs.column("n"), docs.column("digest"), *arrays], names=["id", "key", "n", "k", "tokens", "p1", "p2", "p3"])

    return run


def _size_ok(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))


def _similar(shared: Column, n: Column, percent: int) -> Column:
    """Whether ``shared`` of ``n`` = |a| + |b| tokens reach the similarity."""
    return 100 * shared >= percent * (n - shared)


def _with_sides(pairs: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (a, b) with the named columns of both classes, as ``a_<column>`` and ``b_<column>``."""
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("k").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return pairs


def _verify(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity: those that pass the other orders' prefix filters meet their tokens. Each side joins by key, in joins that AQE can split."""
    passed = _with_sides(pairs.select("a", "b"), classes, ["p2", "p3"]).where(F.arrays_overlap("a_p2", "b_p2") & F.arrays_overlap("a_p3", "b_p3")).select("a", "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return _with_sides(passed, classes, ["n", "tokens"]).where(_similar(shared, F.col("a_n") + F.col("b_n"), percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``k, comp`` for every end of a link: the smallest key that links reach.

    Each round a key takes the smallest label of itself, its neighbours and its label's label, so
    long chains halve; it ends when nothing changes. Every round is one written table.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(edges.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("k")).select(F.col("a").alias("k"), "comp")
        jump = labels.alias("x").join(labels.alias("y"), F.col("x.comp") == F.col("y.k")).select(F.col("x.k").alias("k"), F.col("y.comp").alias("comp"))
        old = labels.select("k", "comp", F.col("comp").alias("old"))
        step = old.unionByName(near.unionByName(jump).withColumn("old", F.lit(None).cast("binary")))
        new = materialize(step.groupBy("k").agg(F.min("comp").alias("comp"), F.min("old").alias("old")), "labels")
        moved = new.where(F.col("comp") != F.col("old")).limit(1).count()
        drop_materialized(labels)
        labels = new.select("k", "comp")
        if not moved:
            drop_materialized(edges)
            return labels


def _with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``comp`` of each row's class; a class without links is a component of its own."""
    return rows.join(labels, "k", "left").withColumn("comp", F.coalesce("comp", "k"))


def _class_links(classes: DataFrame, config: JaccardConfig) -> DataFrame | None:
    """``k, comp`` of all linked classes, or None where nothing links."""
    percent = config.percent
    index = classes.select("k", "n", F.size("tokens").alias("r"), F.posexplode("p1").alias("place", "token"))
    # one pivot a token: the class with the fewest tokens of its own, then the smallest key
    pivots = index.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("r")).alias("own"), F.col("k"), F.col("n"))).alias("p"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    tried = index.join(pivots.select("token", F.col("p.k").alias("pk"), F.col("p.n").alias("pn")), "token").where(F.col("k") != F.col("pk"))
    tried = tried.where(100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")).groupBy("k", "pk").count()
    star = tried.groupBy("k").agg(F.max_by("pk", F.struct("count", "pk")).alias("pk")).select(F.least("k", "pk").alias("a"), F.greatest("k", "pk").alias("b")).distinct()
    star = materialize(star, "star")
    links = materialize(_verify(star, classes, percent), "star-links")
    labels = components(links)

    # the rest, exactly: groups that still hold several components. Where a token is the first that a pair
    # shares, the pair shares no more than either has from there on; at its other tokens a pair may fall.
    ahead = F.col("r") - F.col("place")
    hopeless = (F.col("least_n") > ahead) & ~_similar(ahead, F.col("n") + F.col("least_n"), percent)
    groups = index.groupBy("token").agg(F.min("n").alias("least_n"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    left = _with_component(index.join(groups, "token").where(~hopeless).select("token", "k", "n", ahead.alias("ahead")), labels)
    mixed = left.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where(F.col("x") != F.col("y")).select("token")
    left = materialize(left.join(mixed, "token", "left_semi"), "residue")
    most = F.least("x.ahead", "y.ahead")
    near = (F.col("x.token") == F.col("y.token")) & (F.col("x.k") < F.col("y.k")) & (F.col("x.comp") != F.col("y.comp")) & _size_ok("x", "y", percent) & _similar(most, F.col("x.n") + F.col("y.n"), percent)
    pairs = left.alias("x").join(left.alias("y"), near).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()
    rest = materialize(_verify(pairs.join(star, ["a", "b"], "left_anti"), classes, percent), "rest-links")
    if rest.limit(1).count():
        drop_materialized(labels)
        labels = components(links.unionByName(rest))
    for used in (star, left, links, rest):
        drop_materialized(used)
    return labels


def _grouped(docs: DataFrame, config: JaccardConfig, id_col: str, text_col: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``id, key, n, k`` of each row, and ``k, comp`` of each class that links."""
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    n_ranges = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * config.range_tokens))), max(1, config.chunk_tokens // config.least_share))
    schema = _chunk_schema(docs, id_col)
    counted = _chunks(docs, config, n_ranges, id_col, text_col, key).groupBy("range").applyInArrow(_count_range, schema)
    held = T.StructType([schema["id"], schema["key"], schema["n"], T.StructField("k", T.BinaryType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("tokens", "p1", "p2", "p3")]])
    table = materialize(counted.groupBy("chunk").applyInArrow(_assemble(config.percent), held), "documents")
    classes = materialize(table.where(F.col("tokens").isNotNull()).groupBy("k").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "p1", "p2", "p3")]), "classes")
    rows = materialize(table.select("id", "key", "n", "k"), "rows")
    drop_materialized(table)
    labels = _class_links(classes, config)
    drop_materialized(classes)
    return rows, labels


def near_duplicates(docs: DataFrame, config: JaccardConfig = JaccardConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: the smallest id that links reach.

    Null and empty texts, and texts of white space, have no shingles and are a component of their
    own. Equal sets always link, so repeated rows share a component. Null ids take part; they are
    never the smallest unless a component has no other. Empty in, empty out; other columns are
    ignored. Sets are compared by 56-bit hashes of their shingles and equal sets by 128-bit digests.
    """
    rows, labels = _grouped(docs, config, id_col, text_col, F.lit(None).cast("binary"))
    full = rows.where(F.col("n") > 0)
    named = _with_component(full.groupBy("k").agg(F.min("id").alias("rep")), labels)
    named = named.join(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("k", "component_id")
    out = full.select("id", "n", "k").join(named, "k").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    lone = rows.where(F.col("n") == 0).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(lone)


def keep_one(docs: DataFrame, config: JaccardConfig = JaccardConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with its own columns: the smallest id's, null ids last.

    Where several rows of a component have that id, the one with the smallest digest of id and text
    stays. Rows without shingles are components of their own. Rows that share id and text stay once.
    Empty in, empty out. One shuffle of the rows, by the digest of id and text, serves the join with
    the digests that stay and the removal of repeats.
    """
    marked = F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), F.lit("\x00"), F.coalesce(F.concat(F.lit("t"), F.col(text_col)), F.lit("n")))
    key = F.unhex(F.md5(F.encode(marked, "UTF-8")))
    rows, labels = _grouped(docs, config, id_col, text_col, key)
    best = F.min(F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("key").alias("key")))
    named = _with_component(rows.where(F.col("n") > 0).groupBy("k").agg(best.alias("best")), labels)
    keepers = named.groupBy("comp").agg(F.min("best").alias("best")).select(F.col("best.key").alias("key"))
    kept = materialize(keepers.unionByName(rows.where(F.col("n") == 0).select("key")).distinct(), "keepers")
    for used in (rows, labels):
        drop_materialized(used)
    own = free_name(docs, "__key")
    return docs.withColumn(own, key).join(kept.withColumnRenamed("key", own), own, "left_semi").dropDuplicates([own]).drop(own)

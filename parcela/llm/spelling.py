"""Spelling variants: words one edit apart, found by walking a trie that is a distributed edge table.

1. Words are counted in one pass over the texts; each task sums its own words before they move.
2. The vocabulary's trie is a table. A node is the digest of a prefix; only nodes that branch
   are kept, so an edge carries a whole label, and a chain of letters of any length is one edge.
3. Two words one edit apart agree in one of their halves. So there are two tries, of the words and of
   the words reversed, and in each a word makes its edit in its second half only, where few words
   share a prefix. The first states (word, position, node, edits = 1) stand at the branching nodes of
   a word's own path: another letter than the word's replaces it, or is inserted before it.
   An insertion is made as late as it can, as the letter inserted differs from the one that follows.
4. Level by level the states join the edges that leave their node with the letter at their position,
   and go on where the label agrees and the child has an edge for the letter that follows. A state
   that ends with its word at a leaf has found a neighbour.
   Every level is a written table; the loop ends when no states are left.

Edges of a node that many words pass are dealt under several salts, its states under one of them each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize, ship_package
from .common import arrow_map

#: What ends a word in the trie; no letter.
END = ""
#: Words up to this length are their own keys, and from the other on their characters are counted.
SHORT, LONG = 24, 64
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SpellingConfig:
    """Words of at least ``min_chars`` code points and ``min_count`` occurrences. A form occurs ``ratio`` times as often. ``delete_every``: plants typing errors, deleting one letter where the hash of id and word is a multiple of it. ``salt_words``: words that pass a node under one salt."""

    min_chars: int = 7
    min_count: int = 2
    ratio: int = 10
    delete_every: int | None = None
    salt_words: int = 5000
    held_chars: int = 16_000_000


def _add_words(held: dict[str, int], text: str | None, doc_id, config: SpellingConfig, pattern: re.Pattern) -> int:
    """Count a text's words into ``held``; the characters of long ones are returned."""
    found = Counter(pattern.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))  # bytes.lower touches A-Z only
    every = None if doc_id is None else config.delete_every
    seed, crc, have, long = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32, held.get, 0
    for word, n in found.items():
        if every is not None and not (h := crc(word.encode(), seed)) % every:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < config.min_chars:
                continue
        held[word] = have(word, 0) + n
        if len(word) > LONG:
            long += len(word)
    return long


def count_words(docs: DataFrame, config: SpellingConfig = SpellingConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: maximal runs of Latin letters, only A-Z lower-cased. Null texts have none; a null id plants no errors."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile("[a-zÀ-ÿ]{%d,}" % config.min_chars)
        held: dict[str, int] = {}
        long = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                long += _add_words(held, text.as_py(), doc_id, config, pattern)
                if len(held) * LONG + long > config.held_chars:
                    yield emit()
                    held.clear()
                    long = 0
        yield emit()

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= config.min_count)


def _key(word: Column) -> Column:
    """A short word itself, a longer one's digest after a sign that is no letter."""
    return F.when(F.length(word) <= SHORT, word).otherwise(F.concat(F.lit("#"), F.md5(F.encode(word, "UTF-8"))))


def _number(letter: Column) -> Column:
    """a to z, then the Latin-1 letters, then no letter: 0 to 90."""
    code = F.ascii(letter)
    return F.when(code.between(97, 122), code - 97).when(code.between(192, 255), code - 166).otherwise(90)


def _steps(words: DataFrame) -> DataFrame:
    """``key, way, depth, node, letter`` (its number) of the prefixes that a state may reach: those of at least half a word, of the word (way 0) and reversed (way 1)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        found = batch.column(1).to_pylist()
        sizes = np.array([len(w) for w in found])
        for n in np.unique(sizes):
            same = np.flatnonzero(sizes == n)
            for part in np.array_split(same, -(-len(same) * int(n) // 400_000)):  # words of one length, so many letters at once
                codes = np.frombuffer("".join(found[i] for i in part).encode("latin-1"), dtype=np.uint8).reshape(len(part), n)
                for way, c in enumerate((codes, codes[:, ::-1])):
                    yield table(batch.column(0), part, way, c, (int(n) - 1) // 2)

    def table(keys: pa.Array, rows: np.ndarray, way: int, codes: np.ndarray, start: int) -> pa.Table:
        """Prefixes of words of one length from ``start`` letters on; each letter mixes into the digest of those before it."""
        n = codes.shape[1]
        nodes = np.empty((len(rows), n + 1 - start), dtype=np.uint64)
        h = np.full(len(rows), way + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n + 1):
                if j >= start:
                    nodes[:, j - start] = h
                if j < n:
                    h = (h ^ (codes[:, j].astype(np.uint64) + np.uint64(1))) * _MULT
                    h ^= h >> np.uint64(32)
        c = codes[:, start:].astype(np.int16)
        letters = np.concatenate([np.where(c < 192, c - 97, c - 166), np.full((len(rows), 1), 90)], axis=1).astype(np.int8)
        m = nodes.shape[1]
        return pa.table({
            "key": keys.take(pa.array(np.repeat(rows, m))), "way": pa.array(np.full(nodes.size, way, dtype=np.int8)), "depth": pa.array(np.tile(np.arange(start, n + 1, dtype=np.int32), len(rows))),
            "node": pa.array(nodes.reshape(-1).view(np.int64)), "letter": pa.array(letters.reshape(-1)),
        })

    return arrow_map(words.select(_key(F.col("word")).alias("key"), "word"), ["key", "word"], run, "key string, way byte, depth int, node long, letter byte")


def _paths(words: DataFrame, config: SpellingConfig) -> DataFrame:
    """``word, n, way, path`` with the oriented word and the branching nodes on its way: depth, node, fan (the number of its salts), and masks of the letters that leave it."""
    steps = materialize(_steps(words), "trie-steps")
    bit = lambda low: F.when(F.col("letter").between(low, low + 61), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("letter") - low).cast("int"))).otherwise(F.lit(0).cast("long"))
    nodes = steps.groupBy("node").agg(F.bit_or(bit(0)).alias("m0"), F.bit_or(bit(62)).alias("m1"), F.count(F.lit(1)).alias("n")).where(F.bit_count("m0") + F.bit_count("m1") > 1)
    nodes = nodes.select("node", "m0", "m1", F.ceil(F.col("n") / config.salt_words).cast("int").alias("fan"))
    on_path = steps.join(nodes, "node").groupBy("key", "way").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "fan", "m0", "m1"))).alias("path"))
    oriented = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    out = materialize(words.withColumn("key", _key(F.col("word"))).join(on_path, "key").select("n", "way", oriented.alias("word"), "path"), "trie-paths")
    drop_materialized(steps)
    return out


def _part(word: Column, start: Column, length: Column) -> Column:
    return F.substring(word, start + 1, length)


def _edges(paths: DataFrame) -> DataFrame:
    """``node, salt, letter, label, child, fan, m0, m1, leaf, leaf_n``: the label follows the letter; a leaf edge ends a word."""
    at = F.posexplode("path").alias("i", "e")
    rows = paths.select("word", "n", "path", at).withColumn("to", F.get("path", F.col("i") + 1))
    rest = F.coalesce(F.col("to.depth"), F.length("word")) - F.col("e.depth") - 1
    edge = rows.select(
        F.col("e.node").alias("node"), F.col("e.fan").alias("own_fan"), _part(F.col("word"), F.col("e.depth"), F.lit(1)).alias("letter"), _part(F.col("word"), F.col("e.depth") + 1, rest).alias("label"),
        F.col("to.node").alias("child"), F.col("to.fan").alias("fan"), F.col("to.m0").alias("m0"), F.col("to.m1").alias("m1"),
        F.when(F.col("to").isNull(), F.col("word")).alias("leaf"), F.when(F.col("to").isNull(), F.col("n")).alias("leaf_n"),
    )
    # whole edges are told apart, so two nodes that share a digest lose none
    return edge.distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("own_fan") - 1))).drop("own_fan")


def _walked(joined: DataFrame, start: Column) -> DataFrame:
    """States whose word goes on with the edge's label from ``start``, and then with a letter that leaves the child; at a leaf the word has to end there."""
    end = start + F.length("label")
    number = _number(_part(F.col("word"), end, F.lit(1))).cast("int")
    leaves = F.when(number < 62, F.call_function("shiftright", F.col("m0"), number)).otherwise(F.call_function("shiftright", F.col("m1"), number - 62)).bitwiseAND(F.lit(1)) == 1
    fits = (_part(F.col("word"), start, F.length("label")) == F.col("label")) & F.when(F.col("leaf").isNull(), (end <= F.length("word")) & leaves).otherwise(end == F.length("word"))
    return joined.where(fits).select("way", "word", "n", "place", "replaced", end.alias("position"), F.col("child").alias("node"), F.col("fan").alias("node_fan"), "leaf", "leaf_n")


def _salt(fan: Column) -> Column:
    return F.pmod(F.xxhash64("word"), fan).cast("int")


def neighbours(words: DataFrame, config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """``word, near, near_n``: both orders of all pairs of ``words`` (``word, n``, distinct, of Latin letters) that one inserted, deleted or replaced code point tells apart."""
    paths = _paths(words, config)
    edges = materialize(_edges(paths), "trie-edges")
    at = paths.select("way", "word", "n", F.explode("path").alias("e")).where(F.col("e.depth") >= F.floor((F.length("word") + F.col("way")) / 2))
    at = at.select("way", "word", "n", F.col("e.depth").alias("depth"), F.col("e.node").alias("node"), _salt(F.col("e.fan")).alias("salt"))
    begun = at.join(edges, ["node", "salt"]).where((F.col("letter") != END) & (F.col("letter") != _part(F.col("word"), F.col("depth"), F.lit(1))))
    # one join, two edits: the letter stands before the word's own, or for it
    edits = begun.withColumn("replaced", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("replaced") == 0) | (F.col("depth") < F.length("word"))).withColumnRenamed("depth", "place")
    levels = [materialize(_walked(edits, F.col("place") + F.col("replaced")), "trie-states")]
    while levels[-1].where(F.col("leaf").isNull()).limit(1).count():
        states = levels[-1].where(F.col("leaf").isNull()).select("way", "word", "n", "place", "replaced", "position", "node", _salt(F.col("node_fan")).alias("salt"), _part(F.col("word"), F.col("position"), F.lit(1)).alias("letter"))
        levels.append(materialize(_walked(states.join(edges, ["node", "salt", "letter"]), F.col("position") + F.length("letter")), "trie-states"))
    ends = reduce(DataFrame.unionByName, levels).where(F.col("leaf").isNotNull())
    # nodes go by 64-bit digests, so each pair is checked at the place of its edit
    whole, place = F.length("leaf"), F.col("place")
    before = _part(F.col("word"), F.lit(0), place) == _part(F.col("leaf"), F.lit(0), place)
    ends = ends.where(before & (_part(F.col("word"), place + F.col("replaced"), whole) == _part(F.col("leaf"), place + 1, whole)))
    plain = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c))
    both = ends.select(F.explode(F.array(F.struct(plain("word").alias("word"), plain("leaf").alias("near"), F.col("leaf_n").alias("near_n")), F.struct(plain("leaf").alias("word"), plain("word").alias("near"), F.col("n").alias("near_n")))).alias("x"))
    out = materialize(both.select("x.*").distinct(), "neighbours")
    for used in (paths, edges, *levels):
        drop_materialized(used)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: forms are followed to the last. Counts rise along them, so there is no ring."""
    roots = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while roots.where("moved").limit(1).count():
        jump = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
        new = materialize(roots.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_materialized(roots)
        roots = new
    return roots.select("word", "root")


def variants(docs: DataFrame, config: SpellingConfig = SpellingConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word: its near words' number, the most frequent one if that
    occurs ``ratio`` times as often (ties: the smallest in code-point order), and the word that forms lead to at last.

    Null texts have no words, repeated rows count again, a null id plants no errors. Words of any length
    take part whole. Other columns are ignored, and an empty table gives an empty result.
    """
    words = materialize(count_words(docs, config, id_col, text_col), "words")
    near = neighbours(words, config)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("b"))
    is_form = -F.col("b.m") >= config.ratio * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("b.form")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n"))
    found = materialize(found, "forms")
    roots = _roots(found.where(F.col("form").isNotNull()))
    out = found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    for used in (words, near):
        drop_materialized(used)
    return out

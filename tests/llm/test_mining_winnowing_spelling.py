"""Hard negatives, winnowing and spelling variants against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcela.llm import hard_negatives, spelling, winnowing

TEXTS = [(1, None), (1, None), (2, ""), (3, "  \n\t "), (None, "one two three four five six"), (4, "word " * 30_000), (5, "one two three four five six"), (5, "one two three four five six"), (None, None), (6, "<|endoftext|>\x0b é😀" * 30)]
EXTRA = ("lang", "key", "next", "own", "chunk", "word", "n", "label", "__id", "a.b")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    return spark.createDataFrame([(*r, *range(len(EXTRA))) for r in TEXTS], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in EXTRA))


def test_residue_scores_are_exact():
    rng = np.random.default_rng(1)
    for dim, size in ((1, 10**9), (2, 3), (64, 250), (64, 2**24), (1000, 2**20), (3000, 2**15), (0, 1)):
        a, b = (rng.integers(-size, size + 1, (n, dim)) for n in (7, 9))
        a[0], b[0] = size, size
        b[1] = -size
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        left, right = hard_negatives.Residues(a.astype(float)), hard_negatives.Residues(b.astype(float))
        assert hard_negatives.exact_scores(left, right).tolist() == want
        assert hard_negatives.exact_scores(left, right, slice(2, 4)).tolist() == want[2:4]
    huge = hard_negatives.Residues(np.array([[1e200, 3.0], [-1e200, 5.0], [0.0, 7.0]]))
    one = hard_negatives.Residues(np.array([[1.0, 2.0]]))
    assert hard_negatives.exact_scores(huge, one)[:, 0].tolist() == [2**63 - 1, -(2**63), 14]


def _mined(rows, every, scale=256, k=5, m=10):
    """Plain Python over all pairs; rows of one id and score count once."""
    good = [(i, lab, [int(np.floor(scale * x)) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for a, own, q in {(i, lab, tuple(v)) for i, lab, v in good}:
        if a % every:
            continue
        scores = {(-sum(x * y for x, y in zip(q, v, strict=True)), i, lab == own) for i, lab, v in good if len(v) == len(q)}
        for ps, p in sorted({(s, i) for s, i, same in scores if same and i != a})[:k]:
            fit = sorted({(s, i) for s, i, same in scores if not same and 30 * -ps <= 100 * -s <= 90 * -ps})[:m]
            out |= {(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fit)}
    return out


def test_hard_negatives_against_all_pairs(spark):
    """Ties, repeated rows, vectors of two lengths, nulls, infinite parts, several blocks and small tiles."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        v = (rng.integers(-4, 5, 3 if i % 50 else 2) / 4).tolist() if i % 3 else rng.normal(size=3).tolist()
        rows.append((i, v, int(rng.integers(0, 4))))
    rows += [(500, None, 1), (510, [1.0, None, 2.0], 1), (520, [1.0, float("inf"), 0.0], 1), (530, [float("nan")] * 3, 1), (540, [1.0, 0.0, 0.0], None), (None, [1.0, 1.0, 1.0], 2), (550, [], 1), (551, [], 1)]
    rows += rows[:30] + [(10, [0.5, 0.5, 0.5], 3), (11, [0.5, 0.5, 0.5], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("anchor", F.lit(1)).withColumn("id", F.lit(2)).withColumn("a.b", F.lit(3))
    want = _mined(rows, 10)
    for config in (hard_negatives.MiningConfig(), hard_negatives.MiningConfig(block_components=21, tile_scores=50)):
        got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, config).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) and want
    assert hard_negatives.mine(table.where("false"), F.lit(True)).count() == 0
    assert hard_negatives.mine(table, F.lit(False)).count() == 0


def _winnow(data: bytes, k: int, w: int) -> list[tuple[int, int]]:
    if not data:
        return []
    h = [xxhash.xxh64_intdigest(data[i : i + k], seed=42) for i in range(max(1, len(data) - k + 1))]
    h = [x - 2**64 if x >= 2**63 else x for x in h]
    w = min(w, len(h))
    kept = {min((h[p], -p) for p in range(i, i + w)) for i in range(len(h) - w + 1)}
    return sorted((-p, x) for x, p in kept)


def test_winnowing_against_brute_force(spark):
    """Random, repetitive and multi-byte texts, shorter and longer than grams, windows and pieces."""
    rng = np.random.default_rng(3)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, a, n)) for a in (1, 2, 3, 26) for n in (0, 1, 4, 5, 6, 11, 12, 13, 50, 51, 400)] + ["é😀x" * 60, "ab" * 300, None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for config in (winnowing.WinnowConfig(gram=5, window=8, candidates=1, piece=16), winnowing.WinnowConfig(gram=5, window=8, candidates=6, piece=50), winnowing.WinnowConfig(gram=3, window=1, candidates=1, piece=7), winnowing.WinnowConfig()):
        for r in docs.select("text", winnowing.fingerprint(F.col("text"), config).alias("f")).collect():
            assert [tuple(x) for x in r["f"]] == _winnow((r["text"] or "").encode(), config.gram, config.window), (r["text"], config)


def _fingerprints(rows):
    config = winnowing.WinnowConfig()
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    text = lambda f: " ".join(f"{p}:{x % 2**64:016X}" for p, x in f)
    alike = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + nxt[:cut]
        own, other, after = (_winnow(x.encode(), config.gram, config.window) for x in (t, edited, nxt))
        h, h2, h3 = ({x for _, x in f} for f in (own, other, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(own), text(other), alike(h, h2), alike(h, h3)))
    return Counter(out)


def test_fingerprints_against_brute_force(spark, sf_dir, odd):
    """Neighbours over many chunks, with repeated rows collapsed and not, and odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    short = odd.where("length(text) < 1000 or text is null")
    mixed = docs.limit(40).union(docs.limit(3)).union(short.select("doc_id", "text"))
    for table in (docs, short, mixed):
        want = _fingerprints([tuple(r) for r in table.select("doc_id", "text").collect()])
        for config in (winnowing.WinnowConfig(), winnowing.WinnowConfig(chunk_rows=3, repeats=1), winnowing.WinnowConfig(chunk_rows=1, most_chunks=9)):
            assert Counter(map(tuple, winnowing.fingerprints(table, config).collect())) == want
    assert winnowing.fingerprints(odd).count() == len(TEXTS)
    assert winnowing.fingerprints(odd.where("false")).count() == 0
    lone = winnowing.fingerprints(odd.where("doc_id = 6")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0


def test_shared_passages_share_a_hash(spark):
    """The guarantee: a common passage of gram + window - 1 bytes at any place gives a common hash."""
    rng = np.random.default_rng(4)
    config = winnowing.WinnowConfig()
    fill = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage = fill(config.gram + config.window - 1)
    docs = spark.createDataFrame([(fill(rng.integers(0, 5000)) + passage + fill(rng.integers(0, 5000)),) for _ in range(40)], "text string")
    sets = [{x["h"] for x in r["f"]} for r in docs.select(winnowing.fingerprint(F.col("text"), config).alias("f")).collect()]
    assert set.intersection(*sets)


def _near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_neighbours_against_all_pairs(spark):
    """Dense families over two letters, runs of one letter, long chains, accents, and nodes under several salts."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("ab"), rng.integers(1, 8))) for _ in range(150)}
    words |= {"a" * n for n in range(7, 40)} | {"prefix" + "".join(rng.choice(list("xyzé÷ÿ"), rng.integers(1, 4))) for _ in range(80)}
    long = "".join(rng.choice(list("abcdefgh"), 3000))
    words |= {long, long[1:], long[:-1], long[:1500] + long[1501:], long[:1500] + "z" + long[1501:], long + "zz"}
    table = spark.createDataFrame([(w, i + 2) for i, w in enumerate(sorted(words))], "word string, n long")
    number = {w: i + 2 for i, w in enumerate(sorted(words))}
    want = Counter((a, b, number[b]) for a in words for b in words if _near(a, b))
    for salt_words in (5000, 3):
        assert Counter(map(tuple, spelling.neighbours(table, spelling.SpellingConfig(salt_words=salt_words)).collect())) == want


def _variants(rows, every=31):
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    rest = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest[w[:i] + w[i + 1 :]].add(w)
        rest[w].add(w)
    near = defaultdict(set)
    for group in rest.values():
        for a in group:
            near[a] |= {b for b in group if _near(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_against_brute_force(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    long = "Überlänge" * 150
    chain = ["Straßenbahn"] * 2000 + ["Straßenbahnx"] * 100 + ["xStraßenbahnx"] * 8 + [long, long.replace("Ü", "ü")] + [long + "x"] * 2
    planted = spark.createDataFrame([(900_000 + i, w) for i, w in enumerate(chain)] + [(None, "nullids nullids NULLIDS")], "doc_id long, text string")
    table = docs.union(planted).union(odd.select("doc_id", "text"))
    config = spelling.SpellingConfig(delete_every=31, held_chars=5000 * 8)
    got = spelling.variants(table, config).collect()
    want = _variants([tuple(r) for r in table.collect()])
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r["root"] == "straßenbahn" and r["form"] != r["root"] for r in got if r["form"])
    assert spelling.variants(odd, config).count() == len(_variants(TEXTS))
    assert spelling.variants(odd.where("false"), config).count() == 0

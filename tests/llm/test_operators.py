"""The llm operators against brute force, round trips, held-out accuracy and odd tables."""

from __future__ import annotations

import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import differences
from pyspark import SparkContext
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parcela.llm import bpe, decontamination, jaccard_join, language_id, license_scan, packing, quality_model, quality_rules, registry, revisits, sharding, token_counts

ODD = [(1, None), (1, None), (2, ""), (3, "  \n\t "), (None, "one two three four five six"), (4, "word " * 30_000), (5, "one two three four five six"), (5, "one two three four five six"), (6, "<|endoftext|>\x0b é" * 3)]

CLASHES = ("id", "key", "n", "__id", "__key", "__y", "__w", "__lang", "__text", "__row", "__words", "a.b")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeats, and columns whose names clash with results."""
    made = [(i, t, "en" if k % 2 else None, "s", 0, 0.5, "x", 1, True, *range(len(CLASHES))) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, n_words long, kept boolean, " + ", ".join(f"`{c}` int" for c in CLASHES))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLE[name]) == ""


def _encode(texts):
    library = Tokenizer.from_file(bpe.default_path())
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_a_round_trip(docs, odd):
    for table in (docs, odd.where("doc_id in (2, 4, 6)")):
        pieces = defaultdict(list)
        rows = packing.pack_documents(table).collect()
        for r in rows:
            pieces[r["doc_id"]].append(r)
        assert len({r["sequence_id"] for r in rows}) == len(rows)
        found = table.collect()
        for d, ids in zip(found, _encode([d["text"] or "" for d in found]), strict=True):
            own = sorted(pieces[d["doc_id"]], key=lambda r: r["start"])
            whole = b"".join(bytes(r["ids"]) for r in own)
            assert np.frombuffer(whole, "<u4").tolist() == [*ids, 0]
            assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["doc_tokens"] == len(ids) + 1 for r in own)


def test_token_counts_are_the_library_s(docs, odd):
    for table in (docs, odd):
        rows = token_counts.count_tokens(table).collect()
        texts = [d["text"] or "" for d in table.collect()]
        assert Counter(r["n_tokens"] for r in rows) == Counter(len(x) for x in _encode(texts))


def test_tokens_of_rare_characters():
    encoder = bpe.load(bpe.default_path())
    count = token_counts._counter(bpe.default_path(), token_counts.prove_whole_tokens(bpe.default_path()))
    texts = [f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in range(1, 0x3000, 7)] + ["don't I'LL", " \n\n  x", "<|endoftext|> a<|endoftext|>"]
    for t, ids in zip(texts, _encode(texts), strict=True):
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == ids and count(t) == len(ids)
    assert len(encoder.ids(" " * 300_000)) > 0
    rng = np.random.default_rng(1)
    drawn = ["".join(chr(c) for c in rng.integers(32, 0x33480, 6) if not 0xD800 <= c < 0xE000) for _ in range(4000)] + ["\U0003e576溝", "a\u180eb", "x\ua7cb1"]
    for t, ids in zip(drawn, _encode(drawn), strict=True):
        assert count(t) == len(ids)


def _word_sets(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(upper))
        yield r["doc_id"], frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def test_jaccard_join_against_all_pairs(spark):
    """Chains of edits, copies and texts that share passages, in which links meet at the threshold."""
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(20, 90))]
        for _ in range(rng.integers(1, 12)):
            edited = list(base)
            for _ in range(rng.integers(0, 3)):
                edited[rng.integers(0, len(edited))] = f"n{rng.integers(0, 10_000)}"
            texts.append(" ".join(edited))
            base = edited if rng.random() < 0.5 else base
    texts += [texts[0], texts[0].upper(), "", "  ", None, "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = dict(_word_sets(docs.collect()))
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for i, a in sets.items():
            for j, b in sets.items():
                if label[i] > label[j] and a and b and 100 * len(a & b) >= 85 * len(a | b):
                    label[i], moved = label[j], True
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}


def test_components_of_a_chain(spark):
    key = lambda i: bytes([0, i])
    links = spark.createDataFrame([(key(i), key(i + 1)) for i in range(20)] + [(key(100), key(101))], "a binary, b binary")
    got = {bytes(r["k"])[1]: bytes(r["comp"])[1] for r in jaccard_join.components(links).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100}


def test_tiling_finds_reordered_passages():
    a = np.arange(1, 21)
    assert decontamination.tile(np.concatenate([a[10:], [-1], a[:10]]), a, 5) == (20, 2)
    assert decontamination.tile(a[:4], a, 5) == (0, 0)


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    texts = [f"before {item} after", " ".join(w[10:]) + " and then " + " ".join(w[:10]), " ".join(w[:6]) + " only a little", None, "", item.upper(), "clean text of other words entirely here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "other words")], "item_id long, text string")
    found = {r["doc_id"]: (r["item_id"], r["covered_words"], r["n_tiles"]) for r in decontamination.find_contaminated(docs, bench).collect()}
    assert found == {0: (7, 20, 1), 1: (7, 20, 2), 5: (7, 20, 1), 6: (10, 2, 1)}
    small = decontamination.TilingConfig(block_chars=60)
    twice = bench.unionByName(bench.withColumn("item_id", F.col("item_id") + 100))
    assert {r["doc_id"] for r in decontamination.find_contaminated(docs, twice, small).collect()} == {0, 1, 5, 6}
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()) == [2, 3, 4]


def test_word_probability_sums_all_segmentations():
    config = language_id.LanguageConfig()
    vocab = language_id.vocabulary(config.vocabulary)
    rng = np.random.default_rng(3)
    p = rng.random((len(vocab.pieces), 2))
    p /= p.sum(axis=0)
    model = language_id.LanguageModel(["a", "b"], p, config)
    number = {w: i for i, w in enumerate(vocab.pieces)}

    def total(word, k):
        if not word:
            return 1.0
        return sum((p[number[word[:n]], k] if word[:n] in number else language_id.UNSEEN if n == 1 else 0.0) * total(word[n:], k) for n in range(1, min(len(word), vocab.longest) + 1))

    words = ["the", "house", "ñandú", "x", "ωx"]
    got = np.exp(language_id.word_scores(words, model))
    assert np.allclose(got, [[total(language_id.START + w, k) for k in range(2)] for w in words], rtol=1e-9)

    def uses(word, k):
        """(probability, expected uses times probability) over all segmentations."""
        if not word:
            return 1.0, Counter()
        whole, sums = 0.0, Counter()
        for n in range(1, min(len(word), vocab.longest) + 1):
            head = word[:n]
            q = p[number[head], k] if head in number else language_id.UNSEEN if n == 1 else 0.0
            if q:
                rest, inner = uses(word[n:], k)
                whole += q * rest
                sums.update({x: q * v for x, v in inner.items()})
                if head in number:
                    sums[number[head]] += q * rest
        return whole, sums

    weight = rng.random((len(words), 2)) * 5
    expected = np.zeros_like(p)
    for i, w in enumerate(words):
        for k in range(2):
            whole, sums = uses(language_id.START + w, k)
            for x, v in sums.items():
                expected[x, k] += weight[i, k] * v / whole
    assert np.allclose(language_id.expected_counts(words, weight, p, vocab), expected, rtol=1e-9)


def test_many_languages_and_long_words(spark):
    """More than 256 languages, each with words of its own, and a word of 500 letters."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    rows = [(2 * i + j, " ".join([a * 3, a * 2, a] * 5), f"l{i:03d}") for i, a in enumerate(letters) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    config = language_id.LanguageConfig(rounds=1)
    model = language_id.train(docs, config)
    taught = {r["lang"] for r in docs.where(language_id.training_rows()).select("lang").collect()}
    assert set(model.languages) == taught and len(taught) > 256
    found = quality_rules.language_references(docs)
    assert [r["lang"] for r in found] == [f"l{i:03d}" for i in range(300)]
    assert quality_rules.score_quality(docs).count() == 600
    vocab = language_id.vocabulary(config.vocabulary)
    p = np.full((len(vocab.pieces), 1), 1 / len(vocab.pieces))
    long = "thehouse" * 63
    got = language_id.word_scores([long, long[:250]], language_id.LanguageModel(["x"], p, config))
    table = np.zeros(len(long) + 2)  # all segmentations by plain sums, one position after the other
    word, number = language_id.START + long, set(vocab.pieces)
    table[0] = 1.0
    scale = 0.0
    for j in range(1, len(word) + 1):
        table[j] = sum(table[i] * (p[0, 0] if word[i:j] in number else language_id.UNSEEN if j - i == 1 else 0.0) for i in range(max(0, j - vocab.longest), j))
        if table[j] < 1e-100:
            table[max(0, j - vocab.longest) : j + 1] *= 1e100
            scale -= 100 * np.log(10)
        if j == 251:
            half = np.log(table[j]) + scale
    assert np.allclose(got[:, 0], [np.log(table[len(word)]) + scale, half], rtol=1e-9)


NEAR_LANGUAGES = {
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "ca": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
}
OWN_LANGUAGES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
}


def test_foreign_and_gibberish_texts_go(spark):
    """Other scripts, gibberish and related languages go, short or long; texts of the learned languages stay, also such as the model has not seen the like of."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    own = docs.where("lang is not null")
    assert language_id.keep_identified(own, model).count() >= 0.999 * own.count()
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 6
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 6
    odd = [polish, finnish, "xkqz vbwq jjzx qqwv zxkj vvkq wqzj xzvk " * 10, "Все люди рождаются свободными и равными. " * 8, "一" * 500, "12 34 !!", "", None, *NEAR_LANGUAGES.values(), *(t * 4 for t in NEAR_LANGUAGES.values())]
    planted = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, *OWN_LANGUAGES.values(), *(t * 4 for t in OWN_LANGUAGES.values())])], "doc_id long, text string")
    kept = {r["doc_id"] for r in language_id.keep_identified(planted, model).collect()}
    assert kept == set(range(len(odd), len(odd) + 2 * len(OWN_LANGUAGES)))


def _greedy(text, item, shortest):
    """Greedy string tiling word by word: again and again the longest match of unmarked words, the first in the item, then in the text."""
    free_a, free_b, covered, tiles = [x >= 0 for x in text], [True] * len(item), 0, 0
    while True:
        best = (0, 0, 0)
        for b in range(len(item)):
            for a in range(len(text)):
                n = 0
                while a + n < len(text) and b + n < len(item) and free_a[a + n] and free_b[b + n] and text[a + n] == item[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < shortest:
            return covered, tiles
        for k in range(n):
            free_a[a + k] = free_b[b + k] = False
        covered, tiles = covered + n, tiles + 1


def test_tiling_against_plain_greedy():
    rng = np.random.default_rng(5)
    for _ in range(400):
        item = rng.integers(0, rng.integers(2, 12), rng.integers(3, 30))
        parts = [item[a : a + rng.integers(1, 12)] for a in rng.integers(0, len(item), rng.integers(1, 6))]
        text = np.concatenate([x for p in parts for x in (p, rng.integers(-1, 4, 1))])
        shortest = int(rng.integers(2, 4))
        assert decontamination.tile(text, item, shortest) == _greedy(text.tolist(), item.tolist(), shortest)


def test_tiling_of_repeated_words_is_fast():
    """Runs of one word, of two in turn, and with marked gaps: equal to the plain form when short, and quick when long."""
    for make in (lambda n: np.zeros(n, dtype=np.int64), lambda n: np.arange(n) % 2, lambda n: np.arange(n) % 7 % 3):
        for a, b in ((30, 20), (12, 25), (40, 40)):
            text = make(a)
            text[a // 2] = -1
            assert decontamination.tile(text, make(b), 3) == _greedy(text.tolist(), make(b).tolist(), 3)
    began = time.perf_counter()
    assert decontamination.tile(np.zeros(20_000, dtype=np.int64), np.zeros(4000, dtype=np.int64), 5) == (4000, 1)
    assert time.perf_counter() - began < 20


def test_decontamination_against_all_pairs(spark):
    """Every document against every item, in reordered, cut and short passages."""
    rng = np.random.default_rng(9)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in (1, 3, 4, 5, 8, 12, 20, 20, 40)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.integers(1, 5)):
            w = items[rng.integers(0, len(items))].split()
            a = int(rng.integers(0, len(w)))
            parts += [*w[a : a + rng.integers(1, 25)], f"x{rng.integers(0, 9)}"]
        texts.append(" ".join(parts))
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    config, want = decontamination.TilingConfig(), set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            a, b = t.split(), x.split()
            covered, tiles = _greedy([b.index(w) if w in b else -1 for w in a], [b.index(w) for w in b], min(config.seed_words, len(b)))
            if tiles and covered >= config.coverage * len(b):
                want.add((d, i, covered, tiles))
    got = {(r["doc_id"], r["item_id"], r["covered_words"], r["n_tiles"]) for r in decontamination.find_contaminated(docs, bench).collect()}
    assert got == want and want


def test_additive_model_against_row_wise_sums():
    """Scores row by row, the trees against all splits, and that each round lowers the loss."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=300)) > 0).astype(float)
    config = quality_model.GamConfig(rounds=20, pair_rounds=10, pairs=2, bins=8, pair_bins=4)
    model = quality_model.fit(x, y, config)

    def one(row):
        total = model.intercept
        for k, t in enumerate(model.tables):
            total += t[sum(e < row[k] for e in model.edges[k])]
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[sum(e < row[a] for e in model.pair_edges[a]), sum(e < row[b] for e in model.pair_edges[b])]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.scores(x), [one(r) for r in x])
    assert (1, 2) in model.pairs
    loss = lambda m: -np.mean(y * np.log(m.scores(x)) + (1 - y) * np.log(1 - m.scores(x)))
    losses = [loss(quality_model.fit(x, y, quality_model.GamConfig(rounds=r, pair_rounds=0, pairs=0, bins=8))) for r in (0, 1, 5, 20)]
    assert losses == sorted(losses, reverse=True) and loss(model) < losses[-1]
    g, h = rng.normal(size=6), rng.random(6) + 0.1
    worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1.0)
    cut = max(range(1, 6), key=lambda c: worth(slice(0, c)) + worth(slice(c, 6)))
    tree = quality_model._tree(g, h, 2, 1.0)
    assert np.allclose(tree, [g[:cut].sum() / (h[:cut].sum() + 1.0)] * cut + [g[cut:].sum() / (h[cut:].sum() + 1.0)] * (6 - cut))


def test_language_accuracy(docs):
    found = language_id.identify(docs, language_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_quality_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = quality_model.score(docs, quality_model.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) >= 0.9 * len(found)


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", rows.schema, sharding.ShardConfig(target_bytes=60_000, small_bytes=4_000, fan_in=3))
    assert store.version() == 0 and store.read().count() == 0
    for k in range(4):
        store.append(rows.where(F.col("doc_id") % 4 == k).repartition(3))
    before = store.version()
    assert store.compact_fully() > before
    assert store.manifest().count() < store.manifest(before).count()
    assert store.manifest().agg(F.max("bytes")).first()[0] < 120_000
    for v in (before, store.version()):
        assert store.read(v).exceptAll(rows).count() == 0 and store.read(v).count() == 2000
    assert store.vacuum() > 0 and store.read().count() == 2000
    with pytest.raises(sharding.CommitConflict):
        store._commit(store.manifest(), store.version())


def test_shards_of_odd_rows(spark, tmp_path, odd, none):
    """Nulls, repeats, empty arrivals and extra columns; merges of a few files at a time."""
    schema = odd.select("doc_id", "text").schema
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", schema, sharding.ShardConfig(fan_in=2, merge_files=2))
    for _ in range(3):
        store.append(odd.repartition(2).withColumn("__arrival", F.lit(1)))
        store.append(none)
    want = Counter(map(tuple, odd.select("doc_id", "text").collect() * 3))
    store.compact_fully()
    assert Counter(map(tuple, store.read().collect())) == want and store.read().columns == ["doc_id", "text"]


def test_vacuum_spares_what_is_about_to_be_committed(spark, tmp_path, monkeypatch):
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", rows.schema, sharding.ShardConfig(fan_in=2))
    other = sharding.ShardStore(spark, f"file://{tmp_path}/s", rows.schema, sharding.ShardConfig(fan_in=2))
    store.append(rows)
    commit = store._commit

    def late(shards, version):
        assert other.vacuum() == 0  # the files are written, and no version names them yet
        return commit(shards, version)

    monkeypatch.setattr(store, "_commit", late)
    store.append(rows)
    store.compact_fully()
    assert store.read().count() == 200 and other.vacuum() > 0 and store.read().count() == 200
    stale = sharding.ShardStore(spark, f"file://{tmp_path}/s", rows.schema, sharding.ShardConfig(stale_seconds=-1))
    rows.write.parquet(f"file://{tmp_path}/s/data/append-lost")
    (tmp_path / "s" / "running" / "append-lost").mkdir()
    assert other.vacuum() == 0 and stale.vacuum() > 0


def test_revisit_cases(spark):
    cols = "record_id long, url string, ts long, record_type string, etag string, last_modified string, headers map<string,string>, payload_digest string"
    h = {"etag": "a", "content-length": "9"}
    rows = [
        (1, "http://WWW.x.org/a/?utm_source=f#t", 10, "response", "a", "d", h, "p1"), (2, "https://x.org/a", 20, "revisit", 'W/a', None, {"date": "now", "content-length": "0"}, None),
        (3, "http://x.org/a", 5, "revisit", "a", None, None, None), (4, "http://x.org/a", 30, "response", "b", None, None, "p2"), (5, "http://x.org/a", 40, "revisit", "a", None, None, None),
        (6, "http://x.org/a", 50, "revisit", None, None, None, None), (7, None, 50, "revisit", "a", None, None, None), (8, "http://x.org/a", 30, "revisit", "b", None, None, None),
    ]
    for chunks in (None, 1, 7):
        got = {r["record_id"]: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, cols), chunks).collect()}
        assert {k: (r["target_id"], r["outcome"]) for k, r in got.items()} == {2: (1, "resolved"), 3: (None, "orphan"), 5: (4, "mismatch"), 6: (4, "unvalidated"), 7: (None, "orphan"), 8: (4, "resolved")}
        assert got[2]["headers"] == {"etag": "a", "content-length": "9", "date": "now"} and got[2]["payload_digest"] == "p1"


def test_revisits_against_a_plain_search(spark):
    """One URL with bursts at one time, null times, repeated rows, long values and clashing extra columns."""
    rng = np.random.default_rng(4)
    cols = "record_id long, url string, ts long, record_type string, etag string, last_modified string, headers map<string,string>, payload_digest string, __u string, __c int, outcome string"
    rows = []
    for i in range(400):
        kind = "response" if rng.random() < 0.2 else "revisit"
        url = [f"http://x.org/{'long' * 5000}", "http://x.org/b", None][int(rng.choice(3, p=[0.7, 0.2, 0.1]))]
        ts = None if rng.random() < 0.05 else int(rng.choice([0, 5, 5, 7, int(rng.integers(0, 10**9))]))
        rows.append((i, url, ts, kind, f"e{rng.integers(0, 3)}", None, {"etag": "e"}, f"p{i}" if kind == "response" else None, "x", 1, "y"))
    rows += [r for r in rows if r[3] == "revisit"][:20]
    place = lambda r: (r[2] is not None, r[2] or 0, r[0])
    want = Counter()
    for r in rows:
        if r[3] == "revisit":
            before = [f for f in rows if r[1] is not None and f[3] == "response" and f[1] == r[1] and place(f) < place(r)]
            f = max(before, key=place, default=None)
            want[r[0], f and f[0], "orphan" if f is None else "resolved" if f[4] == r[4] else "mismatch"] += 1
    captures = spark.createDataFrame(rows, cols)
    for chunks in (None, 1, 50):
        assert Counter((r["record_id"], r["target_id"], r["outcome"]) for r in revisits.resolve_revisits(captures, chunks).collect()) == want
    assert revisits.resolve_revisits(captures.where("false")).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/x", "h"), (None, "http://a.org/x", "h"), (2, None, None)], "page_id long, url string, html string")
    got = revisits.resolve_revisits(revisits.captures_of_pages(pages)).collect()
    assert Counter(r["outcome"] for r in got if r["canonical_url"] is None) == Counter({"orphan": 4}) and len(got) == 6


def test_license_notices(spark):
    """Notices at any place, with words put in and left out, and statements that must stand together."""
    rng = np.random.default_rng(6)
    fill = lambda n: [f"f{x}" for x in rng.integers(0, 50, n)]
    texts, want = [], []
    for label, text in license_scan.NOTICES.items():
        w = text.split()
        for at in (0, 7, 130, 301):
            kept = [x for i, x in enumerate(w) if i % 15 != 7 or x in license_scan.REQUIRED.get(label, ())]
            spread = [y for x in kept for y in ([x, "extra"] if rng.random() < 0.1 else [x])]
            texts.append(" ".join([*fill(at), *spread, *fill(90)]))
            want.append(label)
    texts += ["the mit group released under protest the license", "x Released under the MIT license. y", "licensed under CC BY 4.0 and more", " ".join(license_scan.NOTICES["gpl-3.0"].split()[:30])]
    want += [None, "mit", None, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan_licenses(docs).collect()}
    base = set(license_scan.PHRASES.values())
    assert [sorted(set(got[i]) - base - {""}) for i in range(len(texts))] == [[x] if x else [] for x in want]


def test_license_tags_deeds_and_tables(spark):
    texts = [
        "# SPDX-License-Identifier: Apache-2.0", "/* SPDX-License-Identifier: BSD-3-Clause */", "// SPDX-License-Identifier: MIT\nint main", "spdx license and apache 2 0", "SPDX-License-Identifier: CC-BY-4.0",
        "A. Author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal", "This is under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International", "the creative attribution of commons, 4 of 0, international and noncommercial", None, "",
    ]
    want = [["apache-2.0"], ["bsd-3-clause"], ["mit"], [], ["cc-by-4.0"], ["cc0-1.0"], ["cc0-1.0"], ["cc-by-sa-4.0"], ["cc-by-nc-4.0"], [], [], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: sorted(set(r["labels"].split(",")) - {"", "cc-by"}) for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want

    # whole texts from a table: long ones in the hundreds, each found in its document and nowhere else, with one word in 20 left out
    rng = np.random.default_rng(8)
    long = {f"own-{k}": " ".join(f"W{x}" for x in rng.integers(0, 400, 300)) for k in range(60)}
    rows = [(x, "notice", t, None) for x, t in long.items()] + [("short", "statement", "Ask the Author, first!", None), ("short", "statement", "all is free", ["x"]), (None, "notice", "a b c", None), ("blank", "notice", "--", None)]
    table = spark.createDataFrame(rows, "label string, kind string, text string, required array<string>")
    config = license_scan.read_templates(table)
    assert len(license_scan.templates(config)) == 62
    held = [(k, " ".join(w for i, w in enumerate(("start " + t + " end").split()) if i % 20)) for k, t in enumerate(long.values())] + [(90, "please ask the author first"), (91, "All is free"), (92, "the author asked first")]
    found = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame(held, "doc_id long, text string"), config).collect()}
    assert found == {**{k: x for k, x in enumerate(long)}, 90: "short", 91: "short", 92: ""}
    with pytest.raises(ValueError, match="words"):
        license_scan.read_templates(table, most_words=1000)
    none = license_scan.read_templates(table.where("false"))
    assert [r["labels"] for r in license_scan.scan_licenses(docs.where("doc_id = 4"), none).collect()] == ["cc-by"]


def test_odd_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")
    jobs = {
        "packing": lambda d: packing.pack_documents(d), "licenses": license_scan.scan_licenses, "counts": token_counts.count_tokens, "rules": quality_rules.score_quality,
        "classifier": lambda d: quality_model.score(d, quality_model.train(d, labels)), "languages": lambda d: language_id.identify(d, language_id.train(d)), "join": jaccard_join.near_duplicates,
    }
    for name, job in jobs.items():
        assert job(none).count() == 0, name
        rows = job(odd).collect()
        assert len({(r["doc_id"]) for r in rows}) == 7 and (name == "packing" or len(rows) == len(ODD)), name
    assert Counter(r["doc_id"] for r in decontamination.find_contaminated(odd, bench).collect()) == {None: 1, 5: 2}
    assert decontamination.find_contaminated(none, bench).count() == 0 and decontamination.find_contaminated(odd, bench.where("false")).count() == 0
    comp = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(odd).collect()}
    assert comp == {1: 1, 2: 2, 3: 3, None: 5, 4: 4, 5: 5, 6: 6}
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.train(none)).collect()} == {"und"}
    for keep in (quality_rules.keep_good, lambda d: language_id.keep_identified(d, language_id.train(d)), jaccard_join.keep_one, lambda d: decontamination.drop_contaminated(d, bench)):
        rows = {tuple(r) for r in keep(odd).collect()}
        assert keep(odd).columns == odd.columns and rows <= {tuple(r) for r in odd.collect()} and keep(none).count() == 0
    assert jaccard_join.keep_one(odd).where("doc_id = 5").count() == 1


def test_pipeline(spark, sf_dir, docs):
    """Each stage against its operator's own verdicts, and the last as a round trip."""
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, left, sf_dir)
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "quality rules":
            assert ids == {r["doc_id"] for r in quality_rules.score_quality(left).where("kept").collect()}
        if name == "language id":
            fit = language_id.keep_identified(left, language_id.train(left))
            assert ids == {r["doc_id"] for r in fit.collect()} and len(ids) >= 0.99 * left.count()
        if name == "near duplicates":
            assert ids == {r["component_id"] for r in jaccard_join.near_duplicates(left, jaccard_join.JaccardConfig(shingle_words=5, percent=80)).collect()}
        if name == "benchmark decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert ids == {r["doc_id"] for r in left.collect()} - {r["doc_id"] for r in decontamination.find_contaminated(left, bench).collect()}
        left = kept
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    found = left.collect()
    assert set(pieces) == {d["doc_id"] for d in found}
    for d, ids in zip(found, _encode([d["text"] for d in found]), strict=True):
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"])), "<u4").tolist() == [*ids, 0]


def test_pipeline_near_duplicates_against_all_pairs(spark, sf_dir):
    """The stage against five-word sets at 0.8: pairs on both sides of the limit, chains, and short and odd texts."""
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(100)]
    far = [*base[:30], "x", *base[31:70], "y", *base[71:]]  # 86 of 106 five-word shingles, and 89 of 105 four-word ones
    worse = [*base[:20], "x", *base[21:50], "y", *base[51:80], "z", *base[81:]]  # 81 of 111
    texts = [" ".join(t) for t in (base, far, worse)]
    for k in range(8):
        words = [f"t{k}w{x}" for x in rng.integers(0, 400, rng.integers(8, 120))]
        for _ in range(6):
            words = list(words)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(0, len(words))] = f"n{rng.integers(0, 10_000)}"
            texts.append(" ".join(words))
    texts += [texts[5].upper(), "", " ", None, "one two", "one two", "one two three four", "one two three four five"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[i] > label[j] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i], moved = label[j], True
    assert label[1] == 0 and label[2] != 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, sf_dir).collect()) == sorted(set(label))


def test_keep_one_goes_by_rows(spark):
    """One id may have several texts: a row stays for its own component, not for its id's."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, a), (5, a), (5, b), (5, b), (None, b), (None, "lone words of a row without id"), (7, None), (7, None), (7, ""), (8, a.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(map(tuple, jaccard_join.keep_one(docs).collect()))
    assert kept == Counter([(3, a), (5, b), (None, "lone words of a row without id"), (7, None), (7, "")])


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        v = np.sort(rng.integers(0, 2**56, n, dtype=np.uint64))
        assert (jaccard_join.unpack_sorted(jaccard_join.pack_sorted(v)) == v).all() and (jaccard_join.unpack(jaccard_join.pack(v)) == v).all()


def test_chunk_is_closed_in_small_parts(spark, monkeypatch):
    """A full chunk of two million tokens leaves in batches of about an eighth, with little more memory than the tokens take, and whole."""
    runs, none = [], spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(none), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    monkeypatch.setattr(jaccard_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    jaccard_join._chunks(none, jaccard_join.JaccardConfig(), 64, "doc_id", "text", F.lit(None).cast("binary"))
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 5000, 100_000))) for _ in range(19)]
    texts += [texts[0], texts[0] + " end"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.nulls(len(texts), pa.binary()), pa.array(texts, pa.string())], names=["id", "key", "text"])
    tokens, shared, largest = [], 0, 0
    tracemalloc.start()
    try:
        for out in runs[0](iter([batch])):
            largest = max(largest, out.nbytes)
            for r, t in zip(out.column("range").to_pylist(), out.column("tokens").to_pylist(), strict=True):
                if t and r >= 0:
                    found = jaccard_join.unpack_sorted(t)
                    assert ((found >> np.uint64(24)).astype(np.int64) * 64 >> 32 == r).all()
                    tokens.append(found.size)
                elif t:
                    shared += jaccard_join.unpack_sorted(t).size
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    sets = [jaccard_join.shingles(t, 4, jaccard_join._WordHash()) for t in texts]
    assert sum(tokens) == np.unique(np.concatenate(sets)).size and shared >= 2 * sets[0].size
    assert largest < 6e6 and peak < 9e7, (largest, peak)


def test_pipeline_hands_small_batches_to_python(spark, sf_dir):
    """Rows of 1 MB: a task of the stages that run Python is handed a few at a time, not all."""
    rows = spark.range(12).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        corpus_pipeline.pack(spark, rows, sf_dir)
        seen = rows.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"]) for b in batches), "n long").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r["n"] for r in seen) == 12 and max(r["n"] for r in seen) <= 5


def test_language_training_makes_no_rdd(docs, monkeypatch):
    """Rows that are handed over as an RDD start Python workers of a second kind in every executor."""
    expected = language_id.train(docs)

    def refuse(*args, **kwargs):
        raise AssertionError("an RDD of rows")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    found = language_id.train(docs)
    assert found.languages == expected.languages and np.allclose(found.probability, expected.probability)

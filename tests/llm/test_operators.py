"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from odflux.llm import _common, bpe, chat, components, kneser_ney, langid, ngram_join, packing, quality_rules, queries, sharding, spotsigs, warc

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


# --- 1 sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 100, 1000, 1023])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted("id", n, "k")).collect()]
    assert sorted(got) == list(range(n))


def test_shards_differ_by_one_row_and_slots_have_no_gap(awkward):
    got = sharding.shard_rows(awkward, 4).collect()
    assert len(got) == awkward.count()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    assert sizes[4] == (1, 0) and sizes[5] == (1, 0)
    text = "çà et là, naïve 😀 text".encode()
    assert sizes[10] == (len(text) + 1, zlib.crc32(text))


def test_sharding_of_nothing(nothing):
    assert sharding.shard_rows(nothing).count() == 0


# --- 2 quality rules


def brute_counts(text):
    text = text or ""
    w = SPLIT.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines, earlier, dup = text.split("\n"), set(), 0
    for line in lines:
        if SPLIT.search(line):
            dup += line in earlier
            earlier.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_rules_equal_brute_force(awkward, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.apply_rules(awkward, labels).drop("p_quality")
    texts = defaultdict(set)
    for r in awkward.collect():
        texts[r["doc_id"]].add(brute_counts(r["text"]))
    assert got.count() == awkward.count()
    for r in got.collect():
        counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert counts in texts[r["doc_id"]]
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # one class only: no model


def test_quality_model_tells_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality_rules.fit(quality_rules.training_rows(docs, labels.where(~fold)))
    judged = quality_rules.judge(docs.join(labels.where(fold), "doc_id"), model).where("not base_failed").select("quality", "kept").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1]
    assert sum(good) >= 0.97 * len(good)
    assert sum(r["kept"] == bool(r["quality"]) for r in judged) >= 0.9 * len(judged)


def test_model_verdict_equals_brute_force(awkward, spark):
    """Frequencies of n-grams counted one by one, the logit as a plain sum, and the fixed threshold."""
    docs = awkward.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    extra = spark.range(100, 130).select(F.col("id").alias("doc_id"), F.expr("concat('good words ', repeat(concat('steady ', id, ' line of prose '), 20))").alias("text"))
    extra = extra.unionByName(spark.range(200, 230).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('buy now ', id, ' £££ '), 30)").alias("text")))
    docs = docs.unionByName(extra)
    labels = extra.select("doc_id", F.expr("cast(doc_id < 200 as int)").alias("quality"), F.lit(0).alias("toxic"))
    weights, bias, a, b = model = quality_rules.fit(quality_rules.training_rows(docs, labels))
    mask, shift = (1 << 32) - 1, 32 - quality_rules.BITS

    def plain(text):
        w = [zlib.crc32(x) * 2654435761 & mask for x in (text or "").encode().split()]
        by_word = [x >> shift for x in w] + [((x * 2246822519 & mask ^ y) * 3266489917 & mask) >> shift for x, y in zip(w, w[1:])]
        by_char = []
        for n in (2, 3, 4):
            for i in range(len(text or "") - n + 1):
                code = 0
                for c in text[i : i + n]:
                    code = code * 1000003 + ord(c) & mask
                by_char.append(((code + n) * 2654435761 & mask) >> shift)
        z = bias + sum(float(weights[0][c]) for c in by_word) / max(1, len(by_word)) + sum(float(weights[1][c]) for c in by_char) / max(1, len(by_char))
        return 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_rules.judge(docs, model).collect():
        p = plain(texts[r["doc_id"]])
        assert abs(r["p_quality"] - p) < 1e-3 and r["kept"] == (not r["base_failed"] and r["p_quality"] >= quality_rules.THRESHOLD)
        if r["doc_id"] >= 100:
            assert (r["p_quality"] >= quality_rules.THRESHOLD) == (r["doc_id"] < 200)


def test_quality_keeps_clashing_columns(awkward, nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clash = awkward.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(1))
    assert quality_rules.keep_good(clash, labels).columns == clash.columns
    assert quality_rules.apply_rules(nothing, labels).count() == 0


# --- 3 n-gram Jaccard join


def shingles(text):
    w = SPLIT.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(table):
    sets = [(i, shingles(t)) for i, t in table]
    low = {i: i for i, _ in sets if i is not None}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            low[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def test_join_equals_brute_force_on_awkward_rows(awkward):
    got = rows(ngram_join.join_components(awkward), "doc_id", "n_shingles", "component_id")
    assert got == brute_components([(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_join_equals_brute_force_on_chains_of_edits(spark):
    """Texts that share a passage, and edits around the threshold, so that every stage of the join decides something."""
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(400)]
    passage = list(rng.choice(vocab, 60))
    table = []
    for g in range(12):
        base = list(rng.choice(vocab, 120))
        for k in range(8):
            words = list(base)
            for at in rng.integers(0, len(words), k * 2):
                words[at] = f"x{g}_{k}_{at}"
            table.append((len(table), " ".join(words + (passage if g % 2 else []))))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert rows(ngram_join.join_components(df), "doc_id", "n_shingles", "component_id") == brute_components(table)


@pytest.mark.parametrize("block, part", [(3_000_000, 4), (200, 4), (200, 2_048)])
def test_join_splits_hot_blocks_and_columns(spark, monkeypatch, block, part):
    """A passage in all texts, a group of near copies, and limits so low that blocks are salted and columns sliced."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SLICE", part)
    rng = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(90)]
    table = []
    for g in range(40):
        own = [f"o{g}_{k}" for k in range(int(rng.integers(4, 45)))]
        table.append((len(table), " ".join(passage + own)))
    for g in range(40):
        words = [f"n{k}" for k in range(100)]
        words[int(rng.integers(0, 100))] = f"y{g}"
        table.append((len(table), " ".join(words)))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert rows(ngram_join.join_components(df), "doc_id", "n_shingles", "component_id") == brute_components(table)


def test_join_by_shuffles_where_nothing_is_small(spark, monkeypatch):
    """Limits so low that no look-up table is broadcast and no step runs in one task."""
    for module in (_common, components, ngram_join):
        for name, most in (("TASK_ROWS", 32), ("LOOK_UP", 0)):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, most)
    table = []
    for g in range(4):
        for k in range(10):
            words = [f"n{g}_{x}" for x in range(80)]
            words[7 * k] = f"y{k}"
            table.append((len(table), " ".join(words)))
        table.append((len(table), table[-1][1]))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert rows(ngram_join.join_components(df), "doc_id", "n_shingles", "component_id") == brute_components(table)


def test_join_of_ids_with_several_texts(spark):
    a, b, c = ([f"{x}{k}" for k in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:58], "z", w[59]])
    table = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, near(b)), (9, near(c)), (9, " ".join(b)), (8, " ".join(c)), (2, None)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 8: 1, 2: 2}


def test_signature_bound_is_never_too_low():
    rng = np.random.default_rng(7)
    for _ in range(50):
        n = int(rng.integers(5, 3000))
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        own = rng.integers(0, 2**63, (2, int(rng.integers(1, max(2, n // 7)))), dtype=np.uint64)
        h = np.concatenate([common, own[0], common, own[1]])
        size = len(common) + own.shape[1]
        doc = np.repeat([0, 1], size)
        about = np.concatenate([np.asarray([[0, 1], [0, 1], [size * 4, size * 4]]), ngram_join.column_signatures(h, doc, 2)])
        need = ngram_join.least_overlap(size * 4, size * 4) - ngram_join.rest(size * 4)
        assert n < need or ngram_join.may_share(about, np.asarray([0]), np.asarray([1]))[0]
        sets = [np.unique(np.concatenate([common, x])) for x in own]
        sizes = np.asarray([len(x) for x in sets])
        bits = np.stack([np.frombuffer(ngram_join.whole_signature(x), dtype=np.int64) for x in sets], axis=1)
        about = np.concatenate([np.asarray([[0, 1], [0, 1], sizes, sizes]), np.full((ngram_join.SIGNATURE, 2), -1), np.ones((1, 2), dtype=np.int64), bits])
        linked = len(np.intersect1d(*sets)) >= ngram_join.least_overlap(*sizes)
        assert not linked or ngram_join.may_share(about, np.asarray([0]), np.asarray([1]))[0]


def test_keep_one_leaves_one_of_each_component(awkward, nothing):
    kept = [r["doc_id"] for r in ngram_join.keep_one(awkward).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 4, 5, 6, 7, 9, 10, 11, 12, None, 14]))
    assert ngram_join.keep_one(awkward).columns == awkward.columns
    names = "_w _b _id _hit _keep _rows _rank _first _told _decided _word _bits keep first decided k u v".split()
    clash = awkward.select("*", *[F.lit(1).alias(c) for c in names])
    again = ngram_join.keep_one(clash)
    assert again.columns == clash.columns and sorted(str(r["doc_id"]) for r in again.collect()) == sorted(map(str, kept))
    assert ngram_join.join_components(nothing).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 200).selectExpr("id AS u", "id - 1 AS v").union(spark.createDataFrame([(500, 400), (5, 5), (None, 3)], "u long, v long"))
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(200)} | {400: 400, 500: 400}


def test_components_over_several_tasks(spark, monkeypatch):
    """Limits so low that no task has all edges and no table is broadcast: contraction and star rounds alternate."""
    monkeypatch.setattr(components, "TASK_ROWS", 16)
    monkeypatch.setattr(_common, "TASK_ROWS", 16)
    path = [(k, k - 1) for k in range(1, 60)]
    star = [(1000 + k, 1000) for k in range(1, 40)]
    table = [*path, *star, *star[:5], (7, 7), (None, 3), (2000, 3000)]
    edges = spark.createDataFrame(table, "u long, v long").repartition(6)
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(60)} | {1000 + k: 1000 for k in range(40)} | {2000: 2000, 3000: 2000}
    assert components.components(edges.limit(0)).count() == 0


def test_replaced_by_broadcast_and_by_shuffle(spark, monkeypatch):
    table = spark.createDataFrame([(1, 5), (2, 6), (None, 7), (1, 8)], "a long, b long")
    names = spark.createDataFrame([(1, 10), (3, 30)], "id long, component long")
    want = [(10, 5), (10, 8), (2, 6), (None, 7)]
    for most in (100, 0):
        monkeypatch.setattr(_common, "LOOK_UP", most)
        assert sorted(map(tuple, _common.replaced(table, "a", names, 2).collect()), key=str) == sorted(want, key=str)


# --- 4 Kneser-Ney


def test_discounts_and_probabilities_add_up(spark):
    texts = spark.createDataFrame([("the cat sat on the mat the cat ran",), ("the dog sat on a mat",)] * 3, "text string")
    words, total = kneser_ney.vocabulary(texts)
    assert total == 45
    classes = kneser_ney.Classes(words)
    counts = kneser_ney.bigram_counts(texts, classes, 2)
    model = kneser_ney.Model(classes, kneser_ney._statistics(counts, classes.size), [])
    found = Counter()
    for r in texts.collect():
        found.update(classes.bigrams([r["text"]])[0].tolist())
    assert abs(model.unigram.sum() - 1) < 1e-9
    for word in (b"the", b"cat", b"mat"):
        context = classes([word])[0]
        keys = context * classes.size + np.arange(classes.size)
        p = np.exp(model.log_p(keys, np.asarray([found[k] for k in keys.tolist()])))
        assert abs(p.sum() - 1) < 1e-9


def test_perplexity_equals_brute_force(awkward, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 7, 9, 10)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(awkward, labels).collect()
    assert len(got) == awkward.count()
    trusted = [r["text"] for r in awkward.collect() if r["doc_id"] in (1, 2, 3, 7, 9, 10) and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    words, _ = kneser_ney.vocabulary(spark.createDataFrame([(t,) for t in trusted], "text string"))
    classes = kneser_ney.Classes(words)
    seen = Counter(k for t in trusted for k in classes.bigrams([t])[0].tolist())
    stats = kneser_ney._statistics(kneser_ney.bigram_counts(spark.createDataFrame([(t,) for t in trusted], "text string"), classes, 1), classes.size)
    model = kneser_ney.Model(classes, stats, [])
    want = defaultdict(set)
    for r in awkward.collect():
        keys = classes.bigrams([r["text"]])[0]
        p = None if not len(keys) else round(float(np.exp(-model.log_p(keys, np.asarray([seen[k] for k in keys.tolist()])).mean())), 6)
        want[r["doc_id"]].add((len(keys), p))
    for r in got:
        assert (r["n_tokens"], None if r["perplexity"] is None else round(r["perplexity"], 6)) in want[r["doc_id"]]
        if not r["n_tokens"]:
            assert r["kept"] is False


def test_every_word_seen_twice_is_known_at_any_size(spark):
    words = [b"w%d" % i for i in range(140_000)]
    text = " ".join(w.decode() for w in words)
    hashes, total = kneser_ney.vocabulary(spark.createDataFrame([(text,), (text,), ("common " * 300_000 + "once",)], "text string"))
    classes = kneser_ney.Classes(hashes)
    assert total == 580_001 and classes.base == 140_001
    known = classes([*words, b"common"])
    assert known.max() < classes.base and len(set(known.tolist())) == classes.base
    assert classes([b"once", b"dunce"]).tolist() == [classes.base + int.from_bytes(b"ce")] * 2


def test_trusted_texts_where_ids_share_places_of_the_bitmap(awkward, spark, monkeypatch):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 7, 9, 10, 12)] + [(2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    docs = awkward.unionByName(awkward.where("doc_id = 7"))
    want = sorted(r["text"] for r in docs.collect() if r["doc_id"] in (1, 7, 9, 10, 12) and zlib.crc32(str(r["doc_id"]).encode()) % 5)
    for bits in (_common.BITS_PER_ID, 1, 1 << 30):
        monkeypatch.setattr(_common, "BITS_PER_ID", bits)
        assert sorted(r["text"] for r in kneser_ney.trusted(docs, labels)[1].collect()) == want
    assert len(want) > len(set(want))


@pytest.fixture
def made_up(spark):
    """Texts of words of very unequal frequency, and labels that trust half of them."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 300) % 5000) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(2)
    return docs, spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")


def _moved(spark, docs, labels, shards):
    """Bytes of requests, and of what shards send back, for each bigram asked for; and the scores."""
    texts = kneser_ney.trusted(docs, labels)[1]
    classes = kneser_ney.Classes(kneser_ney.vocabulary(texts)[0])
    counts = kneser_ney.bigram_counts(texts, classes, shards)
    stats = kneser_ney._statistics(counts, classes.size)
    shared = spark.sparkContext.broadcast(kneser_ney.Model(classes, stats, []))
    limits = kneser_ney.limits_of(docs, docs.count(), counts, int(stats[4].sum()), shared, shards)
    assert shards // 2 <= len(limits) + 1 <= shards
    asked = kneser_ney.requests(docs, shared, limits)
    partial = kneser_ney.partial_scores(kneser_ney.ranged(counts, limits, classes.size), asked, shared, len(limits) + 1)
    pairs = sum(len(set(k[~shared.value.at_once(k)[1]].tolist())) for k in (classes.bigrams([r["text"]])[0] for r in docs.collect()))
    size = lambda df: df.where(F.col("kind") == kneser_ney.REQUEST).select(F.sum(F.length("body"))).first()[0] / pairs
    most = asked.where(F.col("kind") == kneser_ney.REQUEST).groupBy("shard").agg(F.sum(F.length("body")).alias("n")).agg(F.max("n")).first()[0] / pairs
    return size(asked), size(partial), most, {r["doc_id"]: r["log_p"] for r in kneser_ney.whole_scores(partial).collect()}


def test_look_ups_stay_small_with_more_shards(made_up, spark):
    few, many = _moved(spark, *made_up, 2), _moved(spark, *made_up, 32)
    assert few[0] < 1.65 and many[0] < 1.2 * few[0]
    assert few[1] < 0.08 and many[1] < 1
    assert many[2] < many[0] / 8
    assert len(few[3]) == 400 and all(abs(few[3][k] - many[3][k]) < 1e-6 for k in few[3])


def test_scores_are_the_same_with_any_number_of_shards(awkward, made_up, spark, monkeypatch):
    docs = awkward.select("doc_id", "text", "lang").unionByName(made_up[0].withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 7, 9, 10, *range(1000, 1400, 3))], "doc_id long, quality int, toxic int")
    found = []
    for shard, asked in ((1 << 40, 1 << 40), (2_000, 1 << 40), (1 << 40, 10_000)):
        monkeypatch.setattr(kneser_ney, "SHARD", shard)
        monkeypatch.setattr(kneser_ney, "ASKED", asked)
        got = kneser_ney.classify(docs, labels).collect()
        found.append(sorted((str(r["doc_id"]), r["n_tokens"], str(r["lang"]), r["perplexity"] and round(r["perplexity"], 5), r["kept"]) for r in got))
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()


def test_packed_numbers_and_keys_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(np.concatenate([rng.integers(0, 9_000_000_000, n), np.arange(n) * 3, 90_000 * np.arange(n)]))
        counts = rng.integers(1, 1 << 40, len(keys))
        back = kneser_ney._decoded(kneser_ney._coded(keys, counts, 90_001), 90_001)
        assert np.array_equal(back[0], keys) and np.array_equal(back[1], counts)
    sums = np.asarray([-np.inf, -3.5, 0.0, 1e9])
    assert np.array_equal(kneser_ney._unpacked(kneser_ney._packed(sums.view(np.uint64)), 1)[0].view(np.float64), sums)


def test_bigrams_that_only_counts_make_possible():
    stats = np.zeros((6, kneser_ney.ENDINGS + 11), dtype=np.int64)
    stats[0, :2], stats[3, :2], stats[4, :2] = 6, 1, 2
    model = kneser_ney.Model(kneser_ney.Classes(np.arange(2, dtype=np.uint64)), stats, [])
    model.weight[0] = 0.0
    asked = np.asarray([0, 1, model.size, model.size + 1])
    with np.errstate(divide="ignore"):
        who, sums = model.added(asked, np.asarray([0, 1, 2, 3]), np.asarray([2, 1, 3, 1]), asked[[0, 2]], np.asarray([4, 5]))
        whole = model.log_p(asked, np.asarray([4, 0, 5, 0]))
        without = model.log_p(asked, np.zeros(4, dtype=np.int64))
    assert who.tolist() == [0, 1, 2]
    assert abs(sums[0] - 2 * whole[0]) < 1e-9 and sums[1] == whole[1] == -np.inf and abs(sums[2] - 3 * (whole[2] - without[2])) < 1e-9


def test_kneser_ney_without_trusted_text(awkward, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r["kept"] for r in kneser_ney.classify(awkward, none).collect())
    assert kneser_ney.classify(nothing, none).count() == 0


def test_kneser_ney_keeps_good_documents(spark, sf_dir):
    path = f"{sf_dir}/../sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = kneser_ney.classify(spark.read.parquet(f"{path}/documents.parquet"), labels).join(labels, "doc_id")
    good = [r["kept"] for r in got.where("quality = 1 and toxic = 0").select("kept").collect()]
    assert sum(good) >= 0.97 * len(good)
    bad = [r["kept"] for r in got.where("quality = 0").select("kept").collect()]
    assert sum(bad) <= 0.4 * len(bad)


# --- 5 chats


def test_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", None, "respond", '{"prompt":"x","turn":0}'),
            (1, 2, "b", "a", "respond", '{"prompt":"","turn":2}'),
            (1, 4, "c", "b", "respond", '{"turn":4}'),
            (1, 6, "p", "q", "respond", '{"prompt":"x","turn":6}'),
            (1, 8, "q", "p", "respond", '{"prompt":"x","turn":8}'),
            (2, 0, "a", "zz", "nothing", "{}"),
            (2, 1, "n", None, "respond", None),
        ],
        "conv_id long, turn long, call_id string, parent_id string, name string, arguments string",
    )
    results = spark.createDataFrame([(1, 1, "a", "r"), (1, 3, "a", "s"), (2, 9, "lost", "t")], "conv_id long, turn long, call_id string, content string")
    got = {(r["conv_id"], r["call_id"], r["result_turn"]): r for r in chat.link(calls, results).collect()}
    assert len(got) == 9
    assert (got[1, "a", 1]["depth"], got[1, "b", None]["depth"], got[1, "c", None]["depth"]) == (0, 1, 2)
    assert got[1, "a", 3]["valid"] and got[1, "b", None]["problem"] == "$.prompt: too short" and got[1, "c", None]["problem"] == "$.prompt: missing"
    assert got[1, "p", None]["depth"] is None and not got[1, "q", None]["valid"]
    assert got[2, "a", None]["problem"] == "no such tool" and got[2, "n", None]["problem"] == "arguments aren't JSON"
    assert got[2, "lost", 9]["kind"] == "orphan"
    assert got[1, "a", 1]["message"] == '{"call":{"arguments":{"prompt":"x","turn":0},"id":"a","name":"respond","parent":null},"result":"r"}'


def test_repeated_turns_depend_on_the_turn_before(spark):
    """Repeated user rows, equal or with other texts, wherever partition borders fall."""
    table = [(c, t, "user", f"q{t}{x}") for c in (1, 2) for t in (0, 2, 4) for x in ("", "", "b")] + [(c, t, "assistant", f"a{t}") for c in (1, 2) for t in (1, 3, 5, 5)]
    table += [(3, None, "user", "x"), (3, None, "user", "x"), (3, 1, "assistant", "y"), (None, 1, "user", "z"), (None, 2, "assistant", "w")]
    want = {(c, t): None if t == 0 else f"call_{c}_{t - 2}" for c in (1, 2) for t in (0, 2, 4)} | {(3, None): None, (None, 1): None}
    for parts in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            clash = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("_pid", "_user", "depth", "one")})
            calls, results = chat.exchanges(clash)
            got = {(r["conv_id"], r["turn"], r["parent_id"]) for r in calls.collect()}
            assert got == {(c, t, p) for (c, t), p in want.items()}
            assert {(r["conv_id"], r["turn"], r["call_id"]) for r in results.collect()} == {(c, t, f"call_{c}_{t - 1}") for c in (1, 2) for t in (1, 3, 5)} | {(3, 1, "call_3_null"), (None, 2, "call_null_1")}
            done = chat.format_chats(clash).collect()
            assert all(r["valid"] and r["depth"] == (r["turn"] or 0) // 2 for r in done if r["conv_id"] in (1, 2))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_arguments_without_a_canonical_form_are_not_valid(spark):
    bad = ['"\\ud800"', "[" * 200_000, "[" * 200_000 + "]" * 200_000, '{"prompt":NaN,"turn":1}', "1e999", '{"prompt":"a","prompt":"b","turn":1}', None, "{"]
    good = json.dumps({"turn": 1, "prompt": "long " * 200_000})
    calls = spark.createDataFrame([(1, k, f"c{k}", None, "respond", x) for k, x in enumerate([*bad, good])], "conv_id long, turn long, call_id string, parent_id string, name string, arguments string")
    got = {r["turn"]: r for r in chat.link(calls, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")).collect()}
    assert [got[k]["valid"] for k in range(len(bad) + 1)] == [False] * len(bad) + [True]
    assert {got[k]["problem"] for k in range(len(bad))} == {"arguments aren't JSON"}
    assert json.loads(got[len(bad)]["message"])["call"]["arguments"] == json.loads(good)


def test_chats_with_nulls_and_of_nothing(spark):
    odd = spark.createDataFrame([(None, 0, "user", "x"), (1, None, "user", None), (1, 1, None, "y"), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert {r["kind"] for r in chat.format_chats(odd).collect()} == {"call"}
    assert chat.format_chats(odd.limit(0)).count() == 0


def test_no_turn_is_lost(spark):
    turns = [
        (1, 0, "system", "be \"kind\""),
        (1, 1, "user", "x"),
        (1, 2, "tool", None),
        (1, 3, "assistant", "y"),
        (1, 4, None, "z"),
        (2, 0, "assistant", "early"),
        (2, 1, "user", "open"),
        (None, None, "system", ""),
    ]
    got = chat.format_all(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    seen = Counter((r["conv_id"], t) for r in got for t in {r["turn"], r["result_turn"] if r["answered"] else r["turn"]})
    assert seen == Counter((c, t) for c, t, _, _ in turns)
    rest = {(r["conv_id"], r["turn"]): r["message"] for r in got if r["kind"] == "turn"}
    assert rest == {
        (1, 0): '{"turn":{"role":"system","text":"be \\"kind\\""}}',
        (1, 2): '{"turn":{"role":"tool","text":null}}',
        (1, 4): '{"turn":{"role":null,"text":"z"}}',
        (None, None): '{"turn":{"role":"system","text":""}}',
    }


# --- 6 SpotSigs


def brute_spots(text):
    words = re.findall(r"[^\W\d_]+", re.sub(r"[^\w]|[\d_]", " ", (text or "").lower()))
    anchors = set(spotsigs.ANCHORS.split())
    out = set()
    for i, w in enumerate(words):
        if w in anchors and i + 1 < len(words) and words[i + 1] not in anchors:
            chain = [x for x in words[i + 1 :] if x not in anchors][:2]
            if len(chain) == 2:
                out.add((w, *chain))
    return out


def test_fingerprints_follow_their_contract(awkward):
    table = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    order = sorted(set(table), key=lambda r: (r[0] is not None, r[0] or 0))
    got = spotsigs.fingerprints(awkward).collect()
    assert len(got) == len(table)
    prints = {r["doc_id"]: r for r in got}
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = prints[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = set(r["fingerprint"].split(",")), set(prints[after[0]]["fingerprint"].split(","))
        assert r["near_next"] == pytest.approx(len(a & b) / len(a | b))
        c = set(r["edited_fingerprint"].split(","))
        assert r["near_edited"] == pytest.approx(len(a & c) / len(a | c))
        if brute_spots(text):
            assert len(a) == len(brute_spots(text))
    assert prints[1]["fingerprint"] == prints[3]["fingerprint"] != prints[9]["fingerprint"]


def test_similar_pairs_equal_brute_force(awkward, nothing):
    keyed = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    pairs, members = spotsigs.similar_pairs(keyed, 0.5)
    prints = {r["doc_id"]: set(r["fingerprint"].split(",")) for r in spotsigs.fingerprints(keyed).collect()}
    least = {}
    for i in sorted(prints):
        least.setdefault(frozenset(prints[i]), i)
    reps = sorted(least.values())
    want = {frozenset((a, b)) for a, b in itertools.combinations(reps, 2) if len(prints[a] & prints[b]) >= 0.5 * len(prints[a] | prints[b])}
    assert {frozenset((r["a"], r["b"])) for r in pairs.collect()} == want
    assert {r["doc_id"]: r["rep"] for r in members.collect()} == {i: least[frozenset(p)] for i, p in prints.items()}
    assert spotsigs.fingerprints(nothing).count() == 0


def test_similar_pairs_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "GROUP", 2)
    say = lambda *words: " ".join(f"the {w} grows" for w in words)
    names = ["oak elm ash fir", "yew bay fig box"]
    a, b = (x.split() for x in names)
    table = [(1, say(*a)), (2, say(*a, "one")), (1, say(*b)), (None, say(*b, "two")), (None, say(*a, "six")), (7, say("far", "off"))]
    pairs, members = spotsigs.similar_pairs(spark.createDataFrame(table, "doc_id long, text string"), 0.6)
    got = sorted((tuple(sorted((r["a"], r["b"]), key=str)) for r in pairs.collect()), key=str)
    assert got == sorted([(1, 2), (1, None), (1, None), (2, None)], key=str)
    assert sorted(map(str, (r["rep"] for r in members.collect()))) == sorted(map(str, [1, 2, 1, None, None, 7]))


# --- 7 packing


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = sorted(rng.choice(np.arange(1, 200), 8, replace=False).tolist())
        counts = rng.integers(1, 50, 8).tolist()
        cost = lambda ends: sum(counts[i] * lengths[min(e for e in ends if e >= i)] for i in range(8))
        best = min(cost((*c, 7)) for k in range(3) for c in itertools.combinations(range(7), k))
        assert cost(packing.best_boundaries(lengths, counts, 3)) == best


def test_batches_hold_their_budget(awkward, nothing):
    got = packing.pack(awkward, buckets=3, budget=500).collect()
    assert len(got) == awkward.count()
    batches = defaultdict(list)
    for r in got:
        assert r["n_tokens"] <= r["bucket_length"] and r["padding"] == r["bucket_length"] - r["n_tokens"]
        batches[r["bucket"], r["batch"]].append((r["slot"], r["bucket_length"]))
    for x in batches.values():
        assert sorted(s for s, _ in x) == list(range(len(x)))
        assert len(x) == 1 or sum(n for _, n in x) <= 500
    assert packing.pack(nothing).count() == 0


def test_packing_pads_as_little_as_brute_force(spark):
    rng = np.random.default_rng(4)
    sizes = [*range(13), *rng.integers(0, 13, 60).tolist(), 40, 41, 43]
    table = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    lengths = sorted({max(1, n) for n in sizes})
    padding = lambda ends: sum(min(e for e in ends if e >= n) - n for n in sizes)
    for k in (2, 4):
        best = min(padding((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], k - 1))
        assert sum(r["padding"] for r in packing.pack(table, buckets=k).collect()) == best


def test_boundaries_of_many_lengths_equal_a_plain_dynamic_program():
    rng = np.random.default_rng(6)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 3000), 150, replace=False))
        counts = rng.integers(1, 2000, 150)
        upto = np.concatenate([[0], np.cumsum(counts)])
        best = lengths * upto[1:]
        for _ in range(7):
            best = np.asarray([min([best[j], *(best[:j] + lengths[j] * (upto[j + 1] - upto[1 : j + 1]))]) for j in range(150)])
        ends = packing.best_boundaries(lengths.tolist(), counts.tolist(), 8)
        starts = [0, *(e + 1 for e in ends[:-1])]
        assert sum(int(lengths[e] * (upto[e + 1] - upto[s])) for s, e in zip(starts, ends)) == best[-1]


# --- 8 WARC


def test_archives_round_trip(spark, tmp_path):
    body = "<html>" + "x" * 200 + "</html>\r\n\r\nWARC/1.1\r\n\r\n"
    table = [
        (3, "http://a.example/x?b=1", body),
        (1, "https://www.b.example/", body),
        (1, "https://www.b.example/", body),
        (2, None, None),
        (4, "http://a.example/\r\nwith space", "é" * 60),
        (5, "http://a.example/", ""),
        (None, "http://c.example/", body),
        (6, "http://a.example/y", "short"),
        (7, "http://a.example/y", "short"),
    ]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = str(tmp_path / "warc")
    got = warc.round_trip(pages, path).collect()
    assert len(got) == len(table)
    keys = [(r["url_key"], r["captured"], r["page_id"] is None, r["page_id"] or 0) for r in got]
    assert keys == sorted(keys)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[3]["record_type"], by[3]["refers_to"], by[None]["refers_to"]) == ("response", "revisit", 1, 1)
    assert by[6]["record_type"] == by[7]["record_type"] == "response"
    for i, _, html in table:
        raw = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_of_many_gzip_members_and_of_very_long_pages(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a.b/{k}", "x" * size) for k, size in enumerate((5, 3_000_000, 200, 3_000_000))], "page_id long, url string, html string")
    plain = "".join(r["value"] + warc.CRLF * 2 for r in warc.records(pages).collect()).encode()
    cuts = [at for at, _, _ in warc.parse(plain)] + [len(plain)]
    (tmp_path / "many.txt.gz").write_bytes(b"".join(gzip.compress(plain[a:b]) for a, b in zip(cuts, cuts[1:])))
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {0: ("response", 5, None), 1: ("response", 3_000_000, None), 2: ("response", 200, None), 3: ("revisit", 3_000_000, 1)}
    with pytest.raises(ValueError):
        warc.unpacked(gzip.compress(plain)[:-9])


def test_loser_tree_merges_runs():
    rng = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted([("r%d" % i, "k%d" % rng.integers(9), "t%d" % rng.integers(9), int(j), 0) for j in rng.integers(0, 99, rng.integers(0, 9))], key=warc.order) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(itertools.chain(*runs), key=warc.order)


# --- 9 byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_ids_equal_the_library(awkward, vocabulary, nothing):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = []
    for r in awkward.collect():
        text = r["text"] or ""
        ids = encoding.encode_ordinary(text)
        want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe.digests(awkward, path, public_tokenizers.PATTERN)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.digests(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_long_pre_tokens(vocabulary):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    mine = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    for text in ("a" * 5000, "ab" * 3001, "".join(rng.choice(list("etaoin"), 4000)), "é" * 999, " " * 3000 + "x", "=-" * 2500):
        packed = mine.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == encoding.encode_ordinary(text)


# --- 10 language ID


def test_languages_are_told(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 50
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_fold_and_unknown(awkward, nothing):
    got = langid.identify(awkward).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in (4, 5, 6, 11):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr")
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_outputs_equal_brute_force(spark, sf_dir):
    """Landmark kernels by sets, the ridge solved over features, and each text's outputs from its kernels alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").dropDuplicates(["doc_id"]).limit(150)
    table = [r.asDict() for r in docs.collect()]
    chosen = langid.training_rows(spark.createDataFrame(table, docs.schema), "doc_id", "text", "lang")
    langs, folded = langid.fit(chosen)
    kernel = lambda x, y: len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1))
    sets = [(lang, set(c.tolist())) for lang, c in chosen]
    marks = [c for k in langs for c in [c for lang, c in sets if lang == k][: langid.LANDMARKS]]
    values, vectors = np.linalg.eigh(np.asarray([[kernel(x, y) for y in marks] for x in marks]))
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.asarray([[kernel(x, y) for y in marks] for _, x in sets]) @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    y = np.asarray([[1 if lang == k else -1 for k in langs] for lang, _ in sets])
    w = np.asarray([len(sets) / len(langs) / sum(x == lang for x, _ in sets) for lang, _ in sets])[:, None]
    coef = np.linalg.solve(z.T @ (w * z) + langid.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ (w * y))

    def cells(text):
        b = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode())
        gram = lambda n, i: (int.from_bytes(b[i : i + n]) + (n << 24)) * 2654435761 % (1 << 32) >> (32 - langid.BITS)
        return {gram(n, i) for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    got = {r["doc_id"]: r for r in langid.predict(docs, (langs, folded)).collect()}
    for r in table:
        if not any(map(str.isalpha, r["text"])):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        f = np.append(np.asarray([kernel(cells(r["text"]), m) for m in marks]) @ root, 1) @ coef
        assert got[r["doc_id"]]["lang_pred"] == langs[int(f.argmax())]
        assert abs(got[r["doc_id"]]["score"] - np.clip((f.max() + 1) / 2, 0, 1)) < 1e-3


@pytest.mark.parametrize("langs", [("de", "en"), ("de", "en", "es")])
def test_unseen_scripts_are_not_identified(spark, sf_dir, langs):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").where(F.col("lang").isin(*langs)).select("doc_id", "text", "lang")
    strange = ("Ἐν ἀρχῇ ἦν ὁ λόγος καὶ ὁ λόγος ἦν πρὸς τὸν θεόν", "今日は天気がいいから散歩しましょう東京の空は青い", "Все счастливые семьи похожи друг на друга", "½ ² ①")
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(strange)], docs.schema)
    kept = langid.keep_identified(docs.unionByName(more))
    assert not kept.where(F.col("doc_id") >= 10**9).count() and kept.count() >= 0.99 * docs.where("text is not null").count()


def test_predictions_ignore_other_columns(awkward):
    model = langid.train(awkward)
    a = rows(langid.predict(awkward.select("doc_id", "text"), model), "doc_id", "lang_pred", "score")
    moved = awkward.withColumn("lang", F.lit("de")).withColumn("source", F.lit("z"))
    assert rows(langid.predict(moved, model), "doc_id", "lang_pred", "score") == a

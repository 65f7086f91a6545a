"""Personal data: the patterns against their own regular expressions, the field against enumeration, added spans by example."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from odflux.llm import pii, queries

LITERAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    """(kind, start, end) by the expressions as they stand."""
    out = []
    for kind, pattern in LITERAL.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


PIECES = ["a", "Z", ".", "@", "-", "_", "%", "+", "1", "22", "255.", "300", "é", " ", "(", ")", "\n", "@x.y", "1.2.3.4", "+1 ", "4845168114407329", "4845 1681 1440 7329", "😀"]


@pytest.mark.parametrize("seed", range(4))
def test_patterns_equal_their_expressions(seed):
    rnd = random.Random(seed)
    for _ in range(3000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30)))
        assert [(k, *s) for k, spans in zip(pii.KINDS, pii.patterns(text)) for s in spans] == brute(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "a." * 150_000, "@" * 300_000, "1." * 150_000, "+1 " * 100_000, "1-" * 150_000, "a@" * 150_000, "(1" * 150_000])
def test_long_texts_take_linear_time(text):
    pii.patterns(text)
    pii.graph(text, pii.atoms(text))


def test_beliefs_of_a_tree_equal_enumeration(monkeypatch):
    monkeypatch.setattr(pii, "LABELS", 3)
    rng = np.random.default_rng(5)
    field = pii.Field()
    field.nodes, field.pairs = rng.normal(size=(4, 3)), rng.normal(size=(3, 3, 3))
    on = rng.integers(0, 2, size=(5, 4)).astype(float)
    edges = np.array([(0, 1, 0), (1, 2, 0), (1, 3, 1), (0, 4, 2)])
    want, total = np.zeros((5, 3)), 0.0
    for y in itertools.product(range(3), repeat=5):
        w = np.exp(sum((on @ field.nodes)[i, y[i]] for i in range(5)) + sum(field.pairs[k, y[i], y[j]] for i, j, k in edges))
        total += w
        for i in range(5):
            want[i, y[i]] += w
    belief, both = field.beliefs(on, edges, 200)
    assert np.allclose(belief, want / total, atol=1e-9) and np.allclose(both.sum(axis=(1, 2)), 1)


def test_the_fit_recovers_what_agrees():
    rng = np.random.default_rng(7)
    label = np.repeat(rng.choice([0, 5], size=400), 2)
    on = np.zeros((800, pii.FEATURES))
    on[:, 0] = 1
    on[::2, 3] = label[::2] == 5  # only the first of each pair shows what it is
    edges = np.array([(i, i + 1, 1) for i in range(0, 800, 2)])
    field = pii.Field().fit(on, label, edges)
    belief, _ = field.beliefs(on, edges)
    assert (belief.argmax(axis=1) == label).mean() > 0.99


CARD, OTHER, DECOY = "4845168114407329", "7536784127813050", "4845168114407320"
FILLER = [f"the note {k} names {CARD} and {OTHER}, not {DECOY}; mail u{k}@mail.example.com or ask 10.2.{k}.9, phone +1 (017) 555-77{k:02d} 3 times in 12{k}" for k in range(60)]


@pytest.fixture(scope="module")
def corpus(spark, awkward):
    extra = [(1000 + k, t) for k, t in enumerate(FILLER)] + [(2000, f"first {CARD} then {OTHER} {CARD} and {DECOY}."), (2001, f"{DECOY} {DECOY} twelve 4845168114407")]
    return awkward.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))


def test_numbers_in_a_row_are_found_and_decoys_left(corpus):
    got = {r["doc_id"]: r["spans"] for r in pii.detect(corpus).where("doc_id >= 2000").collect()}
    text = f"first {CARD} then {OTHER} {CARD} and {DECOY}."
    found = [(s["kind"], text[s["start"] : s["end"]], s["base"]) for s in got[2000]]
    assert found == [("card", CARD, True), ("card", OTHER, False), ("card", CARD, False)]
    assert got[2001] == []


def test_digests_equal_brute_force(corpus):
    for r, text in zip(pii.digests(corpus).orderBy("doc_id").collect(), [x["text"] for x in corpus.orderBy("doc_id").collect()]):
        base = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        spans = [s for s in r["spans"].split(",") if s]
        assert set(joined.split(",")) - {""} <= set(spans) and len(spans) == len(base) + r["n_added"]
        keys = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert keys == sorted(keys)


def test_batches_change_nothing(spark, corpus):
    field = pii.learn(corpus)
    want = sorted(map(str, pii.detect(corpus, field).collect()))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        assert sorted(map(str, pii.detect(corpus.repartition(5), field).collect())) == want
    finally:
        spark.conf.set(name, before)


def test_masked_texts_keep_the_rest(corpus):
    df = corpus.selectExpr("doc_id", "text", "1 as `_text`", "2 as spans")
    rows = {r["doc_id"]: r for r in pii.masked(df).collect()}
    assert rows[2000]["text"] == f"first [card] then [card] [card] and {DECOY}." and rows[2000]["_text"] == 1
    assert rows[4]["text"] is None and rows[5]["text"] == "" and pii.masked(df).columns == df.columns
    assert "[email]" in rows[1000]["text"] and "mail.example" not in rows[1000]["text"]


def test_query_over_the_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op13_skip_chain_pii(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        if not re.search("[0-9@]", texts[r["doc_id"]] or ""):
            assert r["spans"] == ""


def test_nothing(nothing):
    assert pii.digests(nothing).count() == 0 and pii.masked(nothing).columns == nothing.columns

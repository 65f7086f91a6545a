"""The prefix trie against a brute-force one over whole texts."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from odflux.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        opener = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(opener, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        todo, out = [p], []
        while todo:
            out.append(todo.pop())
            todo += kids[out[-1]]
        return out

    out = []
    for p, ids in members.items():
        sub = below(p)
        ends = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids[p]), sum(not kids[q] for q in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


AWKWARD = [
    *[(0, t, "user", f"opening {t}") for t in range(4)],
    *[(c, t, "user" if t % 2 else "bot", f"turn {t} of {c % 3} 😀é") for c in range(1, 40) for t in range(1 + c % 8)],
    *[(c, t, "user", "same") for c in range(300, 360) for t in range(7)],
    (205, 1, None, None),
    (205, None, "user", "first by null turn"),
    (205, None, "user", "first by null turn"),
    (206, 3, "a", "tie"),
    (206, 3, "a", "another"),
    (206, 3, "b", ""),
    (-7, 0, "user", "a negative id"),
    (-7, 1, "user", "and more"),
    (-107, 1, "user", "its block has an opener"),
    (-100, 5, "user", "opener"),
    (None, 0, "user", "of no conversation"),
    (207, 0, "user", "long " * 50_000),
    *[(208, t, "user", f"line {t % 5}") for t in range(900)],
    *[(408, t, "user", f"line {t % 5}") for t in range(700)],
]


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_trie_equals_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = trie.trie(spark.createDataFrame(AWKWARD, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == brute(AWKWARD)


def test_a_conversation_is_split_over_tasks(spark):
    rows = [(8, t, "user", str(t)) for t in range(400)]
    turns = spark.createDataFrame([(8, t, t * 7 + 1, t * t + 3, 2) for t in range(400)], "conv_id long, turn long, a long, b long, tokens long")
    got = trie.prefixes(turns, ["turn"]).orderBy("depth").collect()
    assert len({(r["k1"], r["k2"]) for r in got}) == len(rows)
    want, word = 0, 1 << 64
    for r in got:
        assert r["before"] == 2 * (r["depth"] - 1) and r["p1"] % word == want
        want = (want + r["a"] * pow(trie.BASES[0], r["depth"] - 1, word)) % word
        assert r["k1"] % word == want


def test_common_ends_are_hashed_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 10)
    rows = [(2, 5, 6, c) for c in range(995, 1100)] + [(1, 5, 6, 3), (2, 5, 7, 4)]
    got = {(r["depth"], r["k1"], r["k2"]): r["ends_sha256"] for r in trie.end_digests(spark.createDataFrame(rows, "depth long, k1 long, k2 long, conv_id long").repartition(7)).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(2, 5, 6): sha(range(995, 1100)), (1, 5, 6): sha([3]), (2, 5, 7): sha([4])}


def test_other_columns_and_nothing(spark):
    df = spark.createDataFrame([(*r, 1, "x", None) for r in AWKWARD[:60]], SCHEMA + ", depth int, k1 string, `a b` int")
    assert sorted(map(tuple, trie.trie(df).collect())) == brute(AWKWARD[:60])
    none = trie.trie(df.limit(0))
    assert none.columns == OUT and none.count() == 0

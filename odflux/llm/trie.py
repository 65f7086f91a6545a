"""Conversation prefix trie by smallest-member ownership, over digests of turns; texts never leave the scan.

A node is a sequence of first turns that some rebuilt conversation has.  Its owner is the smallest conversation that starts
with it; below the first node that a conversation owns it owns every node of its path, so each owns a suffix.  A group-by
of prefixes finds the owners, a scan along each conversation has the tokens before its suffix, and one more group-by of
prefixes adds up, over a node's members, their tokens in its subtree less those they own there.

Prefixes are told apart by two polynomial sums modulo 2**64 over hashes of the turns' SHA-256 digests.  They are sums, so
tasks take them over ranges of the rows in order, each from what the ranges before left off: a conversation with a third
of all turns is split over tasks, and only one row for each partition goes through the driver.  Joins by conversation or
parent broadcast the keys with so many rows that ``least_heavy`` bounds their number.

Defined cases: a null role or text is empty; a null turn comes first; equal turns are in order of role, then of digest; a
repeated row is one more turn; rows with a null conv_id take no part; very long texts are hashed whole; other columns are
ignored; an empty table gives an empty result, as there is no conversation that could start with the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflux.llm._common import durable, least_heavy, meet

#: Conversations in a block that share their opening, and the most opening turns that are shared.
BLOCK, HEAD = 100, 5
#: Odd multipliers of the two sums.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Ids in one chunk of the list whose digest is taken.
CHUNK = 1 << 16
_WORD = (1 << 64) - 1
NODE = ["depth", "k1", "k2"]


def head_turns(conv: Column) -> Column:
    """How many opening turns a conversation takes from the first one of its block."""
    return F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    out = np.ones(len(exponent), dtype=np.uint64)
    for bit in range(int(exponent.max(initial=0)).bit_length()):
        out = np.where((exponent >> bit) & 1 == 1, out * np.uint64(base), out)
        base = base * base & _WORD
    return out


def _walk(batches: Iterator[pd.DataFrame], carried: dict[int, tuple]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], tuple]]:
    """Each batch with, for every row, its index in its conversation, both sums and the tokens up to it; and where it ends.

    Rows are in order of conversation; ``carried`` has (conversation, rows, sums, tokens) before each partition."""
    at = None
    for df in batches:
        if df.empty:
            continue
        if at is None:
            at = carried.get(int(df["_pid"].iloc[0]), (None, 0, 0, 0, 0))
        conv, place = df["conv_id"].to_numpy(), np.arange(len(df))
        first = np.r_[True, conv[1:] != conv[:-1]]
        start = np.maximum.accumulate(np.where(first, place, 0))
        goes_on = (start == 0) & (at[0] == conv[0])
        index = place - start + np.where(goes_on, at[1], 0)
        found = [index]
        columns = [df[c].to_numpy().view(np.uint64) * _power(b, index) for c, b in zip(("a", "b"), BASES)]
        for value, before in zip([*columns, df["tokens"].to_numpy().astype(np.uint64)], at[2:]):
            run = np.cumsum(value, dtype=np.uint64)
            found.append(run - (run - value)[start] + np.where(goes_on, np.uint64(before), np.uint64(0)))
        at = (int(conv[-1]), int(index[-1]) + 1, *[int(x[-1]) for x in found[1:]])
        yield df, found, at


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for a partition: its first conversation, and how far it came in its last one."""
    pid = first = at = None
    for df, _found, at in _walk(batches, {}):
        if pid is None:
            pid, first = int(df["_pid"].iloc[0]), int(df["conv_id"].iloc[0])
    if pid is not None:
        signed = [int(np.uint64(x).view(np.int64)) for x in at[2:]]
        yield pd.DataFrame([(pid, first, *at[:2], *signed)], columns=["pid", "first", "last", "n", "a", "b", "tokens"])


def prefixes(turns: DataFrame, order: list[Column | str]) -> DataFrame:
    """Turns (conv_id, a, b, tokens) with their depth from 1, the sums k1 and k2 up to them, those before (p1, p2), and the
    tokens before; conversations are split over tasks."""
    names = ["conv_id", "a", "b", "tokens"]
    placed = durable(turns.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select(*names, F.spark_partition_id().alias("_pid")))
    carried: dict[int, tuple] = {}
    held: tuple = (None, 0, 0, 0, 0)
    for r in sorted(placed.mapInPandas(_ends, "pid int, first long, last long, n long, a long, b long, tokens long").collect()):
        sums = [x & _WORD for x in (r["a"], r["b"], r["tokens"])]
        if held[0] == r["first"]:
            carried[r["pid"]] = held
        if held[0] == r["first"] == r["last"]:
            moved = [pow(b, held[1], 1 << 64) * x for b, x in zip((*BASES, 1), sums)]
            held = (r["last"], held[1] + r["n"], *[(x + y) & _WORD for x, y in zip(held[2:], moved)])
        else:
            held = (r["last"], r["n"], *sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, (index, k1, k2, upto), _at in _walk(batches, carried):
            own = [df[c].to_numpy().view(np.uint64) * _power(b, index) for c, b in zip(("a", "b"), BASES)]
            yield df[names].assign(
                depth=index + 1, k1=k1.view(np.int64), k2=k2.view(np.int64), p1=(k1 - own[0]).view(np.int64), p2=(k2 - own[1]).view(np.int64),
                before=upto.view(np.int64) - df["tokens"].to_numpy(),
            )

    return placed.mapInPandas(run, "conv_id long, a long, b long, tokens long, depth long, k1 long, k2 long, p1 long, p2 long, before long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids of all conversations, turns of the rebuilt ones with ``place``, by which they are in order)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("tokens"))
    hashed = turns.select("conv_id", "turn", "role", "digest", "tokens", F.xxhash64(F.lit(0), "digest").alias("a"), F.xxhash64(F.lit(1), "digest").alias("b"))
    own = durable(prefixes(hashed, [F.asc_nulls_first("turn"), "role", "digest"]).select("conv_id", "a", "b", "tokens", F.col("depth").alias("place")))
    ids = own.select("conv_id").distinct()
    tail = own.where(F.col("place") > head_turns(F.col("conv_id")))
    takers = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("opener"), head_turns(F.col("conv_id")).alias("h"))
    opening = own.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") <= HEAD)).withColumnRenamed("conv_id", "opener")
    head = takers.join(opening, "opener").where(F.col("place") <= F.col("h")).select("conv_id", "a", "b", "tokens", (F.col("place") - HEAD - 1).alias("place"))
    return ids, tail.unionByName(head)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Comma-joined ids of each run of rows of a node, in chunks."""
    for df in batches:
        out = []
        for node, rows in groupby(df[[*NODE, "conv_id"]].itertuples(index=False, name=None), key=lambda r: r[:3]):
            while part := [r[3] for r in islice(rows, CHUNK)]:
                out.append((*node, part[0], ",".join(map(str, part))))
        yield pd.DataFrame(out, columns=[*NODE, "first", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's chunks in order, which follow each other."""
    node, state = None, None
    for df in batches:
        out = []
        for *key, ids in df[[*NODE, "ids"]].itertuples(index=False, name=None):
            if key == node:
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids, in numerical order, of the conversations that end at each node.

    The ids are sorted and joined to chunks by ranges, so one task just feeds the chunks of a common node to its digest."""
    parts = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    chunks = parts.mapInPandas(_chunks, "depth long, k1 long, k2 long, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ids, turns = rebuilt(conversations)
    zero = F.lit(0).cast("long")
    root = ids.select("conv_id", *[zero.alias(c) for c in (*NODE, "p1", "p2", "tokens", "before")])
    paths = durable(root.unionByName(prefixes(turns, ["place"]).select(*root.columns)))
    total = paths.count()
    ends = durable(paths.groupBy("conv_id").agg(F.max_by(F.struct("depth", "k1", "k2", (F.col("before") + F.col("tokens")).alias("whole")), "depth").alias("e")).select("conv_id", "e.*"))
    # Owners of the nodes, and whether all that reach a node end there.
    marks = paths.select("conv_id", *NODE, "p1", "p2", "before", F.lit(1).alias("ends")).unionByName(
        ends.select("conv_id", *NODE, *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2", "before")], F.lit(-1).alias("ends"))
    )
    owned = marks.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.sum("ends").alias("further"), *[F.min(c).alias(c) for c in ("p1", "p2", "before")])
    suffix = owned.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by("before", "depth").alias("unowned"), F.max_by(F.col("further") == 0, "depth").cast("long").alias("leaf"))
    lines = ends.join(suffix, "conv_id", "left").select(
        "conv_id", F.col("depth").alias("last"), F.coalesce("top", F.col("depth") + 1).alias("top"), F.coalesce("unowned", "whole").alias("unowned"), F.coalesce("leaf", zero).alias("leaf"), (F.col("depth") + 1).alias("k")
    )
    # Tokens of a member in a node's subtree, less those it owns there: those between the node and the member's suffix.
    walked = meet(paths, lines, "conv_id", least_heavy(total), ["depth"])
    nodes = walked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.min_by(F.struct("last", "top"), "conv_id").alias("o"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.greatest(F.col("unowned") - F.col("before"), zero)).alias("saved_tokens"),
        F.sum("leaf").alias("n_leaves"),
        F.count_if((F.col("top") == F.col("depth") + 1) & (F.col("top") <= F.col("last"))).alias("branches"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    nodes = durable(nodes.withColumn("n_children", F.col("branches") + (F.col("o.last") > F.col("depth")).cast("long")))
    # Only the first node of a suffix has a parent of another owner.
    node = lambda depth, a, b: F.struct(depth.alias("depth"), F.col(a).alias("k1"), F.col(b).alias("k2")).alias("node")
    out = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "k1", "k2"]
    tops = nodes.where("depth > 0 and depth = o.top").select(*out, node(F.col("depth") - 1, "p1", "p2"))
    owners = nodes.where("branches > 0").select(node(F.col("depth"), "k1", "k2"), F.col("conv_id").alias("parent_conv_id"), F.col("branches").alias("k"))
    joined = meet(tops, owners, "node", least_heavy(total), ["conv_id"]).drop("node")
    own = nodes.where("depth = 0 or depth > o.top").select(*out, F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"))
    full = joined.unionByName(own).join(end_digests(ends), NODE, "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


def oracle() -> str:
    """DuckDB SQL for ``trie`` over ``conversations``: prefixes as lists of turns."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE crc_steps(byte, k, c) AS (
  SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT byte, k + 1, {step} FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM crc_steps WHERE k = 8),
turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
seqs AS (SELECT c, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || t)) AS s FROM turns GROUP BY c),
heads AS (
  SELECT c, c - c % {BLOCK} AS opener, s, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda x, v: xor(x >> 8, t[1 + xor(x & 255, v)]), CAST(4294967295 AS BIGINT))) % {HEAD + 1} AS h
  FROM seqs, crc_table),
built AS (SELECT q.c, CASE WHEN b.s IS NULL THEN q.s[h + 1:] ELSE list_concat(b.s[1:h], q.s[h + 1:]) END AS s FROM heads q LEFT JOIN seqs b ON b.c = q.opener),
paths AS (SELECT c, len(s) AS n, d, s[1:d] AS p FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM built)),
nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM paths GROUP BY d, p),
links AS (SELECT k.d, k.p, k.conv_id, m.conv_id AS parent_conv_id, m.p AS up FROM nodes k JOIN nodes m ON m.d = k.d - 1 AND m.p = k.p[1:k.d - 1]),
sums AS (
  SELECT d, p, sum(saved) AS saved_tokens, count(*) FILTER (childless) AS n_leaves FROM (
    SELECT unnest(range(d + 1)) AS d, p AS whole, p[1:unnest(range(d + 1))] AS p, CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].t) ELSE 0 END AS saved, (d, p) NOT IN (SELECT (d - 1, up) FROM links) AS childless FROM nodes)
  GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM links GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, l.parent_conv_id, a.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN sums s ON a.d = s.d AND a.p = s.p LEFT JOIN links l ON a.d = l.d AND a.p = l.p LEFT JOIN kids k ON a.d = k.d AND a.p = k.p"""

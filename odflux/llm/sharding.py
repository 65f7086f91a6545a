"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in ascending order of their id; a keyed Feistel network permutes the numbers, and cycle
walking keeps the result inside 0..n-1.  The permuted number gives shard (``mod shards``) and slot (``div shards``),
so the shuffle is reproducible, both directions can be computed from (n, key), slots have no gaps and shard sizes
differ by one at most.  The law is therefore ``rows``.

Only narrow rows (id, size, checksum) are shuffled: texts stay where they are read.

Defined cases: a null text counts as no bytes (size 1, checksum 0); a null id sorts first; repeated ids are ordered
by size, checksum and a 64-bit content hash, and rows equal in all of these are interchangeable; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflux.llm._common import global_row_number

ROUNDS = 6
#: Prime modulus of the round function; products of two residues fit a signed 64-bit integer.
PRIME = 2147483647
#: Steps of the walk.  The domain exceeds n by less than its first side, so few rows need one step at all.
WALK = 32


def round_keys(key: str) -> list[tuple[int, int, int]]:
    """Three residues for each round, from the key."""
    out = []
    for j in range(ROUNDS):
        h = hashlib.sha256(f"{key}/{j}".encode()).digest()
        out.append(tuple(1 + int.from_bytes(h[8 * i : 8 * i + 8], "big") % (PRIME - 1) for i in range(3)))
    return out


def sides(n: int) -> tuple[int, int]:
    """The two sides a, b of the domain: a * b >= n, and less than n + a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mix(v: str, k: tuple[int, int, int]) -> str:
    t = f"(({v} * {k[0]} + {k[1]}) % {PRIME})"
    return f"(({t} * {t} + {v} * {k[2]}) % {PRIME})"


def feistel_sql(x: str, n: int, key: str) -> str:
    """Spark SQL for one pass of the network over the integer expression ``x``; the state is a two-field struct."""
    a, b = sides(n)
    state = f"named_struct('l', {x} % {a}, 'r', {x} div {a})"
    steps = ", ".join(f"named_struct('j', {j}, 'p', {p}L, 'q', {q}L, 's', {s}L)" for j, (p, q, s) in enumerate(round_keys(key)))
    mix = lambda v: f"((((({v}) * k.p + k.q) % {PRIME}) * ((({v}) * k.p + k.q) % {PRIME}) + ({v}) * k.s) % {PRIME})"
    return (
        f"aggregate(array({steps}), {state}, (h, k) -> if(k.j % 2 = 0, "
        f"named_struct('l', (h.l + {mix('h.r')}) % {a}, 'r', h.r), "
        f"named_struct('l', h.l, 'r', (h.r + {mix('h.l')}) % {b})), h -> h.r * {a} + h.l)"
    )


def permuted(x: str, n: int, key: str) -> Column:
    """The image of row number ``x`` among 0..n-1.  A walk left unfinished raises; it can't for n up to about WALK**2."""
    step = lambda v: feistel_sql(f"({v})", n, key)
    walked = f"aggregate(sequence(1, {WALK}), {step(x)}, (acc, i) -> if(acc < {n}L, acc, {step('acc')}))"
    return F.expr(f"transform(array({walked}), v -> if(v < {n}L, v, cast(raise_error('cycle walk unfinished') as bigint)))[0]")


def shard_rows(df: DataFrame, shards: int = 8, key: str = "odflux-shards", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h"),
    )
    numbered, n = global_row_number(narrow, ["doc_id", "size", "text_crc32", "_h"])
    image = permuted("row_no", max(n, 1), key)
    return numbered.withColumn("_p", image).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.expr(f"_p div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("row_no").cast("long").alias("row_no"),
    )


def oracle(shards: int = 8, key: str = "odflux-shards") -> str:
    """DuckDB SQL for ``shard_rows`` over ``documents``: the network as arithmetic, the walk as recursion."""
    dims = "(SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, greatest(1, 1 + CAST(floor(sqrt(greatest(n - 1, 0))) AS BIGINT)) AS a FROM (SELECT count(*) AS n FROM documents)))"

    def network(source: str) -> str:
        """One pass over column x of ``source``, which also has row_no, n, a, b."""
        sql = f"(SELECT row_no, n, a, b, x % a AS l, x // a AS r FROM {source})"
        for j, k in enumerate(round_keys(key)):
            side = f"(l + {_mix('r', k)}) % a AS l, r" if j % 2 == 0 else f"l, (r + {_mix('l', k)}) % b AS r"
            sql = f"(SELECT row_no, n, a, b, {side} FROM {sql})"
        return f"SELECT row_no, n, a, b, r * a + l AS x FROM {sql}"

    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE crc_steps(byte, k, c) AS (
  SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT byte, k + 1, {step} FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM crc_steps WHERE k = 8),
base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_no FROM documents),
walk AS (
  {network(f'(SELECT row_no, n, a, b, row_no AS x FROM base, {dims})')}
  UNION ALL
  SELECT row_no, n, a, b, x FROM ({network('(SELECT * FROM walk WHERE x >= n)')})),
placed AS (SELECT row_no, CAST(x AS BIGINT) AS x FROM walk WHERE x < n),
sums AS (
  SELECT row_no, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda c, v: xor(c >> 8, t[1 + xor(c & 255, v)]), CAST(4294967295 AS BIGINT))) AS crc
  FROM base, crc_table)
SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(row_no AS BIGINT) AS row_no
FROM base JOIN placed USING (row_no) JOIN sums USING (row_no)"""

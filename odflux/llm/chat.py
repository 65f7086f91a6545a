"""Chat formatting: tool calls linked to their results, ordered, validated and serialised as canonical JSON.

The general interface takes two tables:

* calls: conv_id, turn, call_id, parent_id (the call whose result this one needs, or null), name, arguments (JSON text)
* results: conv_id, turn, call_id, content

``link`` hash-joins results to calls by (conv_id, call_id), finds each call's depth in the dependency forest by
pointer doubling, validates its arguments against the schema of its name, and writes each pair as one line of
canonical JSON: keys sorted, no white space, no escapes that JSON doesn't need.  (depth, turn) orders a conversation
topologically: a call comes after the call that it depends on.

``exchanges`` reads such tables out of plain conversations: each user turn is a call of ``respond``, depends on the
user turn before it in its conversation, and is answered by the assistant turns up to the next user turn.  The turn
before is found from a range-partitioned order and a carried value for each partition, so a conversation that holds
a third of all rows is spread over many tasks.

``others`` gives a row of kind ``turn`` for each turn that is neither of the user nor of the assistant (system turns,
null and other roles), with its role and text as canonical JSON, and one more for each repeated row; texts are taken whole
and row by row, however long.  ``format_all`` gives these and the exchanges, so every turn of the table is in it; its rows
are in no order.  ``format_chats`` is the exchanges alone.

Defined cases: null conv_id is a conversation of its own; null turns sort first; a result without a call gives a row
of kind ``orphan``; a call without a result has ``answered`` false; of repeated (conv_id, call_id) calls each is
kept, all with the same results; a parent that doesn't exist counts as none; a cycle gives depth null and is not valid;
null arguments, ones that aren't JSON or have no canonical form (``parsed``) are not valid; an unknown name is not valid;
repeated rows of a user turn depend on the turn before, never on each other, and a null turn depends on none; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from odflux.llm._common import durable

#: Schemas by tool name: a subset of JSON Schema (type, required, properties, minLength, enum, additionalProperties).
SCHEMAS: dict[str, dict[str, Any]] = {
    "respond": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer"}},
        "additionalProperties": False,
    }
}
TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def problem(value: Any, schema: dict[str, Any], at: str = "$") -> str | None:
    """The first violation of ``schema``, or None."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or kind in ("integer", "number") and isinstance(value, bool)):
        return f"{at}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not allowed"
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return f"{at}: too short"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := problem(value[name], known[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: unknown"
    return None


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("repeated key")
    return found


def _constant(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def parsed(text: str | None) -> Any:
    """The value of a JSON text.  ValueError where it isn't JSON or has no canonical form: NaN and numbers beyond a
    double's range, repeated keys, lone surrogates, nesting beyond what the parser takes."""
    try:
        value = json.loads(text or "", object_pairs_hook=_once, parse_constant=_constant)
        canonical(value).encode()
    except RecursionError:
        raise ValueError("nested too deep") from None
    return value


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of each distinct call: 0 for a root; null on a cycle.  O(log depth) joins on the call's key.

    Each round replaces a call's ancestor by that ancestor's ancestor, and adds up the distance.
    """
    nodes = calls.groupBy("conv_id", "call_id").agg(F.min("parent_id").alias("up"))
    known = nodes.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"))
    rooted = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("k")), "left")
    state = durable(rooted.select("conv_id", "call_id", F.col("k").alias("up"), F.when(F.col("k").isNull(), 0).otherwise(1).alias("depth")))
    total = state.count()
    reach = 1
    while reach <= 2 * total and not state.where("up is not null").isEmpty():
        above = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        stepped = state.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("k")), "left")
        state = durable(stepped.select("conv_id", "call_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0)).cast("long")).cast("long").alias("depth")))
        reach *= 2
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).cast("int").alias("depth"))


LINKED = StructType(
    [
        StructField("conv_id", LongType()),
        StructField("turn", LongType()),
        StructField("call_id", StringType()),
        StructField("kind", StringType()),
        StructField("result_turn", LongType()),
        StructField("answered", BooleanType()),
        StructField("depth", IntegerType()),
        StructField("valid", BooleanType()),
        StructField("problem", StringType()),
        StructField("message", StringType()),
    ]
)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, Any]] = SCHEMAS) -> DataFrame:
    """One row for each (call, result) pair, each unanswered call and each orphaned result; see ``LINKED``."""
    depth = depths(calls)
    d = depth.select(F.col("conv_id").alias("dc"), F.col("call_id").alias("dk"), "depth").hint("shuffle_hash")
    same = lambda c, k: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("call_id") == F.col(k))
    placed = calls.join(d, same("dc", "dk"), "left").drop("dc", "dk")
    r = results.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rk"), F.col("turn").alias("result_turn"), "content")
    paired = placed.join(r.hint("shuffle_hash"), same("rc", "rk"), "left")
    rows = paired.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "call_id",
        F.lit("call").alias("kind"),
        F.col("result_turn").cast("long").alias("result_turn"),
        F.col("rk").isNotNull().alias("answered"),
        "depth",
        "parent_id",
        "name",
        "arguments",
        "content",
    )
    # orphans by an anti join, which can be split where one conversation has very many
    known = depth.select("conv_id", "call_id").hint("shuffle_hash")
    lost = r.join(known, same("rc", "rk"), "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    orphans = lost.select(
        F.col("rc").cast("long").alias("conv_id"),
        F.col("result_turn").cast("long").alias("turn"),
        F.col("rk").alias("call_id"),
        F.lit("orphan").alias("kind"),
        F.col("result_turn").cast("long").alias("result_turn"),
        F.lit(False).alias("answered"),
        none("int").alias("depth"),
        *[none("string").alias(c) for c in ("parent_id", "name", "arguments")],
        "content",
    )
    rows = rows.unionByName(orphans)
    names = LINKED.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, problems, messages = [], [], []
            for row in batch.to_pylist():
                fault, arguments = None, None
                if row["kind"] == "orphan":
                    fault = "no such call"
                elif row["name"] not in schemas:
                    fault = "no such tool"
                else:
                    try:
                        arguments = parsed(row["arguments"])
                        fault = problem(arguments, schemas[row["name"]])
                    except ValueError:
                        fault = "arguments aren't JSON"
                    if row["depth"] is None:
                        fault = fault or "dependency cycle"
                valid.append(fault is None)
                problems.append(fault)
                call = {"arguments": arguments, "id": row["call_id"], "name": row["name"], "parent": row["parent_id"]}
                messages.append(canonical({"call": None if row["kind"] == "orphan" else call, "result": row["content"]}))
            columns = [batch.column(n) for n in names[:7]] + [pa.array(valid, pa.bool_()), pa.array(problems, pa.string()), pa.array(messages, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, LINKED)


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls and results tables of plain conversations."""
    keys = ["conv_id", "turn", "role", "_h"]
    narrow = conversations.select("conv_id", "turn", "role", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), "text")
    placed = durable(
        narrow.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    user = F.when(F.col("role") == "user", F.struct("conv_id", "turn"))
    # the last user turn strictly before, in this partition: rows of one turn see the same
    local = Window.partitionBy("_pid", "conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("_user", user).withColumn("_near", F.when(F.col("turn").isNotNull(), F.last("_user", ignorenulls=True).over(local)))
    # the two last user turns of earlier partitions: the last may be the row's own turn, of which rows lie there too
    tail = near.groupBy("_pid").agg(F.max("_user").alias("last"), F.max_by("_near", "_user").alias("prior"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    tail = tail.withColumn("one", F.max("last").over(earlier))
    changed = F.when(F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("one")), F.struct(F.coalesce("prior", "one").alias("x")))
    tail = tail.select("_pid", "one", F.last(changed, ignorenulls=True).over(earlier)["x"].alias("two"))
    own = F.struct("conv_id", "turn")
    carried = F.when(F.col("turn").isNotNull(), F.when(F.col("one").eqNullSafe(own), F.col("two")).otherwise(F.col("one")))
    seen = near.join(F.broadcast(tail), "_pid").withColumn("_before", F.coalesce("_near", carried))
    parent = F.when(F.col("_before.conv_id").eqNullSafe(F.col("conv_id")), call_id(F.col("_before.conv_id"), F.col("_before.turn")))
    parent = F.when(F.col("_before").isNotNull(), parent)
    known = seen.withColumn("_parent", parent)
    calls = known.where("role = 'user'").select(
        "conv_id",
        "turn",
        call_id(F.col("conv_id"), F.col("turn")).alias("call_id"),
        F.col("_parent").alias("parent_id"),
        F.lit("respond").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn"))).alias("arguments"),
    )
    results = known.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("_parent", F.lit("none")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def others(conversations: DataFrame) -> DataFrame:
    """A row of kind ``turn`` for each turn that ``exchanges`` has no place for; see ``LINKED``."""
    rest = conversations.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    names = LINKED.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            messages = [canonical({"turn": {"role": r, "text": t}}) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            columns = [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.nulls(n, pa.string()),
                pa.array(["turn"] * n, pa.string()),
                pa.nulls(n, pa.int64()),
                pa.array([False] * n, pa.bool_()),
                pa.nulls(n, pa.int32()),
                pa.array([True] * n, pa.bool_()),
                pa.nulls(n, pa.string()),
                pa.array(messages, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rest.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")}).mapInArrow(run, LINKED)


def format_all(conversations: DataFrame) -> DataFrame:
    """Exchanges and all other turns."""
    return format_chats(conversations).unionByName(others(conversations))


def call_id(conv: Column, turn: Column) -> Column:
    return F.concat(F.lit("call_"), F.coalesce(conv.cast("string"), F.lit("null")), F.lit("_"), F.coalesce(turn.cast("string"), F.lit("null")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Linked, ordered, validated exchanges of all conversations."""
    return link(*exchanges(conversations))


def oracle() -> str:
    """DuckDB SQL for ``format_all`` over ``conversations``, for tables without nulls or repeated turns."""
    return """
WITH seen AS (
  SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS before,
    CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w, 0) AS INTEGER) AS depth
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
calls AS (SELECT *, 'call_' || conv_id || '_' || turn AS call_id, 'call_' || conv_id || '_' || before AS parent FROM seen WHERE role = 'user'),
results AS (SELECT conv_id, turn AS result_turn, text AS content, coalesce('call_' || conv_id || '_' || before, 'none') AS answers FROM seen WHERE role = 'assistant'),
paired AS (
  SELECT c.conv_id, turn, call_id, parent, depth, text, result_turn, content FROM calls c LEFT JOIN results r ON r.answers = c.call_id AND r.conv_id = c.conv_id)
SELECT conv_id, turn, call_id, 'call' AS kind, result_turn, result_turn IS NOT NULL AS answered, depth,
  length(text) >= 1 AS valid, CASE WHEN length(text) < 1 THEN '$.prompt: too short' END AS problem,
  '{"call":{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(call_id) || ',"name":"respond","parent":' || coalesce(CAST(to_json(parent) AS VARCHAR), 'null')
    || '},"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS message
FROM paired
UNION ALL
SELECT conv_id, result_turn, answers, 'orphan', result_turn, false, NULL, false, 'no such call',
  '{"call":null,"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}'
FROM results WHERE answers = 'none'
UNION ALL
SELECT conv_id, turn, NULL, 'turn', NULL, false, NULL, true, NULL, '{"turn":{"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""

"""Chat formatting with tool calls, in DataFrame operations only.

Calls and results are linked by an equi-join on the call's identifier.  Every message has at most one message it must
follow (a result its call, a call the result before it), so the dependencies are a forest, and a message's place in
the topological order is its depth: found by pointer doubling, each round an equi-join that doubles the steps known,
so a conversation of n messages takes log2(n) rounds.  From depths come positions.  Messages on a cycle get no depth.  Arguments are validated
against the schema of the called tool with variant functions, and each message becomes one line of canonical JSON
(sorted keys, no spaces).  Lines, not conversations, are the rows: one huge conversation never has to fit in a task;
`position` is a line's place in its conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .kit import drop_scratch, hot_values, lookup, scratch, spread

#: tool -> argument -> type, as schema_of_variant names it; a trailing ? marks an optional argument.
Schemas = dict[str, dict[str, str]]
REPLY: Schemas = {"reply": {"prompt": "STRING"}}


def valid_arguments(name: F.Column, arguments: F.Column, schemas: Schemas) -> F.Column:
    """Whether JSON arguments are an object with all required and no unknown keys, each of its type; an unknown tool: false."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.lit(False)
    for tool, fields in schemas.items():
        known = F.array(*[F.lit(k) for k in fields]) if fields else F.array().cast("array<string>")
        ok = parsed.isNotNull() & keys.isNotNull() & (F.size(F.array_except(keys, known)) == 0)
        for k, kind in fields.items():
            got = F.schema_of_variant(F.try_variant_get(parsed, f"$['{k}']", "variant"))
            fits = got == kind.rstrip("?")
            ok = ok & (F.coalesce(fits, F.lit(False)) | F.lit(kind.endswith("?")) & ~F.coalesce(F.array_contains(keys, k), F.lit(False)))
        out = F.when(name == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def depths(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, depth) of each distinct non-null id.  nodes: id, after (the id it must follow, or null or unknown: none).

    An id on several rows follows the smallest of its `after`.  Depth is null on a cycle and beyond one.
    """
    first = nodes.where("id is not null").groupBy("id").agg(F.min("after").alias("after"))
    known = first.select(F.col("id").alias("after"))
    state = scratch(first.join(known, "after", "left_semi").select("id", "after", F.lit(1).cast("bigint").alias("depth")).unionByName(first.join(known, "after", "left_anti").select("id", F.lit(None).cast("string").alias("after"), F.lit(0).cast("bigint").alias("depth"))), "depths")
    open_rows = state.where("after is not null").count()
    for _ in range(max_rounds):
        if not open_rows:
            break
        up = state.select(F.col("id").alias("after"), F.col("after").alias("next"), F.col("depth").alias("more"))
        # rows that have arrived need no join; the others take over what the message they point to knows
        after = scratch(state.where("after is null").unionByName(state.where("after is not null").join(up, "after").select("id", F.col("next").alias("after"), (F.col("depth") + F.col("more")).alias("depth"))), "depths")
        left = after.where("after is not null").count()
        drop_scratch(state)
        state, stuck = after, left == open_rows
        open_rows = left
        if stuck and _ > 1:
            break  # doubling frees someone in each round unless only cycles are left
    return state.select("id", F.when(F.col("after").isNull(), F.col("depth")).alias("depth"))


def link_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """messages with depth, status, valid and line.

    messages has conv, turn, role, text, and for tool traffic: call_id and tool and arguments (a call), result_of (a
    result), after (the id it must follow), id.  status: call with a result `linked`, without `unanswered`; result with a
    call `linked`, without `orphan`; else `plain`.  valid is null but for calls.  Rows with null ids stay, as plain
    or orphan; repeated rows stay, and several results of a call are all linked; a null text is written as empty; texts
    of any length are written whole; an empty table gives an empty result.  Columns with the name of an added one are replaced.
    Identifiers that many rows share, and the nulls of rows that are not calls or results, are dealt over many tasks.
    """
    messages = messages.drop("depth", "status", "valid", "line", "has_call", "has_result", "_spread", "_salt")
    ids = depths(messages.select("id", "after"))
    calls = messages.where("call_id is not null").select(F.col("call_id").alias("result_of")).distinct().withColumn("has_call", F.lit(True))
    results = messages.where("result_of is not null").select(F.col("result_of").alias("call_id")).distinct().withColumn("has_result", F.lit(True))
    linked = spread(messages, "_spread")
    for key, table in (("id", ids), ("result_of", calls), ("call_id", results)):
        linked = lookup(linked, key, table, hot_values(messages, key), "_spread")
    status = (
        F.when(F.col("call_id").isNotNull(), F.when(F.col("has_result"), "linked").otherwise("unanswered"))
        .when(F.col("result_of").isNotNull(), F.when(F.col("has_call"), "linked").otherwise("orphan"))
        .otherwise("plain")
    )
    valid = F.when(F.col("call_id").isNotNull(), valid_arguments(F.col("tool"), F.col("arguments"), schemas))
    call = F.when(F.col("call_id").isNotNull(), F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"))))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)
    line = F.concat(
        F.lit("{"),
        F.when(call.isNull(), F.concat(F.lit('"content":'), quoted(F.col("text")), F.lit(","))).otherwise(""),
        F.lit('"role":'), quoted(F.col("role")),
        F.when(call.isNotNull(), F.concat(F.lit(',"tool_call":'), call)).otherwise(""),
        F.when(F.col("result_of").isNotNull(), F.concat(F.lit(',"tool_call_id":'), quoted(F.col("result_of")))).otherwise(""),
        F.lit("}"),
    )
    return linked.withColumn("status", status).withColumn("valid", valid).withColumn("line", line).select(*messages.columns, "depth", "status", "valid", "line")


def in_order(linked: DataFrame) -> DataFrame:
    """(conv, position, line) of every row of link_calls, in topological order within conversations: by depth (cycles
    last), turn and line.

    Rows are dealt by ranges of that order, so one huge conversation is spread over tasks too; position increases along
    the order and may skip numbers.
    """
    order = [F.col("conv").asc_nulls_last(), F.col("depth").asc_nulls_last(), F.col("turn").asc_nulls_last(), "line"]
    return linked.select("conv", "depth", "turn", "line").repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.monotonically_increasing_id().alias("position"), "line")


def placed(linked: DataFrame) -> DataFrame:
    """linked with position, from 0 within its conversation and without gaps, in topological order: by depth (a row without an
    id waits for nothing; rows on cycles come last), turn and line.  Equal rows take neighbouring positions; a null
    conversation is one.  Positions come from ranges of that order, so one huge conversation is spread over tasks too."""
    at = F.when(F.col("id").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("depth"))
    order = [F.col("_depth").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("line")]
    return ranked(linked.drop("position").withColumn("_depth", at), order, "position", ["conv"]).drop("_depth")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Plain turns as tool traffic: a user's turn calls `reply` with its text, the assistant's next turn is the result.

    Identifiers are conversation:turn; each of these turns must follow the other side's turn just before it.
    """
    turn = lambda k: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + k).cast("string"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    user, assistant = placed & (F.col("role") == "user"), placed & (F.col("role") == "assistant")
    side = lambda r, k: F.concat(F.lit(r), turn(k))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(user, side("u", 0)).when(assistant, side("a", 0)).alias("id"),
        F.when(user, side("a", -1)).when(assistant, side("u", -1)).alias("after"),
        F.when(user, turn(0)).alias("call_id"), F.when(user, F.lit("reply")).alias("tool"),
        F.when(user, F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt")))).alias("arguments"),
        F.when(assistant, turn(-1)).alias("result_of"),
    )


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """Every turn as a line of canonical JSON, linked and placed; nulls, empty and long texts, repeats and empty tables as in
    link_calls.  The conversations hold no tool calls of their own; see from_turns."""
    found = link_calls(from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), REPLY)
    found = placed(found.withColumnRenamed("conv_id", "conv"))
    return found.select(F.col("conv").alias("conv_id"), "turn", "role", F.coalesce("call_id", "result_of").alias("call_id"), "status", "valid", "depth", "position", "line")


ORACLE_SQL = {
    "op9_chat": """
WITH c AS (SELECT *, row_number() OVER () AS r FROM conversations),
p AS (SELECT c.*, EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 1 AND
    ((c.role = 'user' AND b.role = 'assistant') OR (c.role = 'assistant' AND b.role = 'user'))) AS tied,
  EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn = c.turn + 1 AND b.role = 'assistant') AS answered,
  EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 1 AND b.role = 'user') AS called FROM c),
g AS (SELECT *, sum(CASE WHEN tied THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM p),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1 AS depth FROM g),
i AS (SELECT *, CASE role WHEN 'user' THEN concat_ws(':', conv_id, turn) WHEN 'assistant' THEN concat_ws(':', conv_id, turn - 1) END AS call_id FROM d)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN call_id IS NULL THEN 0 ELSE depth END NULLS LAST, turn NULLS LAST, line) - 1 AS position FROM (
SELECT conv_id, turn, role, call_id,
  CASE role WHEN 'user' THEN CASE WHEN answered THEN 'linked' ELSE 'unanswered' END
    WHEN 'assistant' THEN CASE WHEN called THEN 'linked' ELSE 'orphan' END ELSE 'plain' END AS status,
  CASE role WHEN 'user' THEN true END AS valid,
  CASE WHEN role IN ('user', 'assistant') THEN depth END AS depth,
  CASE role WHEN 'user' THEN '{"role":"user","tool_call":{"arguments":{"prompt":' || to_json(text) || '},"id":"' || call_id || '","name":"reply"}}'
    WHEN 'assistant' THEN '{"content":' || to_json(text) || ',"role":"assistant","tool_call_id":"' || call_id || '"}'
    ELSE '{"content":' || to_json(text) || ',"role":"' || role || '"}' END AS line
FROM i)
""",
}

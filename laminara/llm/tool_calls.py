"""Tool calls in conversations: linked to their results, put in order, validated and serialised as canonical JSON.

Everything is DataFrame and SQL functions. Calls and results are hash-joined by conversation and identifier. A call
may name calls it depends on; calls whose dependencies all stand earlier in the conversation are in order by their
place, and only conversations with a forward reference are sorted: by pointers of doubling length where calls have one
dependency each, else in rounds.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminara.llm.common import Stored, read_table

#: Types of JSON schema, as patterns of the types that schema_of_variant gives.
TYPES = {
    "string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\\\(\\\\d+,0\\\\))$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "boolean": "^BOOLEAN$", "array": "^ARRAY<.*", "object": "^OBJECT<.*", "null": "^VOID$",
}


def canonical_json(text: Column) -> Column:
    """The same JSON with sorted keys and no white space; null if it isn't JSON. Of repeated keys the result is null."""
    return F.to_json(F.try_parse_json(text))


def quoted(text: Column) -> Column:
    """A JSON string of the text; null stays null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), listed.substr(F.lit(2), F.length(listed) - 2))


def problems(schemas: dict[str, dict]) -> Column:
    """An array of what is wrong with ``arguments`` (a JSON string) under the schema of ``name``, sorted.

    The schemas are a bounded dictionary of tool name to JSON schema with properties (type, enum), required and
    additionalProperties.
    """
    out = F.array(F.lit("unknown tool"))
    v = F.try_parse_json("arguments")
    kind = F.schema_of_variant(v)
    for tool, schema in sorted(schemas.items()):
        found = []
        props = schema.get("properties", {})
        for key, want in sorted(props.items()):
            path = "$." + key
            got = F.try_variant_get(v, path, "variant")
            here = F.array_contains(F.json_object_keys("arguments"), key)
            if key in schema.get("required", []):
                found.append(F.when(~here, F.lit(f"missing {key}")))
            if "type" in want:
                found.append(F.when(here & ~F.schema_of_variant(got).rlike(TYPES[want["type"]].replace("\\\\", "\\")), F.lit(f"{key} is not {want['type']}")))
            if "enum" in want:
                allowed = F.array(*(F.lit(json.dumps(x, ensure_ascii=False)) for x in want["enum"]))
                found.append(F.when(here & ~F.array_contains(allowed, F.to_json(got)), F.lit(f"{key} is not allowed")))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.json_object_keys("arguments"), F.array(*map(F.lit, props)) if props else F.array().cast("array<string>"))
            found.append(F.when(F.size(extra) > 0, F.concat(F.lit("unexpected "), F.array_join(F.array_sort(extra), ","))))
        checked = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
        checked = F.when(v.isNull(), F.array(F.lit("not JSON"))).when(~kind.startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(checked)
        out = F.when(F.col("name") == tool, checked).otherwise(out)
    return out


def jumped_levels(nodes: DataFrame, odd: DataFrame) -> DataFrame:
    """Levels where every call has one known dependency at most, by pointers of doubling length.

    A call that has not reached the end of its chain once pointers are longer than the conversation is on or behind a
    cycle.
    """
    at = Stored(nodes.join(odd, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "dep", F.when(F.col("dep").isNull(), 0).otherwise(1).cast("long").alias("level")))
    longest = at.df.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, longest).bit_length()):
        if at.df.where("dep is not null").isEmpty():
            break
        further = at.df.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("level").alias("more"))
        step = Stored(at.df.join(further, ["conv_id", "dep"], "left").select("conv_id", "call_id", F.col("next").alias("dep"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        at.drop()
        at = step
    return at.df.select("conv_id", "call_id", F.when(F.col("dep").isNull(), F.col("level")).cast("int").alias("level"))


def settled_levels(nodes: DataFrame, odd: DataFrame) -> DataFrame:
    """Levels in rounds: a call settles once all its dependencies have. Rounds follow the longest chain and go on until
    nothing settles any more; what is left then is on or behind a cycle."""
    settled = Stored(nodes.join(odd, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    while True:
        done = settled.df
        ready = (
            odd.join(done.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left")
            .groupBy("conv_id", "call_id")
            .agg(F.max("level").alias("top"), F.count_if(F.col("level").isNull()).alias("open"))
            .where("open = 0")
            .select("conv_id", "call_id", (F.col("top") + 1).alias("level"))
        )
        step = Stored(ready.join(done, ["conv_id", "call_id"], "left_anti"))
        if step.df.isEmpty():
            return nodes.join(settled.df, ["conv_id", "call_id"], "left")
        settled = Stored(done.unionByName(step.df))


def order_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): sorting a conversation's calls by (level, turn, pos) puts dependencies first.

    ``calls`` has conv_id, call_id (different within a conversation), turn, pos and deps (array of call ids; those that
    name no call of the conversation don't count). The level is 0 throughout where every dependency stands earlier,
    and else the length of the longest chain below; null for calls on or behind a cycle.
    """
    place = F.struct("turn", "pos")
    edges = calls.select("conv_id", "call_id", place.alias("at"), F.explode("deps").alias("dep"))
    known = calls.select("conv_id", F.col("call_id").alias("dep"), place.alias("dep_at"))
    edges = Stored(edges.join(known, ["conv_id", "dep"]).distinct())
    forward = edges.df.where("dep_at >= at").select("conv_id").distinct()
    if forward.isEmpty():
        edges.drop()
        return calls.select("conv_id", "call_id", F.lit(0).alias("level"))
    forward = Stored(forward)
    odd = Stored(edges.df.join(forward.df, "conv_id", "left_semi").select("conv_id", "call_id", "dep"))
    edges.drop()
    nodes = calls.select("conv_id", "call_id").join(forward.df, "conv_id", "left_semi")
    several = Stored(odd.df.groupBy("conv_id", "call_id").count().where("count > 1").select("conv_id").distinct())
    one = jumped_levels(nodes.join(several.df, "conv_id", "left_anti"), odd.df.join(several.df, "conv_id", "left_anti"))
    out = calls.select("conv_id", "call_id").join(forward.df, "conv_id", "left_anti").select("conv_id", "call_id", F.lit(0).alias("level")).unionByName(one)
    if several.df.isEmpty():
        return out
    return out.unionByName(settled_levels(nodes.join(several.df, "conv_id", "left_semi"), odd.df.join(several.df, "conv_id", "left_semi")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call, and for each result without a call.

    calls: conv_id, turn, pos, call_id, name, arguments (JSON), deps (array of call ids). results: conv_id, turn,
    call_id, content. Returns conv_id, turn, pos, call_id, status, n_results, level, problems and json.

    status: "linked"; "unanswered" (no result, or only ones that stand before the call); "repeated" (a call whose id
    an earlier call of the conversation has; it gets no result); "orphan" (results without a call, one row for each
    id). Of several results the earliest counts, ties to the smaller content. Rows with a null conv_id or call_id take
    no part; null deps count as none. json has sorted keys and no white space; arguments that aren't JSON stand in it
    as a string.
    """
    calls = calls.where("conv_id is not null and call_id is not null").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    results = results.where("conv_id is not null and call_id is not null")
    firsts = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "pos", "name", "arguments", "deps")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    linked = firsts.join(answers, ["conv_id", "call_id"], "full")
    unique = firsts.select("conv_id", "call_id", "c.turn", "c.pos", "c.deps")
    levels = order_levels(unique)
    good = F.col("r.turn") >= F.col("c.turn")
    main = linked.select(
        "conv_id", F.coalesce("c.turn", "r.turn").alias("turn"), F.col("c.pos").alias("pos"), "call_id",
        F.when(F.col("c").isNull(), "orphan").when(F.coalesce(good, F.lit(False)), "linked").otherwise("unanswered").alias("status"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"),
        F.when(F.col("c").isNull() | good, F.col("r.content")).alias("content"),
    ).join(levels, ["conv_id", "call_id"], "left")
    again = (
        calls.join(firsts.where("n_calls > 1").select("conv_id", "call_id", F.col("c.turn").alias("t"), F.col("c.pos").alias("p")), ["conv_id", "call_id"])
        .where("not (turn <=> t and pos <=> p)")
        .select("conv_id", "turn", "pos", "call_id", F.lit("repeated").alias("status"), F.lit(0).cast("long").alias("n_results"), "name", "arguments", F.lit(None).cast("string").alias("content"), F.lit(None).cast("int").alias("level"))
    )
    every = main.unionByName(again)
    every = every.withColumn("problems", F.when(F.col("status") == "orphan", F.array().cast("array<string>")).otherwise(problems(schemas)))
    q = lambda c: F.coalesce(canonical_json(c), quoted(c), F.lit("null"))
    parts = F.concat(
        F.lit('{"arguments":'), q(F.col("arguments")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.coalesce(quoted(F.col("content")), F.lit("null")), F.lit(',"status":"'), F.col("status"), F.lit('"}'),
    )
    return every.select("conv_id", "turn", "pos", "call_id", "status", "n_results", "level", "problems", parts.alias("json"))


#: The schema of the one tool that op7 knows.
ASK = {"ask": {"properties": {"after": {"type": "array"}, "prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False}}


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as calls and results, and the turns of other roles as they are.

    A user turn calls the tool "ask" ("look" where its length is a multiple of 7) and an assistant turn is the result of
    the call of the turn before. In conversations whose number is a multiple of 3 a call depends on the one of two
    turns later, in others on the one of two turns before. Where the turn leaves 3 modulo 5 its number is given as a
    string, and where the length of the text is a multiple of 11 the prompt is left out. Rows of one turn and role are
    told apart by ``pos``, in order of their texts, nulls first.
    """
    turn = F.col("turn").cast("long")
    name = lambda by: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), (turn + by).cast("string"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    pos = F.row_number().over(Window.partitionBy("conv_id", "turn", "role").orderBy("text")) - 1
    users = rows.where("role = 'user'").withColumn("pos", pos)
    size = F.length("text")
    deps = F.when(F.col("conv_id") % 3 == 0, F.array(name(2))).when(turn >= 2, F.array(name(-2))).otherwise(F.array().cast("array<string>"))
    prompt = F.when(size % 11 != 0, F.col("text")).alias("prompt")
    spelt = F.when(turn % 5 == 3, F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), prompt, deps.alias("after")))).otherwise(F.to_json(F.struct("turn", prompt, deps.alias("after"))))
    tool = F.when(size % 7 == 0, F.lit("look")).otherwise(F.lit("ask"))
    calls = users.select("conv_id", "turn", "pos", name(0).alias("call_id"), tool.alias("name"), spelt.alias("arguments"), deps.alias("deps"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", name(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results, rows.where("role is null or role not in ('user', 'assistant')")


def context_rows(others: DataFrame) -> DataFrame:
    """Turns that are neither calls nor results, as rows of ``link_calls`` with the status "context"."""
    spelt = F.concat(F.lit('{"content":'), F.coalesce(quoted(F.col("text")), F.lit("null")), F.lit(',"role":'), F.coalesce(quoted(F.col("role")), F.lit("null")), F.lit(',"status":"context"}'))
    return others.select("conv_id", "turn", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("call_id"), F.lit("context").alias("status"), F.lit(0).cast("long").alias("n_results"), F.lit(None).cast("int").alias("level"), F.array().cast("array<string>").alias("problems"), spelt.alias("json"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call, linked with the assistant turn that answers it, and every other turn."""
    calls, results, others = as_calls(read_table(spark, sf_dir, "conversations"))
    out = link_calls(calls, results, ASK).unionByName(context_rows(others))
    return out.select("conv_id", "turn", "pos", "call_id", "status", "n_results", "level", F.array_join(F.array_sort("problems"), "; ").alias("problems"), "json")


OP7_SQL = """
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text,
         CAST(row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text NULLS FIRST) - 1 AS INTEGER) AS pos
  FROM conversations
), calls AS (
  SELECT *, 'call-' || conv_id || '-' || turn AS call_id,
         CASE WHEN length(text) % 7 = 0 THEN 'look' ELSE 'ask' END AS name,
         CASE WHEN length(text) % 11 <> 0 THEN text END AS prompt,
         CASE WHEN conv_id % 3 = 0 THEN 'call-' || conv_id || '-' || (turn + 2)
              WHEN turn >= 2 THEN 'call-' || conv_id || '-' || (turn - 2) END AS dep
  FROM turns WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), chains AS (
  SELECT conv_id, turn,
         CASE WHEN conv_id % 3 = 0 THEN (max(turn) OVER (PARTITION BY conv_id, turn % 2, island) - turn) // 2 ELSE 0 END AS level
  FROM (SELECT conv_id, turn, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
        FROM calls WHERE pos = 0)
), spelt AS (
  SELECT c.*, CASE WHEN pos = 0 THEN h.level END AS level,
         CASE WHEN name = 'look' THEN 'unknown tool' ELSE
           concat_ws('; ', CASE WHEN prompt IS NULL THEN 'missing prompt' END,
                     CASE WHEN c.turn % 5 = 3 THEN 'turn is not integer' END) END AS problems,
         '{"after":[' || COALESCE(CAST(to_json(dep) AS VARCHAR), '') || ']'
         || COALESCE(',"prompt":' || CAST(to_json(prompt) AS VARCHAR), '')
         || ',"turn":' || CASE WHEN c.turn % 5 = 3 THEN '"' || c.turn || '"' ELSE CAST(c.turn AS VARCHAR) END || '}' AS arguments
  FROM calls c LEFT JOIN chains h ON c.conv_id = h.conv_id AND c.turn = h.turn
), results AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text AS content, pos,
         count(*) OVER (PARTITION BY conv_id, turn) AS n_results
  FROM turns WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), j AS (
  SELECT COALESCE(c.conv_id, r.conv_id) AS conv_id, COALESCE(c.turn, r.turn) AS turn, c.pos,
         COALESCE(c.call_id, r.call_id) AS call_id,
         CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
         COALESCE(r.n_results, 0) AS n_results, c.level, COALESCE(c.problems, '') AS problems, c.name, c.arguments, r.content
  FROM (SELECT * FROM spelt WHERE pos = 0) c
  FULL JOIN (SELECT * FROM results WHERE pos = 0) r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
  UNION ALL
  SELECT conv_id, turn, pos, call_id, 'repeated', 0, NULL, problems, name, arguments, NULL FROM spelt WHERE pos > 0
)
SELECT conv_id, turn, pos, call_id, status, CAST(n_results AS BIGINT) AS n_results, CAST(level AS INTEGER) AS level, problems,
       '{"arguments":' || COALESCE(arguments, 'null') || ',"id":' || CAST(to_json(call_id) AS VARCHAR)
       || ',"name":' || COALESCE(CAST(to_json(name) AS VARCHAR), 'null')
       || ',"result":' || COALESCE(CAST(to_json(content) AS VARCHAR), 'null')
       || ',"status":"' || status || '"}' AS json
FROM j
UNION ALL
SELECT conv_id, turn, NULL, NULL, 'context', 0, NULL, '',
       '{"content":' || COALESCE(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || COALESCE(CAST(to_json(role) AS VARCHAR), 'null')
       || ',"status":"context"}'
FROM turns WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

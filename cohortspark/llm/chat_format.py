"""Chat formatting with tool-call linking, in DataFrame functions only.

An assistant message may be a JSON object with ``tool_calls`` (objects of id,
name and arguments) and a tool message one with ``tool_call_id`` and
``content``.  Calls and results are joined by (conversation, identifier);
results come after their call and calls after the results that their arguments
refer to as ``{"$ref": id}``; arguments are validated against the tools'
schemas; and every message is written as canonical JSON: keys sorted, no white
space.  The order is a sort key a row, (order_turn, order_level, turn), so no
conversation has to meet in one task, however long.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

ROUNDS = 50  # after so many rounds what they settled is written as one table; no limit
BROADCAST_ROWS = 100_000

# JSON schema types and how the engine names the types of values.
VALUE_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def tool_schemas(spark: SparkSession, tools: dict[str, dict]) -> DataFrame:
    """(name, parameter, type, required) of tools given as JSON schemas of their arguments; a tool without parameters has a null one."""
    rows = []
    for name, schema in sorted(tools.items()):
        needed = set(schema.get("required", []))
        for parameter, spec in sorted(schema.get("properties", {}).items()) or [(None, {})]:
            rows.append((name, parameter, spec.get("type"), parameter in needed))
    return spark.createDataFrame(rows, "name string, parameter string, type string, required boolean")


def _parsed(conversations: DataFrame) -> DataFrame:
    """The messages with ``payload``, ``conv`` (a key of the conversation) and ``row`` (a key of the message's values); neither key is null."""
    text = F.col("text").cast("string")
    json = F.when(F.col("role").isin("assistant", "tool") & F.ltrim(text).startswith("{"), text)
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    row = F.when(json.isNotNull(), F.unhex(F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text")))))
    return conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), text.alias("text"), F.try_parse_json(json).alias("payload"), conv.alias("conv"), row.alias("row"))


def _calls(parsed: DataFrame) -> DataFrame:
    """(conv, turn, row, index, id, name, arguments, refs): one row a call; messages that repeat count once."""
    spec = "array<struct<id string, name string, arguments variant>>"
    listed = parsed.where("role = 'assistant' and payload is not null").select("conv", "turn", "row", F.posexplode(F.try_variant_get("payload", "$.tool_calls", spec)).alias("index", "call"))
    refs = F.array_distinct(F.regexp_extract_all(F.to_json("call.arguments"), F.lit(r'\{"\$ref":"([^"\\]*)"\}'), F.lit(1)))
    return listed.select("conv", "turn", "row", "index", "call.id", "call.name", "call.arguments", refs.alias("refs")).where("id is not null").dropDuplicates(["row", "index"])


def _results(parsed: DataFrame) -> DataFrame:
    """(conv, turn, row, id): one row a result; messages that repeat count once."""
    return parsed.where("role = 'tool' and payload is not null").select("conv", "turn", "row", F.try_variant_get("payload", "$.tool_call_id", "string").alias("id")).where("id is not null").dropDuplicates(["row"])


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``problem`` added: null if the arguments fit the tool's schema.

    A schema table that repeats a row counts it once.  A call is invalid if its tool is unknown, its arguments are no object, a
    required one is missing, one is not in the schema, or one has another type.
    """
    tools = schemas.where("name is not null").groupBy("name").agg(F.collect_set(F.struct("parameter", "type", "required")).alias("parameters"))
    tools = F.broadcast(tools) if schemas.count() <= BROADCAST_ROWS else tools
    is_object = F.schema_of_variant("arguments").startswith("OBJECT")
    given = F.when(is_object, F.try_variant_get("arguments", "$", "map<string, variant>"))
    typed = F.transform_values(given, lambda _, v: F.schema_of_variant(v))
    expected = F.create_map(*[x for k, v in VALUE_TYPES.items() for x in (F.lit(k), F.lit(v))])
    joined = calls.join(tools, "name", "left").withColumn("types", typed)
    known = F.transform("parameters", lambda p: p["parameter"])
    missing = F.exists("parameters", lambda p: p["required"] & ~F.coalesce(F.map_contains_key("types", p["parameter"]), F.lit(False)))
    wrong = F.exists("parameters", lambda p: F.coalesce(~F.regexp_like(F.get(F.array(F.element_at("types", F.coalesce(p["parameter"], F.lit("")))), F.lit(0)), F.concat(F.lit("^"), F.element_at(expected, F.coalesce(p["type"], F.lit(""))), F.lit("$"))), F.lit(False)))
    extra = F.size(F.array_except(F.map_keys("types"), known)) > 0
    problem = F.when(F.col("parameters").isNull(), "unknown tool").when(~F.coalesce(is_object, F.lit(False)), "arguments are no object").when(missing, "a required argument is missing").when(extra, "an argument is not in the schema").when(wrong, "an argument has another type")
    return joined.select(*calls.columns, problem.alias("problem"))


def inferred_schemas(calls: DataFrame) -> DataFrame:
    """(name, parameter, type, required) of the tools that ``calls`` (name, arguments) use, as most of their calls have it.

    A parameter has the type of most values that calls give it, number where some are no integers, and any type where a call
    refers to a result; nine of ten calls give one that is required.  Of ten calls and more, a single one adds no parameter.
    """
    is_object = F.schema_of_variant("arguments").startswith("OBJECT")
    named = calls.where("name is not null").select("name", F.when(is_object, F.try_variant_get("arguments", "$", "map<string, variant>")).alias("given"))
    tools = named.groupBy("name").agg(F.count("given").alias("calls"))
    kind, refers = F.schema_of_variant("value"), F.to_json("value").startswith('{"$ref":')
    told = F.lit(None).cast("string")
    for name, pattern in VALUE_TYPES.items():
        told = F.coalesce(told, F.when(F.regexp_like(kind, F.lit(f"^{pattern}$")), "number" if name == "integer" else name))
    values = named.select("name", F.explode("given").alias("parameter", "value")).select("name", "parameter", told.alias("type"), (kind == "BIGINT").alias("whole"), refers.alias("refers"))
    counted = values.groupBy("name", "parameter", "type").agg(F.count("*").alias("n"), F.every("whole").alias("whole"), F.some("refers").alias("refers"))
    most = F.max_by(F.struct("type", "whole"), F.struct("n", "type"))
    chosen = counted.groupBy("name", "parameter").agg(most.alias("m"), F.sum("n").alias("n"), F.some("refers").alias("refers"))
    kind = F.when(~F.col("refers"), F.when(F.col("m.whole"), "integer").otherwise(F.col("m.type")))
    known = tools.join(chosen, "name").where("n > 1 or calls < 10").select("name", "parameter", kind.alias("type"), (F.col("n") * 10 >= F.col("calls") * 9).alias("required"))
    bare = tools.join(known, "name", "left_anti").select("name", F.lit(None).cast("string").alias("parameter"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("required"))
    return known.unionByName(bare)


def _ordered(calls: DataFrame, results: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, order_turn, order_level) of messages that have to wait; a null level marks a cycle.

    Messages are settled once all that they wait for are, one level of the
    graph a round, however deep it is.  What no round settles is in or behind a
    cycle; its order_turn is the latest turn that it waits for.
    """
    place = F.struct(F.col("turn"), F.col("row"))
    first = calls.groupBy("conv", "id").agg(F.min(place).alias("m")).select("conv", "id", F.col("m.row").alias("after"), F.col("m.turn").alias("after_turn"))
    waits = results.join(first, ["conv", "id"]).select("row", "turn", "after", "after_turn")
    answers = results.groupBy("conv", "id").agg(F.min(place).alias("m")).select("conv", "id", F.col("m.row").alias("after"), F.col("m.turn").alias("after_turn"))
    refers = calls.select("conv", "row", "turn", F.explode("refs").alias("id")).join(answers, ["conv", "id"]).select("row", "turn", "after", "after_turn")
    found = scratch.save(waits.unionByName(refers).where("turn is not null and after_turn is not null").distinct())
    edges = found.select("row", "after")
    turn = found.schema["turn"].dataType.simpleString()
    counted = found.groupBy("row", "turn").agg(F.count("*").alias("open"))
    sources = found.select(F.col("after").alias("row"), F.col("after_turn").alias("turn")).distinct().join(counted, "row", "left_anti").withColumn("open", F.lit(0).cast("long"))
    state = scratch.save(counted.unionByName(sources).withColumn("m", F.lit(None).cast(f"struct<t: {turn}, l: bigint>")))  # m: the latest place waited for
    late = F.coalesce(F.col("m.t") >= F.col("turn"), F.lit(False))
    own_turn, level = F.when(late, F.col("m.t")).otherwise(F.col("turn")), F.when(late, F.col("m.l") + 1).otherwise(0).cast("long")
    ready = lambda df: df.where("open = 0").select("row", own_turn.alias("order_turn"), level.alias("order_level"))
    settled = ready(state)
    kept, recent, states = [], [settled], [state]
    while not settled.isEmpty():
        passed = settled.select(F.col("row").alias("after"), F.struct(F.col("order_turn").alias("t"), F.col("order_level").alias("l")).alias("p"))
        pushed = edges.join(passed, "after").groupBy("row").agg(F.count("*").alias("n"), F.max("p").alias("p"))
        state = scratch.save(state.where("open > 0").join(pushed, "row", "left").select("row", "turn", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("m", "p").alias("m")))
        settled = ready(state)
        recent.append(settled)
        states.append(state)
        if len(recent) >= ROUNDS:
            kept.append(scratch.save(functools.reduce(DataFrame.unionByName, recent)))
            scratch.drop(*states[:-1])
            recent, states = [], states[-1:]
    order = functools.reduce(DataFrame.unionByName, kept + recent)
    stuck = scratch.save(state.where("open > 0").select("row", F.greatest("turn", "m.t").alias("order_turn")))
    moved = not stuck.isEmpty()
    cyclic = stuck
    while moved:
        passed = cyclic.select(F.col("row").alias("after"), F.col("order_turn").alias("t"))
        pushed = edges.join(passed, "after").groupBy("row").agg(F.max("t").alias("t"))
        after = scratch.save(cyclic.join(pushed, "row", "left").select("row", F.greatest("order_turn", "t").alias("order_turn"), (F.col("t") > F.col("order_turn")).alias("up")))
        moved, cyclic = not after.where("up").isEmpty(), after.drop("up")
    return order.unionByName(cyclic.withColumn("order_level", F.lit(None).cast("long")))


def format_chats(conversations: DataFrame, schemas: DataFrame | None) -> DataFrame:
    """Per message: conv_id, turn, role, order_turn, order_level, n_calls, n_linked, n_invalid and message (canonical JSON).

    Sorting a conversation by order_turn, order_level and turn puts every
    result after its call and every call after the results it refers to;
    messages that no other waits for keep their turn and level 0, and messages
    in or behind a cycle of references have a null level.  Of calls that share
    an identifier, results belong to the earliest.  n_linked counts a
    message's calls with a result, or is 1 for a result with a call.  Without
    ``schemas`` (None) arguments are not validated: n_invalid is 0 and calls
    carry no ``valid``; with an empty table every tool is unknown.  Text
    that is no JSON object, a JSON object without the keys named, null and
    empty text are plain content, of any length.  Null roles are kept; a row
    that repeats is one message, and each copy of the row is returned with it.
    Messages with a null conv_id belong to one conversation; those with a null
    turn are linked but wait for nothing.  Messages of equal turn come in the
    order they wait for each other.  An empty table gives no rows; other
    columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    parsed = _parsed(conversations.select("conv_id", "turn", "role", "text"))
    calls, results = scratch.save(_calls(parsed)), scratch.save(_results(parsed))
    answered = results.select("conv", "id").distinct().withColumn("answered", F.lit(1))
    linked = calls.join(answered, ["conv", "id"], "left")
    checked = linked.withColumns({"problem": F.lit(None).cast("string"), "valid": F.lit(None).cast("boolean")}) if schemas is None else validated(linked, schemas).withColumn("valid", F.col("problem").isNull())
    written = F.array_sort(F.collect_list(F.struct("index", F.to_json(F.struct("arguments", "id", "name", "valid")).alias("json"))))
    grouped = checked.groupBy("row").agg(F.transform(written, lambda x: x["json"]).alias("calls"), F.count("*").alias("n_calls"), F.count("answered").alias("n_answered"), F.count("problem").alias("n_invalid"))
    asked = calls.select("conv", "id").distinct().withColumn("asked", F.lit(1))
    replied = results.join(asked, ["conv", "id"], "left").select("row", "id", "asked")
    order = _ordered(calls, results, scratch)
    out = parsed.join(grouped, "row", "left").join(replied, "row", "left").join(order, "row", "left")
    is_call, is_result = (F.col("role") == "assistant") & F.col("calls").isNotNull() & F.col("payload").isNotNull(), (F.col("role") == "tool") & F.col("id").isNotNull() & F.col("payload").isNotNull()
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    content = F.coalesce(F.to_json(F.try_variant_get("payload", "$.content", "variant")), F.lit("null"))
    call_json = F.concat(F.lit('{"content":'), content, F.lit(',"role":"assistant","tool_calls":['), F.array_join("calls", ","), F.lit("]}"))
    result_json = F.concat(F.lit('{"content":'), content, F.lit(',"linked":'), F.when(F.col("asked") == 1, "true").otherwise("false"), F.lit(',"role":"tool","tool_call_id":'), F.regexp_extract(F.to_json(F.struct(F.col("id").alias("x"))), r"^\{\"x\":(.*)\}$", 1), F.lit("}"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("order_turn", "turn").alias("order_turn"),
        F.when(F.col("order_turn").isNull(), F.lit(0)).otherwise(F.col("order_level")).cast("int").alias("order_level"),
        number(F.when(is_call, F.col("n_calls"))).alias("n_calls"),
        number(F.when(is_call, F.col("n_answered")).when(is_result, F.col("asked"))).alias("n_linked"),
        number(F.when(is_call, F.col("n_invalid"))).alias("n_invalid"),
        F.when(is_call, call_json).when(is_result, result_json).otherwise(plain).alias("message"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data folder has no tool schemas: arguments are validated against those that the calls of the table show themselves."""
    conversations = table(spark, sf_dir, "conversations")
    calls = _calls(_parsed(conversations.select("conv_id", "turn", "role", "text")))
    return format_chats(conversations, Scratch(spark, "chat").save(inferred_schemas(calls)))


# Links calls and results by identifier; order and calls' canonical JSON are left to the tests, so rows that wait for others, or hold calls, don't match it.
ORACLE = """
WITH m AS (
  SELECT *, CASE WHEN role IN ('assistant', 'tool') AND starts_with(ltrim(text), '{') THEN try_cast(text AS JSON) END AS p FROM conversations
), calls AS (
  SELECT DISTINCT conv_id, turn, i, json_extract_string(p, '$.tool_calls[' || i || '].id') AS id
  FROM (SELECT conv_id, turn, p, unnest(range(CAST(json_array_length(p, '$.tool_calls') AS BIGINT))) AS i FROM m WHERE role = 'assistant' AND json_type(p, '$.tool_calls') = 'ARRAY')
), results AS (
  SELECT DISTINCT conv_id, turn, json_extract_string(p, '$.tool_call_id') AS id FROM m WHERE role = 'tool' AND p IS NOT NULL
), c AS (
  SELECT conv_id, turn, count(*) AS n_calls, count(*) FILTER (EXISTS (SELECT 1 FROM results r WHERE r.conv_id IS NOT DISTINCT FROM calls.conv_id AND r.id = calls.id)) AS n_linked FROM calls WHERE id IS NOT NULL GROUP BY ALL
), r AS (
  SELECT conv_id, turn, count(*) FILTER (EXISTS (SELECT 1 FROM calls c WHERE c.conv_id IS NOT DISTINCT FROM results.conv_id AND c.id = results.id)) AS n_linked FROM results WHERE id IS NOT NULL GROUP BY ALL
)
SELECT m.conv_id, m.turn, m.role, m.turn AS order_turn, CAST(0 AS INTEGER) AS order_level, CAST(coalesce(c.n_calls, 0) AS BIGINT) AS n_calls, CAST(coalesce(c.n_linked, r.n_linked, 0) AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid,
  CAST(to_json({'content': text, 'role': role}) AS VARCHAR) AS message
FROM m LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM m.conv_id AND c.turn IS NOT DISTINCT FROM m.turn LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.turn IS NOT DISTINCT FROM m.turn
"""

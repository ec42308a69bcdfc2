"""Operator 3: chat formatting with linked tool calls, in DataFrame functions only.

A message is a row (conv_id, turn, role, text). An assistant message calls tools if its text is
a JSON object with an array ``tool_calls`` of ``{"id", "name", "arguments"}`` (and perhaps a
``content``); a message of the role ``tool`` answers if its text is a JSON object with a
``tool_call_id`` and a ``content``. Calls meet answers in a hash join on conversation and id,
arguments are held against the parameters of the tool, calls are ordered behind the calls
whose results they use (a string argument ``"$id"``), and each part becomes one line of
canonical JSON: sorted keys, no white space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import written

#: The type names of JSON Schema and the variant types that fit each.
JSON_TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "null": r"^VOID$",
    "array": r"^ARRAY<.*$",
    "object": r"^OBJECT<.*$",
}
PARAMETERS = "tool string, param string, type string, required boolean"
#: Parameters of the tools that the registered query knows.
TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("calculator", "expression", "string", True),
    ("weather", "place", "string", True),
    ("weather", "days", "integer", False),
]
COLUMNS = ("conv_id", "turn", "part", "kind", "role", "call_id", "anchor_turn", "level", "status", "line")


def tool_parameters(spark: SparkSession, tools: list[tuple[str, str, str, bool]] | None = None) -> DataFrame:
    """The parameters of tools as rows: tool, param, type (a JSON Schema name), required."""
    return spark.createDataFrame(TOOLS if tools is None else tools, PARAMETERS)


def parsed(role: Column, text: Column) -> Column:
    """The text as a variant if it can be a tool message at all; else null."""
    return F.when(role.isin("assistant", "tool") & F.ltrim(text).startswith("{"), F.try_parse_json(text))


def tool_kind(v: Column) -> Column:
    """``call``, ``result`` or null of a parsed text."""
    calls = F.try_variant_get(v, "$.tool_calls", "array<variant>").isNotNull()
    answer = F.try_variant_get(v, "$.tool_call_id", "string").isNotNull()
    return F.when(F.col("role") == "assistant", F.when(calls, F.lit("call"))).when(F.col("role") == "tool", F.when(answer, F.lit("result")))


def line(**fields: Column) -> Column:
    """Canonical JSON of an object: keys sorted, nulls kept."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def argument_errors(args: Column, params: Column) -> Column:
    """What is wrong with arguments (a variant) under a tool's parameters (an array of structs), sorted."""
    given = F.try_variant_get(args, "$", "map<string,variant>")
    names = F.coalesce(F.map_keys(given), F.array().cast("array<string>"))
    known = F.transform(params, lambda p: p["param"])
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(names, p["param"])), lambda p: F.concat(F.lit("missing:"), p["param"]))
    extra = F.transform(F.array_except(names, known), lambda n: F.concat(F.lit("unknown:"), n))

    def fits(p: Column) -> Column:
        kind = F.schema_of_variant(F.element_at(given, p["param"]))
        return reduce(lambda a, b: a | b, [(p["type"] == name) & kind.rlike(pattern) for name, pattern in JSON_TYPES.items()])

    wrong = F.transform(F.filter(params, lambda p: F.array_contains(names, p["param"]) & ~F.coalesce(fits(p), F.lit(False))), lambda p: F.concat(F.lit("type:"), p["param"]))
    return F.when(params.isNull(), F.array(F.lit("unknown tool"))).when(given.isNull(), F.array(F.lit("no object"))).otherwise(F.array_sort(F.concat(missing, extra, wrong)))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that use results of others; level -1 where they use each other in a circle.

    A round settles the calls whose own uses are all settled; there are as many rounds as the
    longest chain has calls. The driver gets one count a round.
    """
    known = calls.select("conv_id", "call_id").distinct()  # of a repeated id all rows count as one call
    uses = calls.select("conv_id", "call_id", F.explode(F.array_distinct("uses")).alias("used")).distinct()
    edges = written(uses.join(known.withColumnRenamed("call_id", "used"), ["conv_id", "used"]), "uses")
    open_ = edges.select("conv_id", "call_id").distinct()
    found, level, done = open_.withColumn("level", F.lit(0)).limit(0), 0, None
    while (left := open_.count()) and left != done:
        level, done = level + 1, left
        blocked = edges.join(open_.withColumnRenamed("call_id", "used"), ["conv_id", "used"], "left_semi").select("conv_id", "call_id").distinct()
        still = written(open_.join(blocked, ["conv_id", "call_id"], "left_semi"), "open")
        settled = written(open_.join(still, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "settled")
        found, open_ = found.unionByName(settled), still
    return found.unionByName(open_.withColumn("level", F.lit(-1)))


def format_chat(messages: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row for each message, call and result: ``COLUMNS``; sorted by (conv_id, anchor_turn, kind <> 'message', level, part, kind, turn) they form the conversations.

    ``kind`` is message, call or result. ``part`` is the place of a call in its message (-1 for a
    message). ``anchor_turn`` puts a result behind its call. ``level`` is 0 for messages and for calls
    that use no other result, else one more than the highest level used, -1 in a circle. ``status``:
    messages ``ok``; calls ``ok``, ``unanswered`` or ``invalid`` with what is wrong; results ``ok``,
    ``repeated`` (the call has an earlier one), ``early`` (before its call) or ``orphan``. Of calls with one
    id in one conversation the first counts, later ones are ``repeated``.

    Text that only looks like JSON, or has a key twice, is an ordinary message. Null roles and
    texts stay null in the line; a null conv_id or turn is kept, but links nothing. Repeated rows give
    one row each; further columns are left out; an empty table gives an empty one. A conversation is
    never gathered: only calls and results move, by conversation and id.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    v = parsed(F.col("role"), F.col("text"))
    said = rows.withColumn("v", v).withColumn("tool_kind", tool_kind(F.col("v")))
    content = F.when(F.col("tool_kind") == "call", F.try_variant_get("v", "$.content", "string")).otherwise(F.col("text"))
    nothing, ok = F.lit(None).cast("string"), F.lit("ok")
    plain = said.where(~F.coalesce(F.col("tool_kind") == "result", F.lit(False))).select(
        "conv_id", "turn", F.lit(-1).alias("part"), F.lit("message").alias("kind"), "role", nothing.alias("call_id"), F.col("turn").alias("anchor_turn"), F.lit(0).alias("level"), ok.alias("status"), line(content=content, role=F.col("role")).alias("line")
    )
    moved = rows.where(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{")).withColumn("v", v).withColumn("tool_kind", tool_kind(F.col("v")))
    calls, results = linked(moved, parameters)
    return plain.unionByName(calls).unionByName(results)


def linked(tool_messages: DataFrame, parameters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of calls and of results of ``format_chat``."""
    each = tool_messages.where("tool_kind = 'call'").select("conv_id", "turn", "role", F.posexplode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("part", "c"))
    args = F.to_json(F.try_variant_get("c", "$.arguments", "variant"))
    calls = written(
        each.select("conv_id", "turn", "role", "part", F.try_variant_get("c", "$.id", "string").alias("call_id"), F.try_variant_get("c", "$.name", "string").alias("tool"), args.alias("args"), F.regexp_extract_all(F.coalesce(args, F.lit("")), F.lit(r'[:\[,]"\$([^"\\]+)"(?!:)'), 1).alias("uses")),
        "calls",
    )
    answers = written(
        tool_messages.where("tool_kind = 'result'").select("conv_id", "turn", "role", F.try_variant_get("v", "$.tool_call_id", "string").alias("call_id"), F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("answer")),
        "answers",
    )
    first = calls.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "part")).alias("first"))
    answered = answers.groupBy("conv_id", "call_id").agg(F.min("turn").alias("first_answer"), F.max("turn").alias("last_answer"))
    params = parameters.groupBy("tool").agg(F.sort_array(F.collect_list(F.struct("param", "type", "required"))).alias("params"))
    mine = F.struct("turn", "part") == F.col("first")
    checked = calls.join(first, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left").join(params, "tool", "left")
    depth = levels(calls)
    checked = checked.join(depth, ["conv_id", "call_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    wrong = argument_errors(F.try_parse_json("args"), F.col("params"))
    status = (
        F.when(F.col("call_id").isNull(), F.lit("invalid no id"))
        .when(F.coalesce(~mine, F.lit(False)), F.lit("repeated"))
        .when(F.size(wrong) > 0, F.concat(F.lit("invalid "), F.array_join(wrong, ",")))
        .when(F.coalesce(F.col("last_answer") > F.col("turn"), F.lit(False)), F.lit("ok"))
        .otherwise(F.lit("unanswered"))
    )
    # the arguments are canonical JSON already and go into the line as they are
    text = F.concat(F.lit('{"arguments":'), F.coalesce("args", F.lit("null")), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("tool"), F.lit("}"))
    call_rows = checked.select("conv_id", "turn", "part", F.lit("call").alias("kind"), "role", "call_id", F.col("turn").alias("anchor_turn"), "level", status.alias("status"), text.alias("line"))
    known = first.select("conv_id", "call_id", F.col("first.turn").alias("call_turn"), F.col("first.part").alias("call_part"))
    own = answers.join(known, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left").join(depth, ["conv_id", "call_id"], "left")
    place = F.when(F.col("call_turn").isNull(), F.lit("orphan")).when(F.col("turn") <= F.col("call_turn"), F.lit("early")).when(F.col("turn") > F.col("first_answer"), F.lit("repeated")).otherwise(F.lit("ok"))
    text = F.concat(F.lit('{"content":'), F.coalesce("answer", F.lit("null")), F.lit(',"role":'), quoted("role"), F.lit(',"tool_call_id":'), quoted("call_id"), F.lit("}"))
    result_rows = own.select(
        "conv_id", "turn", F.coalesce("call_part", F.lit(-1)).alias("part"), F.lit("result").alias("kind"), "role", "call_id", F.coalesce("call_turn", "turn").alias("anchor_turn"), F.coalesce("level", F.lit(0)).alias("level"), place.alias("status"), text.alias("line")
    )
    return call_rows, result_rows


def quoted(name: str) -> Column:
    """A string column as JSON text."""
    whole = F.to_json(F.struct(F.col(name).alias("x")))
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))

"""Tool calls of conversations: linked to results, ordered, validated, and written as canonical JSON.

Messages carry calls and results as JSON in their texts: an assistant's
``{"content": ..., "tool_calls": [{"id", "name", "arguments"}]}`` and a tool's
``{"tool_call_id": ..., "content": ...}``.  Any other text is plain content.

Calls and results are hash-joined by conversation and id.  A call depends on the calls whose results its
arguments cite as ``${id}``; levels of the dependency graph are found by joins over the calls that are
still open, round by round.  Arguments are checked against schemas of required and typed parameters.
Everything is built-in expressions and joins; messages, not conversations, are the rows, so that a
conversation of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.shared import Workspace, only

#: Tool -> (parameter, type, required); types as schema_of_variant() names them, number for any of them.
Schema = Sequence[tuple[str, str, bool]]
SCHEMAS: Mapping[str, Schema] = {
    "search": (("query", "string", True), ("limit", "number", False)),
    "fetch": (("url", "string", True),),
    "calculate": (("expression", "string", True),),
}
#: The columns of format_chat().
COLUMNS = ("conv_id", "turn", "part", "role", "call_id", "level", "valid", "problems", "status", "json")


def _kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return F.when(name.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), "number").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(
        name.startswith("ARRAY"), "array"
    ).when(name.startswith("OBJECT"), "object").otherwise("null")


def _quoted(value: Column) -> Column:
    """A string as JSON; null for null."""
    inner = F.regexp_extract(F.to_json(F.struct(value.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.when(value.isNull(), F.lit("null")).otherwise(inner)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no white space; null where text isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def problems(name: Column, arguments: Column, schemas: Mapping[str, Schema]) -> Column:
    """What is wrong with a call: an array of texts, empty if nothing is."""
    v = F.try_parse_json(arguments)
    is_object = F.coalesce(_kind(v) == "object", F.lit(False))
    out = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown tool"))).when(~is_object, F.array(F.lit("arguments aren't an object")))
    for tool, schema in schemas.items():
        checks = []
        for param, kind, required in schema:
            value = F.try_variant_get(v, f"$['{param}']", "variant")
            absent = value.isNull()
            checks.append(F.when(absent & F.lit(required), f"{param} is missing").when(~absent & (_kind(value) != kind), f"{param} isn't {kind}"))
        names = F.json_object_keys(arguments)
        extra = F.transform(F.array_except(names, F.array(*[F.lit(p) for p, _, _ in schema]) if schema else F.array().cast("array<string>")), lambda k: F.concat(k, F.lit(" is unknown")))
        found = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
        out = out.when(name == tool, F.concat(found, F.coalesce(extra, F.array().cast("array<string>"))))
    return out.otherwise(F.array().cast("array<string>"))


def parse(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, calls (null or array), result_of (null or id), of every row."""
    v = F.try_parse_json("text")
    braced = F.trim(F.col("text")).startswith("{")
    rows = turns.withColumn("v", F.when(braced, v))
    is_calls = (F.col("role") == "assistant") & (F.coalesce(_kind(F.try_variant_get("v", "$.tool_calls", "variant")), F.lit("")) == "array")
    raw = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    calls = F.transform(raw, lambda c: F.struct(_field(c, "$.id").alias("id"), _field(c, "$.name").alias("name"), F.to_json(F.try_variant_get(c, "$.arguments", "variant")).alias("arguments")))
    result_of = F.when(F.col("role") == "tool", _field(F.col("v"), "$.tool_call_id"))
    structured = is_calls | F.coalesce(result_of.isNotNull(), F.lit(False))
    content = F.when(structured, F.to_json(F.try_variant_get("v", "$.content", "variant")))
    return rows.select("conv_id", "turn", "role", F.when(structured, content).otherwise(F.col("text")).alias("content"), structured.alias("structured"), F.when(is_calls, calls).alias("calls"), result_of.alias("result_of"))


def levels(calls: DataFrame, ws: Workspace) -> DataFrame:
    """(conv_id, call_id, level) of the calls whose dependencies resolve: 0 for those without, else one
    above the highest of what they cite.  Calls in cycles and those after them have no row."""
    cited = F.array_distinct(F.regexp_extract_all("arguments", F.lit(r"\$\{([^{}]+)\}"), F.lit(1)))
    ids = calls.select("conv_id", "call_id").distinct()
    needs = calls.select("conv_id", "call_id", F.explode(cited).alias("on")).distinct()
    needs = ws.save(needs.join(ids.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi"))
    open_ = ws.save(ids)
    done, level = None, 0
    while not open_.isEmpty():
        waiting = needs.join(open_.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi").select("conv_id", "call_id").distinct()
        ready = ws.save(open_.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionAll(ready)
        open_ = ws.save(open_.join(ready, ["conv_id", "call_id"], "left_anti"))
        level += 1
    return done if done is not None else ids.withColumn("level", F.lit(0)).limit(0)


def format_chat(turns: DataFrame, schemas: Mapping[str, Schema] = SCHEMAS) -> DataFrame:
    """One row per message: conv_id, turn, part, role, call_id, level, valid, problems, status, json.

    part is 0 for the message itself; a message's calls follow it as rows of their own, in topological
    order: part counts them from 1 by level, then place; calls that never resolve come last.  A result is a row of role tool with its call's level.
    status: ``plain``, ``linked`` (call and result found each other), ``unanswered``, ``orphan`` (a result
    without a call before it), ``repeated`` (an id that an earlier message of the conversation used, for
    calls and for results), ``cyclic`` (a call whose dependencies never resolve).  json is canonical.

    Null texts are null contents; null roles are plain; null conv_ids or turns link nothing; only the first
    use of an id links, and rows that repeat a message in full are all that use; a text that isn't JSON, or
    names a key twice in one object, is plain content; empty tables give empty results.
    """
    ws = Workspace(turns.sparkSession)
    rows = ws.save(parse(only(turns, conv_id="long", turn="long", role="string", text="string")))
    calls = rows.where("calls is not null").select("conv_id", "turn", F.posexplode("calls").alias("place", "call"))
    calls = calls.select("conv_id", "turn", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    calls = ws.save(calls)
    some = not calls.isEmpty()
    body = F.when(F.col("structured"), F.coalesce("content", F.lit("null"))).otherwise(_quoted(F.col("content")))
    role = _quoted(F.col("role"))
    nothing = F.array().cast("array<string>")
    messages = rows.where("result_of is null").select(
        "conv_id", "turn", F.lit(0).alias("part"), "role", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("valid"),
        nothing.alias("problems"), F.lit("plain").alias("status"), F.concat(F.lit('{"content":'), body, F.lit(',"role":'), role, F.lit("}")).alias("json"),
    )
    results = rows.where("result_of is not null").select("conv_id", "turn", "role", F.col("result_of").alias("call_id"), body.alias("body"), role.alias("role_json"))
    results = ws.save(results)
    if not some and results.isEmpty():
        return messages
    # the first use of an id by a call, and by a result after it
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place")).alias("at"))
    first = first.select("conv_id", "call_id", F.col("at.turn").alias("first_turn"), F.col("at.place").alias("first_place"))
    answered = results.join(first, ["conv_id", "call_id"]).where("turn > first_turn").groupBy("conv_id", "call_id").agg(F.min("turn").alias("answer_turn"))
    links = ws.save(first.join(answered, ["conv_id", "call_id"], "left"))
    order = ws.save(levels(calls.join(first, ["conv_id", "call_id"]).where("turn = first_turn and place = first_place").select("conv_id", "call_id", "arguments"), ws))

    wrong = problems(F.col("name"), F.col("arguments"), schemas)
    linked = calls.join(links, ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"], "left").withColumn("problems", wrong)
    own = (F.col("turn") == F.col("first_turn")) & (F.col("place") == F.col("first_place"))
    status = F.when(F.col("first_turn").isNotNull() & ~own, "repeated").when(F.col("first_turn").isNotNull() & F.col("level").isNull(), "cyclic").when(F.col("answer_turn").isNotNull(), "linked").otherwise("unanswered")
    call_rows = linked.select(
        "conv_id", "turn",
        F.dense_rank().over(Window.partitionBy("conv_id", "turn").orderBy(F.col("level").asc_nulls_last(), "place")).alias("part"),
        F.lit("assistant").alias("role"), "call_id", "level", (F.size("problems") == 0).alias("valid"), "problems", status.alias("status"),
        F.concat(F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit("}")).alias("json"),
    )
    joined = results.join(links, ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"], "left")
    status = F.when(F.col("first_turn").isNull() | (F.col("turn") <= F.col("first_turn")), "orphan").when(F.col("turn") > F.col("answer_turn"), "repeated").otherwise("linked")
    result_rows = joined.select(
        "conv_id", "turn", F.lit(0).alias("part"), "role", "call_id", "level", F.lit(None).cast("boolean").alias("valid"), nothing.alias("problems"), status.alias("status"),
        F.concat(F.lit('{"content":'), F.col("body"), F.lit(',"role":'), F.col("role_json"), F.lit(',"tool_call_id":'), _quoted(F.col("call_id")), F.lit("}")).alias("json"),
    )
    return messages.unionAll(call_rows).unionAll(result_rows)

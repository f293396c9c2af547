"""Chat formatting: tool calls linked to their results, ordered, validated, in canonical JSON.

Built-in functions only. A message's text may be a JSON object with ``tool_calls`` (role
assistant: each with ``id``, ``name``, ``arguments`` and optionally ``after``, the ids of calls
it needs) or with ``tool_call_id`` (role tool). Calls and results meet in a hash join by
conversation and id. Calls are ordered topologically by ``after``: those listed before a call that
they need are moved behind it, level by level.
Arguments are tested against a schema table (name, argument, type, required). JSON is
canonical: keys sorted at every depth, no spaces.

Every message and every call is a row of its own (``level``, ``turn``, ``place`` give the order),
so a conversation is never gathered into one row.

Defined results: rows with a null conversation form one conversation; a null role or text is
written as null; of calls with one id the first (turn, place) counts and later ones are
``duplicate``; of several results the first counts; results without a call are ``orphan``; a
need that no call has is ignored; calls that need each other have level -1; calls without an
id are ``unlinked``; a tool without schema makes its calls invalid; an empty table gives an
empty result. Texts of any length are taken whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.rows import find_column, quoted
from postmill.session import scratch_path

NO_CONVERSATION = "\x00"

# Names of JSON schema types and what a parsed value is called.
TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY.*$",
    "object": r"^OBJECT.*$",
    "null": r"^VOID$",
}


def json_text(text: Column) -> Column:
    """A text as a JSON string, null as null."""
    listed = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return listed.substr(F.lit(2), F.length(listed) - 2)


def messages_of(table: DataFrame) -> DataFrame:
    """Messages with their parsed text; plain texts have none."""
    conv, turn, role, text = (quoted(find_column(table, c)) for c in ("conv_id", "turn", "role", "text"))
    return table.select(
        conv.alias("conv_id"),
        F.coalesce(conv.cast("string"), F.lit(NO_CONVERSATION)).alias("conv"),
        turn.cast("long").alias("turn"),
        role.cast("string").alias("role"),
        text.cast("string").alias("text"),
        F.when(role.cast("string").isin("assistant", "tool"), F.try_parse_json(text.cast("string"))).alias("parsed"),
    )


def calls_of(messages: DataFrame) -> DataFrame:
    """A row per tool call; arguments given as a JSON text are parsed."""
    listed = F.when(F.col("role") == "assistant", F.expr("try_variant_get(parsed, '$.tool_calls', 'array<variant>')"))
    calls = messages.select("conv_id", "conv", "turn", F.posexplode(listed).alias("place", "call"))
    raw = "try_variant_get(call, '$.arguments', 'variant')"
    return calls.select(
        "conv_id",
        "conv",
        "turn",
        "place",
        F.expr("try_variant_get(call, '$.id', 'string')").alias("id"),
        F.expr("try_variant_get(call, '$.name', 'string')").alias("name"),
        F.expr(
            f"CASE WHEN schema_of_variant({raw}) = 'STRING' THEN try_parse_json(try_variant_get(call, '$.arguments', 'string')) ELSE {raw} END"
        ).alias("arguments"),
        F.expr("try_variant_get(call, '$.after', 'array<string>')").alias("after"),
    )


def results_of(messages: DataFrame) -> DataFrame:
    """A row per tool result: (conv, turn, id, content as canonical JSON)."""
    call_id = F.expr("try_variant_get(parsed, '$.tool_call_id', 'string')")
    content = F.to_json(F.expr("try_variant_get(parsed, '$.content', 'variant')"))
    found = messages.where(F.col("role") == "tool").select("conv_id", "conv", "turn", call_id.alias("id"), content.alias("content"))
    return found.where("id is not null")


def is_valid(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``valid``: required arguments are there, all are known and of their type."""
    pattern = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))[F.lower("type")]
    entry = F.struct("argument", pattern.alias("pattern"), F.coalesce("required", F.lit(False)).alias("required"))
    tools = schemas.groupBy(F.col("name").alias("tool")).agg(F.collect_set(entry).alias("schema"))
    calls = calls.join(tools, F.col("name") == F.col("tool"), "left")
    kinds = F.transform_values(F.expr("try_variant_get(arguments, '$', 'map<string, variant>')"), lambda _, v: F.schema_of_variant(v))
    calls = calls.withColumn("kinds", kinds)
    complete = F.forall("schema", lambda s: ~s["required"] | F.map_contains_key("kinds", s["argument"]))
    typed = F.forall(
        F.map_entries("kinds"),
        lambda e: F.exists("schema", lambda s: (s["argument"] == e["key"]) & F.coalesce(F.rlike(e["value"], s["pattern"]), F.lit(False))),
    )
    return calls.withColumn("valid", F.coalesce(complete & typed, F.lit(False))).drop("tool", "schema", "kinds")


def levels_of(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """(conv, id, level) of calls whose order must change; all others have level 0.

    A call listed after all that it needs keeps its place. Only calls that need one listed
    later, and those that need such calls in turn, are peeled off round by round: level 1
    needs none of them, level 2 only those of level 1 and so on; what is left needs itself.
    By (level, turn, place) every call then comes after its needs. Rounds handle ids alone,
    as many as the longest chain of moved calls.
    """
    listed = calls.groupBy("conv", "id").agg(F.min(F.struct("turn", "place", "after")).alias("at"))
    known = listed.select("conv", F.col("id").alias("need"), F.struct("at.turn", "at.place").alias("need_at"))
    needs = listed.select("conv", "id", F.struct("at.turn", "at.place").alias("at"), F.explode("at.after").alias("need")).distinct()
    needs = _stored(spark, needs.join(known, ["conv", "need"]).select("conv", "id", "need", (F.col("need_at") >= F.col("at")).alias("later")))
    moved = new = _stored(spark, needs.where("later").select("conv", "id").distinct())
    while not new.isEmpty():
        asks = needs.join(new.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_semi")
        new = _stored(spark, asks.select("conv", "id").distinct().join(moved, ["conv", "id"], "left_anti"))
        moved = moved.unionByName(new)
    open_ = needs.select("conv", "id", "need").join(moved.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_semi")
    rest = _stored(spark, moved)
    placed, level = rest.where("false").withColumn("level", F.lit(0)), 0
    while not rest.isEmpty():
        level += 1
        open_ = _stored(spark, open_.join(rest.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_semi"))
        waiting = _stored(spark, rest.join(open_, ["conv", "id"], "left_semi"))
        ready = _stored(spark, rest.join(waiting, ["conv", "id"], "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return placed.unionByName(waiting.withColumn("level", F.lit(-1)))
        placed, rest = placed.unionByName(ready), waiting
    return placed


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    folder = scratch_path(spark, "chats")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def format_chats(spark: SparkSession, table: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, turn, level, place, kind, status, call_id, name, valid, n_results, json), a row per message, call and orphan result."""
    messages = messages_of(table)
    calls = is_valid(calls_of(messages), schemas)
    named = calls.where("id is not null")
    first = named.groupBy("conv", "id").agg(F.min(F.struct("turn", "place")).alias("first"))
    results = results_of(messages)
    answer = results.groupBy("conv", "id").agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"))
    linked = calls.join(first, ["conv", "id"], "left").join(answer, ["conv", "id"], "left")
    linked = linked.join(levels_of(spark, calls_of(messages).where("id is not null")), ["conv", "id"], "left")
    again = F.col("first").isNotNull() & ~F.struct("turn", "place").eqNullSafe(F.col("first"))
    status = (
        F.when(F.col("id").isNull(), "unlinked").when(again, "duplicate").when(F.col("answer").isNull(), "unanswered").otherwise("answered")
    )
    linked = linked.withColumn("status", status)
    result = F.when(F.col("status") == "answered", F.col("answer.content"))
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("arguments"), F.lit("null")),
        F.lit(',"id":'), json_text(F.col("id")),
        F.lit(',"name":'), json_text(F.col("name")),
        F.lit(',"result":'), F.coalesce(result, F.lit("null")), F.lit("}"),
    )
    call_rows = linked.select(
        "conv_id", "turn", F.coalesce("level", F.lit(0)).cast("int").alias("level"), F.col("place").cast("int").alias("place"),
        F.lit("call").alias("kind"), "status", F.col("id").alias("call_id"), "name", "valid",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), body.alias("json"),
    )

    def plain(rows: DataFrame, kind: str, call_id: Column, json: Column) -> DataFrame:
        return rows.select(
            "conv_id", "turn", F.lit(0).alias("level"), F.lit(-1).alias("place"), F.lit(kind).alias("kind"), F.lit(kind).alias("status"),
            call_id.cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("valid"),
            F.lit(0).cast("long").alias("n_results"), json.alias("json"),
        )

    has_calls = F.expr("try_variant_get(parsed, '$.tool_calls', 'array<variant>') is not null and role = 'assistant'")
    is_result = F.expr("try_variant_get(parsed, '$.tool_call_id', 'string') is not null and role = 'tool'")
    content = F.when(F.coalesce(has_calls, F.lit(False)), F.expr("try_variant_get(parsed, '$.content', 'string')")).otherwise(F.col("text"))
    spoken = messages.where(~F.coalesce(is_result, F.lit(False)))
    said = F.concat(F.lit('{"content":'), json_text(content), F.lit(',"role":'), json_text(F.col("role")), F.lit("}"))
    orphans = results.join(first.select("conv", "id"), ["conv", "id"], "left_anti")
    lost = F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(',"tool_call_id":'), json_text(F.col("id")), F.lit("}"))
    return call_rows.unionByName(plain(spoken, "message", F.lit(None), said)).unionByName(plain(orphans, "orphan", F.col("id"), lost))


# What the registered query makes of the plain conversations, so that they hold calls.
SCHEMAS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("summarise", "words", "integer", True),
    ("summarise", "short", "boolean", True),
]


def with_tool_calls(table: DataFrame) -> DataFrame:
    """Conversations in which assistants call tools and the next user turns hold the results.

    An assistant turn calls ``search`` for its whole text and ``summarise`` after it and after
    the ``search`` two turns earlier; some turns list the two in the wrong order, some arguments
    are of a wrong type or missing. The user turn after it answers the first call, and the
    second one mostly. A null text is asked for and answered as a JSON null.
    """
    size = F.coalesce(F.length("text"), F.lit(0))
    call_id = lambda turn, n: F.concat_ws(":", "conv_id", turn.cast("string"), F.lit(str(n)))
    turn = F.col("turn")
    search = F.concat(
        F.lit('{"name":"search","id":'), json_text(call_id(turn, 0)), F.lit(',"arguments":{"query":'), json_text(F.col("text")),
        F.when(size % 5 == 0, F.lit(',"limit":"many"}}')).otherwise(F.concat(F.lit(',"limit":'), (size % 7).cast("string"), F.lit("}}"))),
    )
    summarise = F.concat(
        F.lit('{"name":"summarise","id":'), json_text(call_id(turn, 1)),
        F.lit(',"arguments":{"words":'), size.cast("string"),
        F.when(size % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(',"short":'), (size < 200).cast("string"))),
        F.lit('},"after":'), F.to_json(F.array(call_id(turn, 0), call_id(turn - 2, 0))), F.lit("}"),
    )
    both = F.when(size % 6 == 0, F.concat(summarise, F.lit(","), search)).otherwise(F.concat(search, F.lit(","), summarise))
    asked = F.concat(F.lit('{"content":'), json_text(F.col("text")), F.lit(', "tool_calls":['), both, F.lit("]}"))
    answer = lambda n: F.concat(
        F.lit('{"tool_call_id":'), json_text(call_id(turn - 1, n)), F.lit(', "content":'), json_text(F.col("text")), F.lit("}")
    )
    keep = table.select("conv_id", "turn", "role", "text")
    # A null role or turn is neither; such messages stay as they are.
    calling, answering = (F.coalesce(F.expr(x), F.lit(False)) for x in ("role = 'assistant'", "role = 'user' and turn > 0"))
    answers = F.when(F.length("text") % 3 == 0, F.array(answer(0))).otherwise(F.array(answer(0), answer(1)))
    turned = keep.where(answering).select("conv_id", "turn", F.lit("tool").alias("role"), F.explode(answers).alias("text"))
    called = keep.where(calling).withColumn("text", asked)
    return keep.where(~calling & ~answering).unionByName(called).unionByName(turned)

"""Tool-call linking in conversations.

Messages become calls and results with an identifier; a hash join links them. A linked pair is
checked against the schema of its tool, placed in topological order and written as canonical JSON:
keys sorted, no spaces, the same string for the same content.

A call is placed before its result, whatever turns they claim. A call depends on the calls that its
arguments name: a string argument that is another explicit call's identifier in the conversation, with
or without a ``$`` before it. Calls are ordered by turn where that respects all dependencies; a call
that claims an earlier turn than one it depends on is moved behind it (``ordered``: places are raised
along the dependencies until none is broken). Calls in a circle, and those that depend on one, keep
their turn and get the error ``circular reference``.

``parsed`` reads chat messages. An assistant's message of the form
``{"tool_calls":[{"id":..,"name":..,"arguments":{..}}]}`` holds calls, a tool's
``{"tool_call_id":..,"content":..}`` a result; a tool's other messages are results without an
identifier. Any other user's message is itself a call of the tool ``assistant`` with its text as
argument, and any other assistant's message is the result of the message before it. So every
conversation has calls, and one without a reply or a reply without a question shows as unlinked.

Identifiers are unique in a conversation only; a repeated identifier (repeated rows) links calls and
results of the same rank among equal identifiers, by turn. Null texts are empty strings. Messages
without a conversation and calls or results without an identifier are never linked; the former are
conversations of their own (place 0). Null turns come first. Very long texts stay whole. Extra columns
are ignored. No task holds a whole conversation: places are counted in blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ranked, table

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: Turns in a block of the order.
BLOCK = 1000
#: Of each tool its arguments: name, type, whether it is required, least and most length of strings (null: any).
SCHEMAS = {"assistant": (("text", "string", True, 1, 4000),)}


def parsed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls: conv_id, turn, call_id, name, arguments, explicit; results: conv_id, turn, call_id, content)."""
    text = F.coalesce(messages["text"].cast("string"), F.lit(""))
    rows = messages.select("conv_id", messages["turn"].cast("long").alias("turn"), "role", text.alias("text"))
    maybe = F.ltrim("text").startswith("{")
    rows = rows.withColumn("c", F.when(maybe & (F.col("role") == "assistant"), F.from_json("text", CALLS)["tool_calls"]))
    rows = rows.withColumn("r", F.when(maybe & (F.col("role") == "tool"), F.from_json("text", RESULT)))
    own = lambda turn: F.concat(F.lit("turn-"), turn.cast("string"))
    holds = F.coalesce(F.size("c") > 0, F.lit(False))
    explicit = rows.where(holds).select("conv_id", "turn", F.explode("c").alias("c"))
    explicit = explicit.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), F.lit(True).alias("explicit"))
    asked = rows.where("role = 'user'").select("conv_id", "turn", own(F.col("turn")).alias("call_id"), F.lit("assistant").alias("name"), F.to_json(F.struct("text")).alias("arguments"), F.lit(False).alias("explicit"))
    named = F.col("r.tool_call_id").isNotNull()
    told = rows.where("role = 'tool'").select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.when(named, F.coalesce("r.content", F.lit(""))).otherwise(F.col("text")).alias("content"))
    said = rows.where((F.col("role") == "assistant") & ~holds).select("conv_id", "turn", own(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return explicit.unionByName(asked), told.unionByName(said)


def _circular(edges: DataFrame) -> DataFrame:
    """The dependencies that are left when those on calls without open dependencies are taken away, again and again."""
    n = edges.count()
    while True:
        waiting = edges.select("conv_id", F.col("user").alias("used")).distinct()
        edges = materialise(edges.join(waiting, ["conv_id", "used"], "left_semi"), "calls-circular")
        old, n = n, edges.count()
        if n == old:
            return edges


def ordered(calls: DataFrame) -> DataFrame | None:
    """(conv_id, call_id, at, level, circular) of the calls that can't stand by their turn; None if there are none.

    By (at, level) a call stands behind all it depends on. Each round raises the calls that stand
    before one they depend on; without a circle a call is raised by no more rounds than its conversation
    has dependencies. Only calls with dependencies take part.
    """
    linkable = calls.where("explicit and conv_id is not null and call_id is not null")
    named = F.explode(F.array_distinct(F.transform(F.map_values(F.from_json("arguments", "map<string,string>")), lambda v: F.regexp_replace(v, r"^\$", ""))))
    users = linkable.select("conv_id", F.col("call_id").alias("user"), named.alias("used"))
    ids = linkable.groupBy("conv_id", F.col("call_id").alias("used")).agg(F.min(F.coalesce("turn", F.lit(-1))).alias("turn"))
    edges = users.join(ids.select("conv_id", "used"), ["conv_id", "used"]).select("conv_id", "user", "used").distinct()
    edges = materialise(edges, "calls-edges")
    most = edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if not most:
        return None
    part = edges.select("conv_id", F.col("user").alias("used")).unionByName(edges.select("conv_id", "used")).distinct()
    places = materialise(ids.join(part, ["conv_id", "used"]).select("conv_id", F.col("used").alias("call_id"), "turn", F.struct(F.col("turn").alias("at"), F.lit(0).alias("level")).alias("place")), "calls-places")
    raised = None
    for _ in range(most + 1):
        above = edges.join(places.select("conv_id", F.col("call_id").alias("used"), F.col("place").alias("under")), ["conv_id", "used"])
        least = above.groupBy("conv_id", F.col("user").alias("call_id")).agg(F.max("under").alias("under"))
        broken = places.join(least, ["conv_id", "call_id"]).where("place <= under")
        raised = materialise(broken.select("conv_id", "call_id", F.struct(F.col("under.at").alias("at"), (F.col("under.level") + 1).alias("level")).alias("to")), "calls-raised")
        if raised.isEmpty():
            break
        places = materialise(places.join(raised, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "turn", F.coalesce("to", "place").alias("place")), "calls-places")
    stuck = (edges.limit(0) if raised.isEmpty() else _circular(edges)).select("conv_id", F.col("user").alias("call_id")).distinct()
    out = places.join(stuck.withColumn("circular", F.lit(True)), ["conv_id", "call_id"], "left").withColumn("circular", F.coalesce("circular", F.lit(False)))
    at = F.when(F.col("circular"), F.col("turn")).otherwise(F.col("place.at"))
    return out.select("conv_id", "call_id", at.alias("at"), F.when(F.col("circular"), 0).otherwise(F.col("place.level")).alias("level"), "circular")


def errors(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """array<string>: what is wrong with the arguments (JSON text) of a call; sorted."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    out = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown tool")))
    for tool, properties in schemas.items():
        found = [F.when(value.isNull() | ~kind.startswith("OBJECT"), F.lit("not an object"))]
        for key, type_, required, least, most in properties:
            at = F.try_variant_get(value, f"$.{key}", "variant")
            got = F.schema_of_variant(at)
            size = F.length(F.try_variant_get(value, f"$.{key}", "string"))
            right = {"string": got == "STRING", "number": got.isin("BIGINT", "DOUBLE") | got.startswith("DECIMAL"), "boolean": got == "BOOLEAN", "object": got.startswith("OBJECT"), "array": got.startswith("ARRAY")}[type_]
            missing = at.isNull() | (got == "VOID")
            found.append(F.when(missing, F.lit(f"{key}: missing") if required else F.lit(None)).when(~right, F.lit(f"{key}: not a {type_}")))
            if type_ == "string" and (least is not None or most is not None):
                ok = size.between(least or 0, most if most is not None else 2**31 - 1)
                found.append(F.when(~missing & right & ~ok, F.lit(f"{key}: length")))
        out = out.when(name == tool, F.array_sort(F.array_compact(F.array(*found))))
    return out


def _ranked(rows: DataFrame, order: str) -> DataFrame:
    """Number rows of equal identifier by turn: identifiers repeat only with repeated rows."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", order)))


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call, and per result without a call: conv_id, seq, call_id, call_turn, result_turn, status, n_errors, canonical."""
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    places = ordered(calls)
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments")
    c, r = _ranked(calls.where(known), "arguments").alias("c"), _ranked(results.where(known), "content").alias("r")
    same = (F.col("c.conv_id") == F.col("r.conv_id")) & (F.col("c.call_id") == F.col("r.call_id")) & (F.col("c.k") == F.col("r.k"))
    both = c.join(r.hint("shuffle_hash"), same, "full")
    is_call, is_result = F.col("c.k").isNotNull(), F.col("r.k").isNotNull()
    rows = both.select(F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("c.call_id", "r.call_id").alias("call_id"), F.col("c.turn").alias("call_turn"), F.col("r.turn").alias("result_turn"), is_call.alias("is_call"), is_result.alias("is_result"), "c.name", "c.arguments", "r.content")
    alone = calls.where(~known).select("conv_id", "call_id", F.col("turn").alias("call_turn"), F.lit(True).alias("is_call"), F.lit(False).alias("is_result"), "name", "arguments")
    lost = results.where(~known).select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.lit(False).alias("is_call"), F.lit(True).alias("is_result"), "content")
    rows = rows.unionByName(alone, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
    status = F.when(F.col("is_call") & F.col("is_result"), F.when(F.col("result_turn") > F.col("call_turn"), F.lit("linked")).otherwise(F.lit("early result"))).when(F.col("is_call"), F.lit("no result")).otherwise(F.lit("no call"))
    rows = rows.withColumn("status", status).withColumn("at", F.coalesce("call_turn", "result_turn", F.lit(-1))).withColumn("level", F.lit(0))
    wrong = F.when(F.col("is_call"), errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    if places is not None:
        at = places.select("conv_id", "call_id", F.col("at").alias("p_at"), F.col("level").alias("p_level"), "circular")
        rows = rows.join(at.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
        rows = rows.withColumn("at", F.coalesce("p_at", "at")).withColumn("level", F.coalesce("p_level", "level"))
        wrong = F.when(F.coalesce("circular", F.lit(False)), F.array_sort(F.concat(wrong, F.array(F.lit("circular reference"))))).otherwise(wrong)
    rows = rows.select("conv_id", "call_id", "call_turn", "result_turn", "status", "name", "arguments", "content", wrong.alias("errors"), "at", "level")
    named = rows.where("conv_id is not null")
    named = ranked(named, ["conv_id"], [F.col("at"), F.col("level"), F.col("call_turn"), F.col("call_id"), F.col("arguments"), F.col("content")], F.floor(F.col("at") / BLOCK), "seq")
    rows = named.unionByName(rows.where("conv_id is null").withColumn("seq", F.lit(0).cast("long")))
    return rows.select("conv_id", "seq", "call_id", "call_turn", "result_turn", "status", F.size("errors").alias("n_errors"), canonical().alias("canonical"))


def canonical() -> Column:
    """Canonical JSON of a linked row: sorted keys, no spaces, arguments as sorted JSON, absent parts left out."""
    pairs = F.from_json("arguments", "map<string,string>")
    plain = F.transform(F.array_sort(F.map_keys(pairs)), lambda k: F.concat(_quoted(k), F.lit(":"), _value(k)))
    args = F.concat(F.lit("{"), F.array_join(plain, ","), F.lit("}"))
    part = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    parts = [part("arguments", args), part("errors", F.to_json("errors")), part("id", _quoted(F.col("call_id"))), part("name", _quoted(F.col("name"))), part("result", _quoted(F.col("content"))), part("status", _quoted(F.col("status")))]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(c: Column) -> Column:
    """A JSON string; null stays null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def _value(key: Column) -> Column:
    """The argument ``key`` as JSON; objects inside are in the order of a variant, which sorts keys."""
    return F.coalesce(F.to_json(F.element_at(F.try_parse_json(F.col("arguments")).cast("map<string,variant>"), key)), F.lit("null"))


def query(spark, sf_dir):
    return link(*parsed(table(spark, sf_dir, "conversations")))


SQL = """
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, turn, 'turn-' || turn AS call_id, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k FROM m WHERE role = 'user'
), r AS (
  SELECT conv_id, turn, 'turn-' || (turn - 1) AS call_id, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k FROM m WHERE role = 'assistant'
), j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn, r.turn AS result_turn, c.text AS asked, r.text AS said,
    CASE WHEN c.turn IS NULL THEN 'no call' WHEN r.turn IS NULL THEN 'no result' ELSE 'linked' END AS status,
    CASE WHEN c.turn IS NOT NULL AND (length(c.text) < 1 OR length(c.text) > 4000) THEN '["text: length"]' ELSE '[]' END AS errors
  FROM c FULL JOIN r USING (conv_id, call_id, k)
)
SELECT conv_id, CASE WHEN conv_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(call_turn, result_turn), call_id) - 1 END AS seq, call_id, call_turn, result_turn, status,
  CAST(CASE WHEN errors = '[]' THEN 0 ELSE 1 END AS INTEGER) AS n_errors,
  '{' || concat_ws(',', '"arguments":{"text":' || CAST(to_json(asked) AS VARCHAR) || '}', '"errors":' || errors, '"id":' || CAST(to_json(call_id) AS VARCHAR),
    CASE WHEN asked IS NOT NULL THEN '"name":"assistant"' END, '"result":' || CAST(to_json(said) AS VARCHAR), '"status":' || CAST(to_json(status) AS VARCHAR)) || '}' AS canonical
FROM j
"""

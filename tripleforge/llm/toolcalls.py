"""Chat formatting: tool calls linked to their results, in order, checked against schemas, as canonical JSON.

A turn's text may hold, between other text, declarations of tools, calls and results:
    <tools>[{"name": .., "parameters": {"properties": {"x": {"type": ..}}, "required": [..]}}]</tools>
parameters being a JSON schema of objects and arrays to any depth: type (one or a list), properties, required, items, enum;
    <tool_call>{"id": .., "name": .., "arguments": {..}}</tool_call>
    <tool_result>{"id": .., "content": ..}</tool_result>
What remains of the text, if anything, is the turn's message. Each of these is one row of the result. Within a conversation, a result links to
the first call of its id, and a call to the first result; the links come from hash joins by (conversation, id) and no conversation is gathered
anywhere. Rows sorted by (conv_id, order_turn, order_rank, turn, item) are in topological order: a result comes after its call even where it
stands before it. status is: ok (a linked call with valid arguments, a linked result, a message), unanswered, orphan, duplicate, undeclared (the
conversation declares no tool of that name), invalid (arguments that are no object, or that somewhere miss a required key, have a key that the schema's properties
don't list, another type, or a value outside the enum), malformed (no JSON
object, or no id). Where a schema has neither properties nor items, anything may stand below. Of several declarations of a tool the greatest by its text counts. json is the row with sorted keys; numbers are written as Spark's variant writes them.

Schemas and arguments are taken apart level by level into rows of (path, value), which meet by hash joins; there are as many rounds as the deepest of
them has levels, none where no call is made.

A turn may declare tools in several blocks. A very long text is one row like any other. A null text is an empty message. Null conversations are one conversation; null turns come first. Repeated turns are
rows of their own, and their calls count as duplicates. Empty tables give empty results; extra columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept

#: What a schema's type may be as a variant.
TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID"}


def _text(path: str):
    return F.try_variant_get("v", path, "string")


def _piece(key: Column) -> Column:
    """A key as a piece of a path; * stands for any place of an array."""
    for x, y in (("~", "~0"), ("/", "~1"), ("*", "~2")):
        key = F.replace(key, F.lit(x), F.lit(y))
    return F.concat(F.lit("/"), key)


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def _exploded(df: DataFrame, columns: list[str], v: str) -> DataFrame:
    """columns with key and value of each member of an object or array in v."""
    return df.sparkSession.sql(f"SELECT {', '.join(f'x.{c}' for c in columns)}, e.key, e.value FROM {{t}} x, LATERAL variant_explode(x.{v}) e", t=df)


def _levels(first: DataFrame, below, name: str) -> DataFrame | None:
    """All rows of first and of what below() makes of each level, written; None without any."""
    out, level = None, Kept(first, name).df
    while not level.isEmpty():
        out = level if out is None else out.unionByName(level)
        level = Kept(below(level), name).df
    return out


def schema_rows(tools: DataFrame) -> DataFrame | None:
    """(conv_id, tool, path, types, choices, required, closed) of every part of the parameters of tools (conv_id, tool, v)."""
    def below(level: DataFrame) -> DataFrame:
        props = level.withColumn("p", F.try_variant_get("v", "$.properties", "variant")).where(F.col("p").isNotNull() & _is(F.col("p"), "OBJECT"))
        named = _exploded(props, ["conv_id", "tool", "path"], "p").select("conv_id", "tool", F.concat("path", _piece(F.col("key"))).alias("path"), F.col("value").alias("v"))
        items = level.withColumn("i", F.try_variant_get("v", "$.items", "variant")).where("i is not null").select("conv_id", "tool", F.concat("path", F.lit("/*")).alias("path"), F.col("i").alias("v"))
        return named.unionByName(items)

    rows = _levels(tools.select("conv_id", "tool", F.lit("").alias("path"), "v"), below, "schemas")
    if rows is None:
        return None
    kind = F.try_variant_get("v", "$.type", "variant")
    types = F.when(_is(kind, "ARRAY"), F.from_json(F.to_json(kind), "array<string>")).when(kind.isNotNull(), F.array(F.try_variant_get("v", "$.type", "string")))
    choices = F.transform(F.try_variant_get("v", "$.enum", "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))
    closed = F.try_variant_get("v", "$.properties", "variant").isNotNull() | F.try_variant_get("v", "$.items", "variant").isNotNull()
    return rows.select("conv_id", "tool", "path", types.alias("types"), choices.alias("choices"), F.try_variant_get("v", "$.required", "array<string>").alias("required"), closed.alias("closed"))


def invalid_calls(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """The calls (row, item, conv_id, tool, v: the arguments) that don't meet their tool's schema: (row, item)."""
    def below(level: DataFrame) -> DataFrame:
        e = _exploded(level, ["row", "item", "conv_id", "tool", "path", "place", "v"], "v")
        key = F.coalesce(F.col("key"), F.lit("*"))
        return e.select("row", "item", "conv_id", "tool", F.concat("path", F.when(F.col("key").isNull(), F.lit("/*")).otherwise(_piece(key))).alias("path"), F.col("path").alias("parent"), F.concat("place", F.lit("/"), F.coalesce(F.to_json(F.struct("key")), F.lit(""))).alias("place"), F.col("place").alias("above"), "key", F.col("value").alias("v"))

    none = F.lit(None).cast("string")
    first = calls.select("row", "item", "conv_id", "tool", F.lit("").alias("path"), none.alias("parent"), F.lit("").alias("place"), none.alias("above"), none.alias("key"), "v")
    nodes = _levels(first, below, "arguments")
    if nodes is None:
        return calls.select("row", "item").limit(0)
    on = lambda a, b: F.col("n.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("n.tool") == F.col("s.tool")) & (F.col(a) == F.col(b))
    own = nodes.alias("n").join(schemas.alias("s"), on("n.path", "s.path"), "left")
    pattern = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    fits = F.exists("s.types", lambda t: F.coalesce(F.rlike(F.schema_of_variant("n.v"), F.coalesce(F.element_at(pattern, t), F.lit(""))), F.lit(True)))
    listed = F.array_contains("s.choices", F.coalesce(F.to_json("n.v"), F.lit("null")))
    wrong = (F.col("s.types").isNotNull() & ~fits) | (F.col("s.choices").isNotNull() & ~listed)
    bad = own.where(F.col("s.path").isNotNull() & wrong).select("n.row", "n.item")
    # Keys that the schema of the object or array above lists none of.
    unknown = own.where(F.col("s.path").isNull() & F.col("n.parent").isNotNull()).select("n.*")
    unknown = unknown.alias("n").join(schemas.where("closed").alias("s"), on("n.parent", "s.path")).select("n.row", "n.item")
    # Required keys of each object that is there.
    keys = nodes.where("key is not null").select("row", "item", F.col("above").alias("place"), "key")
    need = own.where(F.size("s.required") > 0).where(_is(F.col("n.v"), "OBJECT")).select("n.row", "n.item", "n.place", F.explode("s.required").alias("key"))
    missing = need.join(keys, ["row", "item", "place", "key"], "left_anti").select("row", "item")
    return bad.unionByName(unknown).unionByName(missing).distinct()


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, item, kind, call_id, status, order_turn, order_rank, json."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    has = F.col("text").contains("<tool")
    tags = F.when(has, F.regexp_extract_all("text", F.lit("(?s)<tool_(call|result)>.*?</tool_\\1>"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rest = F.when(has, F.trim(F.regexp_replace(F.regexp_replace("text", "(?s)<tool_(call|result)>.*?</tool_\\1>", ""), "(?s)<tools>.*?</tools>", ""))).otherwise(F.col("text"))
    own = F.array(F.struct(F.lit(0).alias("item"), F.lit("message").alias("kind"), rest.alias("body")))
    part = lambda t, i: F.struct((i + 1).alias("item"), F.when(F.startswith(t, F.lit("<tool_call>")), "call").otherwise("result").alias("kind"), F.regexp_replace(t, "^<tool_[a-z]+>|</tool_[a-z]+>$", "").alias("body"))
    listed = F.concat(F.when((rest != "") | (F.size(tags) == 0), own).otherwise(F.array().cast("array<struct<item:int,kind:string,body:string>>")), F.transform(tags, part))
    items = turns.select("conv_id", "turn", "role", "row", F.explode(listed).alias("x")).select("conv_id", "turn", "role", "row", "x.*")

    # Row numbers are shared by all that follows, so what they number is written; turns without tags need none of it.
    tagged = Kept(items.where("kind <> 'message'").select("conv_id", "turn", "role", "row", "item", "kind", "body"), "tool-items").df
    tagged = tagged.withColumn("v", F.try_parse_json("body"))
    tagged = tagged.withColumn("id", F.when(F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), _text("$.id")))
    tagged = tagged.select("*", F.when(F.col("id").isNotNull() & (F.col("kind") == "call"), _text("$.name")).alias("name"), F.struct(F.col("turn"), F.col("row"), F.col("item")).alias("place"))
    key = [F.col("conv_id"), F.col("id")]
    firsts = tagged.where("id is not null").groupBy(*key).agg(F.min(F.when(F.col("kind") == "call", F.col("place"))).alias("call_at"), F.min(F.when(F.col("kind") == "result", F.col("place"))).alias("result_at"))
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("id").alias("_i"), "call_at", "result_at")
    linked = tagged.where("id is not null").join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i"))).drop("_c", "_i")

    # Tools that each conversation declares, and the calls' arguments; both are written, as their parts are looked at level by level.
    blocks = turns.where(F.col("text").contains("<tools>")).select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("(?s)<tools>(.*?)</tools>"), F.lit(1))).alias("block"))
    bodies = blocks.select("conv_id", F.try_parse_json("block").alias("v")).where(_is(F.col("v"), "ARRAY"))
    tools = _exploded(bodies, ["conv_id"], "v").where(_is(F.col("value"), "OBJECT")).select("conv_id", F.try_variant_get("value", "$.name", "string").alias("tool"), F.to_json(F.coalesce(F.try_variant_get("value", "$.parameters", "variant"), F.parse_json(F.lit("{}")))).alias("j")).where("tool is not null")
    tools = tools.groupBy("conv_id", "tool").agg(F.max("j").alias("j"))
    schemas = schema_rows(tools.select("conv_id", "tool", F.parse_json("j").alias("v")))
    calls = linked.where("kind = 'call'")
    known, bad = F.lit(False), F.lit(False)
    if schemas is not None:
        args = calls.withColumn("a", F.try_variant_get("v", "$.arguments", "variant")).withColumn("an_object", F.coalesce(_is(F.col("a"), "OBJECT"), F.lit(False)))
        named = args.where("an_object and name is not null").select("row", "item", "conv_id", F.col("name").alias("tool"), F.col("a").alias("v"))
        wrong = invalid_calls(named, schemas).withColumn("wrong", F.lit(True))
        declared = schemas.where("path = ''").select(F.col("conv_id").alias("_c"), F.col("tool").alias("_n"), F.lit(True).alias("known"))
        calls = args.join(declared, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("name") == F.col("_n")), "left").join(wrong, ["row", "item"], "left")
        known, bad = F.col("known").isNotNull(), ~F.col("an_object") | F.col("wrong").isNotNull()
    calls = calls.withColumn("status", F.when(F.col("place") != F.col("call_at"), "duplicate").when(~known, "undeclared").when(bad, "invalid").when(F.col("result_at").isNull(), "unanswered").otherwise("ok"))
    results = linked.where("kind = 'result'").withColumn("status", F.when(F.col("call_at").isNull(), "orphan").when(F.col("place") != F.col("result_at"), "duplicate").otherwise("ok"))
    columns = ["conv_id", "turn", "item", "row", "role", "kind", "id", "name", "status"]
    text = lambda c: F.coalesce(F.to_json(c), F.lit("null"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1)
    or_null = lambda c: F.when(c.isNull(), "null").otherwise(quoted(c))
    call_json = F.concat(F.lit('{"arguments":'), text(F.try_variant_get("v", "$.arguments", "variant")), F.lit(',"id":'), quoted(F.col("id")), F.lit(',"name":'), or_null(F.col("name")), F.lit(',"role":'), or_null(F.col("role")), F.lit("}"))
    result_json = F.concat(F.lit('{"content":'), text(F.try_variant_get("v", "$.content", "variant")), F.lit(',"id":'), quoted(F.col("id")), F.lit(',"role":'), or_null(F.col("role")), F.lit("}"))
    plain_json = F.concat(F.lit('{"content":'), quoted(F.col("body")), F.lit(',"role":'), or_null(F.col("role")), F.lit("}"))
    out = calls.select(*columns, F.col("turn").alias("order_turn"), F.lit(1).alias("order_rank"), call_json.alias("json"))
    later = F.when(F.col("call_at").isNotNull(), F.greatest("turn", "call_at.turn")).otherwise(F.col("turn"))
    out = out.unionByName(results.select(*columns, later.alias("order_turn"), F.lit(2).alias("order_rank"), result_json.alias("json")))
    none = F.lit(None).cast("string")
    messages = items.where("kind = 'message'").withColumn("status", F.lit("ok")).withColumn("id", none).withColumn("name", none)
    broken = tagged.where("id is null").withColumn("status", F.lit("malformed")).withColumn("name", none)
    plain = messages.select(*columns, "body").unionByName(broken.select(*columns, "body"))
    out = out.unionByName(plain.select(*columns, F.col("turn").alias("order_turn"), F.lit(0).alias("order_rank"), plain_json.alias("json")))
    return out.select("conv_id", "turn", "item", "kind", F.col("id").alias("call_id"), "status", "order_turn", "order_rank", "json")


def plain_sql() -> str:
    """The same rows in DuckDB's SQL for conversations without tool tags."""
    return """SELECT conv_id, turn, 0 AS item, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'ok' AS status, turn AS order_turn, 0 AS order_rank,
    '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json FROM conversations"""

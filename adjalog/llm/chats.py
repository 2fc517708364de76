"""Operator 4: link tool calls to their results, order, validate and serialise them.

Calls and results meet in a hash join on the call's identifier. Calls are ordered so that
each comes after those it depends on, validated against the schema of their tool, and
written as canonical JSON: keys sorted, no spaces. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

_TEXT = {"type": "string", "minLength": 1, "maxLength": 4000}
_COUNT = {"type": "integer", "minimum": 1, "maximum": 4000}
#: The schema of each tool's arguments: type, enum, bounds, items, properties, required and
#: additionalProperties, as JSON Schema names them. A type may be a list of types.
SCHEMAS = {
    "ask": {"type": "object", "properties": {"text": _TEXT, "n_chars": _COUNT}, "required": ["text", "n_chars"], "additionalProperties": False},
    "follow_up": {"type": "object", "properties": {"after": {"type": "string", "minLength": 3}, "text": _TEXT, "n_chars": _COUNT}, "required": ["after", "text", "n_chars"], "additionalProperties": False},
}
#: Turns, or levels, of a conversation that are ordered together.
BAND = 1024


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(call_id, level) of (call_id, after): the longest chain of calls before each one.

    Calls with one dependency jump along it in doubling steps to the first call with none or
    several, so a chain takes rounds by the logarithm of its length. Only calls with several
    dependencies are then ordered a round at a time. Calls of a cycle, and those after it,
    get no row; nor does a null identifier. A dependency that is no call counts as met.
    """
    ids = calls.where("call_id is not null").select("call_id").distinct()
    need = calls.select("call_id", "after").where("call_id is not null and after is not null").distinct()
    need = scratch.keep(need.join(ids.withColumnRenamed("call_id", "after"), "after", "left_semi").select("call_id", "after"), "need")
    deps = need.groupBy("call_id").agg(F.count("*").alias("n"), F.min("after").alias("after"))
    single = deps.where("n = 1").select("call_id", "after")
    inner = single.select(F.col("call_id").alias("after"), F.lit(True).alias("open"))
    jumps = scratch.keep(single.join(inner, "after", "left").select("call_id", F.col("after").alias("to"), F.lit(1).alias("d"), F.coalesce("open", F.lit(False)).alias("open")), "jump0")
    n, k = jumps.count(), 0
    while (1 << k) <= n and jumps.where("open").head(1):
        k += 1
        step = jumps.select(F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("open").alias("open2"))
        moved = jumps.where("open").join(step, "to").select("call_id", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.col("open2").alias("open"))
        jumps = scratch.keep(jumps.where("not open").union(moved), f"jump{k}")
        scratch.drop(f"jump{k - 1}")
    tops = scratch.keep(ids.join(deps.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(0).alias("level")), "level0")
    # Of calls with several dependencies: each by way of its jump; to null if that ends in a cycle.
    many = need.join(deps.where("n > 1").select("call_id"), "call_id", "left_semi")
    via = jumps.select(F.col("call_id").alias("after"), F.when(~F.col("open"), F.col("to")).alias("to"), "d", F.lit(True).alias("jumped"))
    many = many.join(via, "after", "left").select("call_id", F.when(F.col("jumped"), F.col("to")).otherwise(F.col("after")).alias("to"), (F.coalesce("d", F.lit(0)) + 1).alias("d"), F.lit(None).cast("int").alias("base"))
    many = scratch.keep(many, "many0")
    done, ends, k = tops, tops, 0
    while many.head(1) and done.head(1):
        k += 1
        known = many.join(done.select(F.col("call_id").alias("to"), "level"), "to", "left")
        known = scratch.keep(known.select("call_id", "to", "d", F.coalesce("base", F.col("level") + F.col("d")).alias("base")), f"known{k}")
        done = scratch.keep(known.groupBy("call_id").agg(F.max("base").alias("level"), F.count("base").alias("met"), F.count("*").alias("n")).where("met = n").select("call_id", "level"), f"level{k}")
        many = scratch.keep(known.join(done.select("call_id"), "call_id", "left_anti"), f"many{k}")
        ends = ends.union(done)
    below = jumps.where("not open").join(ends.select(F.col("call_id").alias("to"), "level"), "to")
    return ends.union(below.select("call_id", (F.col("level") + F.col("d")).alias("level")))


_TYPES = {
    "integer": "BIGINT",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "string": "STRING",
    "boolean": "BOOLEAN",
    "null": "VOID",
    "object": "OBJECT.*",
    "array": "ARRAY.*",
}


def meets(value: Column, schema: dict) -> Column:
    """Whether a variant meets a schema; never null. Nested schemas nest in the expression."""
    kind = F.schema_of_variant(value)
    is_a = lambda t: kind.rlike(f"^({_TYPES[t]})$")
    ok = value.isNotNull()
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        allowed = is_a(types[0])
        for t in types[1:]:
            allowed = allowed | is_a(t)
        ok = ok & allowed
    if "enum" in schema:
        ok = ok & F.to_json(value).isin([json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False) for x in schema["enum"]])
    size, number = F.length(F.try_variant_get(value, "$", "string")), F.try_variant_get(value, "$", "double")
    for name, test, good in (("minLength", "string", lambda x: size >= x), ("maxLength", "string", lambda x: size <= x), ("minimum", "number", lambda x: number >= x), ("maximum", "number", lambda x: number <= x)):
        if name in schema:
            ok = ok & (~is_a(test) | good(schema[name]))
    if "items" in schema:
        ok = ok & F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: meets(x, schema["items"])), F.lit(True))
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    known = schema.get("properties", {})
    for name in schema.get("required", []):
        ok = ok & F.coalesce(F.map_contains_key(fields, name), F.lit(True))
    for name, inner in known.items():
        ok = ok & (~F.coalesce(F.map_contains_key(fields, name), F.lit(False)) | meets(fields[name], inner))
    if schema.get("additionalProperties", True) is False:
        ok = ok & F.coalesce(F.forall(F.map_keys(fields), lambda k: k.isin(list(known)) if known else F.lit(False)), F.lit(True))
    return F.coalesce(ok, F.lit(False))


def is_valid(arguments: Column, name: Column, schemas: dict = SCHEMAS) -> Column:
    """Whether a variant of arguments meets the schema of its tool; false for an unknown tool or a null."""
    out = F.lit(False)
    for tool, schema in schemas.items():
        out = F.when(name == tool, meets(arguments, schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row a call: (conv_id, turn, call_id, name, position, n_results, valid, record).

    calls: (conv_id, turn, call_id, name, after, arguments: JSON text); results: (call_id,
    turn, role, text). ``record`` is canonical JSON: keys sorted at every depth, no spaces, no
    null fields of its own; arguments that are no JSON stand there as text, and are invalid.
    Equal rows count once, arguments being equal if their canonical JSON is; calls that share
    an identifier each get all its results; a null identifier matches nothing. ``position``
    counts a conversation's calls in topological order, ties by turn and arguments; calls
    of a cycle come last. A call without result has an empty list. Results without a call
    are in no row. Other columns, whatever their names, are not read; texts are kept whole;
    empty tables give no rows. A conversation is numbered in bands of BAND levels.
    """
    scratch = Scratch(calls.sparkSession, "calls")
    parsed = F.to_json(F.try_parse_json("arguments"))
    calls = calls.select("conv_id", "turn", "call_id", "name", "after", parsed.alias("arguments"), F.when(parsed.isNull(), F.col("arguments")).alias("raw"))
    calls = scratch.keep(calls.distinct(), "calls")
    answers = results.select("call_id", "turn", "role", "text").distinct().groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("found"))
    ordered = scratch.keep(calls.join(levels(calls, scratch), "call_id", "left").withColumn("band", F.floor(F.coalesce("level", F.lit(2**31 - 1)) / BAND)), "levels")
    w = Window.partitionBy("conv_id", "band").orderBy(F.col("level").asc_nulls_last(), "turn", "arguments", "raw")
    ahead = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    past = ordered.groupBy("conv_id", "band").agg(F.count("*").alias("n")).select("conv_id", "band", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("past"))
    ordered = ordered.withColumn("place", F.row_number().over(w)).alias("c").join(past.alias("p"), F.col("c.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("c.band") == F.col("p.band"))).select("c.*", (F.col("c.place") + F.col("p.past")).cast("int").alias("position"))
    value = F.try_parse_json("arguments")
    text = F.try_variant_get(F.try_parse_json(F.to_json(F.struct("raw"))), "$.raw", "variant")
    rows = ordered.join(answers, "call_id", "left").withColumn("valid", is_valid(value, F.col("name"), schemas))
    found = F.coalesce(F.transform("found", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"), r["turn"].alias("turn"))), F.array().cast("array<struct<role:string,text:string,turn:bigint>>"))
    record = F.to_json(F.struct(F.coalesce(value, text).alias("arguments"), "call_id", "name", "position", found.alias("results"), "valid"))
    return rows.select("conv_id", "turn", "call_id", "name", "position", F.coalesce(F.size("found"), F.lit(0)).alias("n_results"), "valid", record.alias("record"))


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls, what follows answers.

    The identifier is conversation and turn; each call but a conversation's first names the
    one before as its dependency. Turns before the first call answer nothing. Rows without
    conversation or turn take no part.
    """
    turns = turns.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Within bands of turns; what the bands before hold comes from one row a band.
    turns = turns.withColumn("band", F.floor(F.col("turn") / BAND)).withColumn("asked", F.when(F.col("role") == "user", F.col("turn")))
    w = Window.partitionBy("conv_id", "band").orderBy("turn")
    ahead = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    past = turns.groupBy("conv_id", "band").agg(F.max("asked").alias("m")).select("conv_id", "band", F.max("m").over(ahead).alias("past"))
    rows = turns.withColumn("now", F.max("asked").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("before", F.max("asked").over(w.rangeBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(past, ["conv_id", "band"]).withColumn("now", F.coalesce("now", "past")).withColumn("before", F.coalesce("before", "past"))
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), F.col(t).cast("string"))
    calls = rows.where("role = 'user'").withColumn("call_id", name("turn")).withColumn("after", F.when(F.col("before").isNotNull(), name("before")))
    arguments = F.struct("after", F.length("text").cast("long").alias("n_chars"), "text")
    calls = calls.select("conv_id", "turn", "call_id", F.when(F.col("after").isNull(), "ask").otherwise("follow_up").alias("name"), "after", F.to_json(arguments).alias("arguments"))
    results = rows.where("role <> 'user' and now is not null").select(name("now").alias("call_id"), "turn", "role", "text")
    return calls, results


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*from_conversations(table(spark, sf_dir, "conversations")))


OP4_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), r AS (
  SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now,
         max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM t
), c AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE WHEN before IS NULL THEN 'ask' ELSE 'follow_up' END AS name,
         CASE WHEN before IS NOT NULL THEN conv_id || ':' || before END AS after, text, length(text) AS n_chars
  FROM r WHERE role = 'user'
), a AS (
  SELECT conv_id || ':' || now AS call_id, count(*) AS n,
         string_agg('{"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '}', ',' ORDER BY turn, role, text) AS found
  FROM r WHERE role <> 'user' AND now IS NOT NULL GROUP BY 1
), p AS (
  SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS position, n_chars BETWEEN 1 AND 4000 AS valid FROM c
)
SELECT p.conv_id, p.turn, p.call_id, p.name, CAST(p.position AS INTEGER) AS position, CAST(coalesce(a.n, 0) AS INTEGER) AS n_results, p.valid,
       '{"arguments":{' || CASE WHEN p.after IS NULL THEN '' ELSE '"after":' || to_json(p.after) || ',' END || '"n_chars":' || p.n_chars || ',"text":' || to_json(p.text)
       || '},"call_id":' || to_json(p.call_id) || ',"name":"' || p.name || '","position":' || p.position || ',"results":[' || coalesce(a.found, '') || '],"valid":' || p.valid || '}' AS record
FROM p LEFT JOIN a USING (call_id)
"""

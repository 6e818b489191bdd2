"""Chat formatting with linked tool calls, in DataFrame operations only.

Calls and results are hash-joined by identifier, calls are levelled topologically by what they depend
on, by pointer doubling, arguments are checked against the tools' schemas, and each exchange is written as canonical JSON:
sorted keys, no blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, counted, is_empty, small_or_shuffled

#: JSON schema types by the head of the type name that Spark gives a variant (fixed values).
TYPES = {"STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object", "VOID": "null"}
#: Tools whose schemas are broadcast at most; those of more are joined by a shuffle.
MOST_TOOLS = 10_000
#: More than any level; weights on a cycle, which would double without end, stop there.
HIGHEST = 1 << 40


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each call and what it waits for, with n, the number of its rows that wait for something."""
    key = ["conv_id", "call_id"]
    one = rows.repartition(*key).groupBy(*key, "on").agg(F.max("w").alias("w"), F.max("b").alias("b"))
    return one.withColumn("n", F.count("on").over(Window.partitionBy(*key)))


def _bounded(weight: Column) -> Column:
    """At most HIGHEST; null stays null."""
    return F.when(weight < HIGHEST, weight).when(weight.isNotNull(), F.lit(HIGHEST))


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """calls (conv_id, call_id, depends_on array<string>) to (conv_id, call_id, level): 0 without dependencies, else one more than the highest.

    Dependencies on calls that are not there are ignored. Calls on a cycle, or behind one, have level null.

    A row (on, w, b) says that a call's level is at least b, and at least w more than that of the call on, if it waits for one. In each
    round calls that wait for nothing are placed, and every row that waits for a placed call, or for one with a single row left, takes
    that call's row instead, with weights added: pointers double. A chain of n calls takes log2(n) rounds; calls that each wait for
    several take a round a level at most. Rows never grow in number, and a round reads only calls that are still open.
    """
    spark, key = calls.sparkSession, ["conv_id", "call_id"]
    nodes = calls.select(*key, F.coalesce("depends_on", F.array().cast("array<string>")).alias("d"))
    known = scratch.save(nodes.select(*key).distinct(), "nodes")
    edges = nodes.select(*key, F.explode("d").alias("on")).distinct().join(known.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi")
    start = known.join(edges, key, "left").select(*key, "on", F.when(F.col("on").isNotNull(), F.lit(1).cast("long")).alias("w"), F.lit(0).cast("long").alias("b"))
    rows, path, turn = scratch.save(_merged(start), "waiting", open=F.sum("n")), scratch.path("steps"), 0
    types = dict(known.dtypes)
    schema = f"conv_id {types['conv_id']}, call_id string, on string, w long, b long"
    while True:
        with scratch.clean():
            rows.where("n <= 1").groupBy(*key).agg(F.max("on").alias("on"), F.max("w").alias("w"), F.max("b").alias("b")).write.parquet(f"{path}/turn={turn}")
        steps = spark.read.schema(schema).parquet(f"{path}/turn={turn}")
        placed = steps.where("on is null")
        if not counted(rows)["open"] or is_empty(placed):
            break
        ends = placed.select("conv_id", F.col("call_id").alias("on"), F.col("b").alias("end"))
        wait = F.col("end").isNull()
        steps = steps.join(ends, ["conv_id", "on"], "left").select(
            "conv_id", F.col("call_id").alias("on"), F.when(wait, F.col("on")).alias("next"), F.when(wait, F.col("w")).alias("more"),
            F.greatest("b", _bounded(F.col("w") + F.col("end"))).alias("least"), F.lit(True).alias("found"),
        )
        taken = rows.where("n > 0").join(steps, ["conv_id", "on"], "left").select(
            *key, F.when(F.col("found"), F.col("next")).otherwise(F.col("on")).alias("on"),
            F.when(F.col("found"), _bounded(F.col("w") + F.col("more"))).otherwise(F.col("w")).alias("w"),
            F.when(F.col("found"), F.greatest("b", _bounded(F.col("w") + F.col("least")))).otherwise(F.col("b")).alias("b"),
        )
        after = scratch.save(_merged(taken), "waiting", open=F.sum("n"))
        scratch.drop(rows)
        rows, turn = after, turn + 1
    placed = spark.read.schema(schema).parquet(f"{path}/*").where("on is null").select(*key, F.col("b").cast("int").alias("level"))
    return known.join(placed, key, "left")


def problems(arguments: Column, parameters: Column) -> Column:
    """Sorted names of the parameters that a JSON object of arguments breaks; `*` if it isn't an object or the tool is unknown.

    parameters: array<struct<key,type,required,maximum,least>>; maximum bounds numbers, least the length of strings.
    """
    given = F.from_json(arguments, "map<string,variant>")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit(False))

    def breaks(p, values):
        v = F.element_at(values, p["key"])
        head = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
        kind = F.lit(None).cast("string")
        for a, b in TYPES.items():
            kind = F.when(head == a, F.lit(b)).otherwise(kind)
        fits = (kind == p["type"]) | ((p["type"] == "number") & (kind == "integer"))
        large = F.coalesce(F.try_variant_get(v, "$", "double") > p["maximum"], F.lit(False))
        short = F.coalesce((kind == "string") & (F.length(F.try_variant_get(v, "$", "string")) < p["least"]), F.lit(False))
        return F.when(v.isNull(), p["required"]).otherwise(~F.coalesce(fits, F.lit(False)) | large | short)

    broken = F.element_at(F.transform(F.array(given), lambda values: F.filter(parameters, lambda p: breaks(p, values))), 1)
    keys = F.array_sort(F.transform(broken, lambda p: p["key"]))
    return F.when(~is_object | parameters.isNull(), F.array(F.lit("*"))).otherwise(keys)


def quoted(text: Column) -> Column:
    """A JSON string; null becomes null."""
    inner = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null where text is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def link_calls(calls: DataFrame, results: DataFrame, tools: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows (conv_id, call_id, level, linked, broken, json), one for each distinct call.

    calls: conv_id, call_id, turn, name, arguments (JSON), depends_on; results: conv_id, call_id, content; tools: name,
    parameters. A call that is repeated counts once, at its first turn; of several results the first in text order counts.
    linked is false and the result null where there is none; results without a call are left out. A null in any column is
    kept as null, but calls without an identifier or a conversation are left out. Of tools of one name the least schema
    counts. Other columns are ignored. Very long arguments and results are kept whole. Without calls the result is empty.
    """
    scratch = scratch or Scratch(calls.sparkSession, "calls")
    one = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select("conv_id", "call_id", "c.*")
    found = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    tools = small_or_shuffled(scratch.save(tools.where("name is not null").groupBy("name").agg(F.min("parameters").alias("parameters")), "tools"), MOST_TOOLS)
    order = levels(one, scratch)
    rows = one.join(found, ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"]).join(tools, "name", "left")
    pieces = F.concat(F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}"))
    return rows.select("conv_id", "call_id", "level", F.coalesce("linked", F.lit(False)).alias("linked"), F.array_join(problems(F.col("arguments"), F.col("parameters")), ",").alias("broken"), pieces.alias("json"))


def calls_of_chat(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain chats as exchanges: an assistant turn is the result of the turn before it, any other turn a call of its role.

    A turn depends on its chat's turn 0, if that is a call. Returns calls, results and tools for link_calls.
    """
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    asked = messages.where(F.coalesce(F.col("role") != "assistant", F.lit(True)))
    arguments = F.to_json(F.struct(F.col("text"), F.length("text").alias("size")))
    root = F.concat(F.col("conv_id").cast("string"), F.lit(":0"))
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.col("role").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") > 0, F.array(root)).alias("depends_on"))
    results = messages.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    rule = "array(named_struct('key', 'size', 'type', 'integer', 'required', true, 'maximum', {}, 'least', 0), named_struct('key', 'text', 'type', 'string', 'required', true, 'maximum', null, 'least', 1))"
    tools = messages.sparkSession.sql(f"select 'user' name, {rule.format('400.0D')} parameters union all select 'system', {rule.format('100.0D')}")
    return calls, results, tools

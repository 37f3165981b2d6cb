"""Tool-call linking with DataFrame functions only.

Calls and results are hash-joined by (conv_id, call_id). A call may come after another (after_id); its level is the number of
calls before it, found by doubling: each round a call takes over what its ancestor 1, 2, 4, ... steps up has found, so a chain of n calls
takes log2(n) joins and no conversation is collected. Arguments are checked against a table of schemas, one row a field. The
message is canonical JSON: keys in order, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import saved

ROUNDS = 40


def quoted(text: Column) -> Column:
    """A string as a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def canonical(value: Column) -> Column:
    """A variant as JSON, whole numbers without fraction or exponent however they were written."""
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(F.coalesce(F.to_json(value), F.lit("null")))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, after_id); level is null for calls on or behind a cycle.

    A call whose after_id is null or isn't a call of the conversation has level 0.
    """
    ids = calls.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("there"))
    at = calls.select("conv_id", "call_id", F.col("after_id").alias("up")).join(ids, ["conv_id", "up"], "left")
    at = saved(at.select("conv_id", "call_id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("level")))
    size = at.count()
    for round_ in range(ROUNDS):
        if not at.filter("up is not null").limit(1).count() or 1 << round_ > 2 * size:
            break
        above = at.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        at = saved(at.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
    return at.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call: conv_id, call_id, name, level, linked, valid, message.

    calls: conv_id, call_id, after_id, name, arguments (JSON object as text); of repeated ids the smallest (name, arguments)
    counts. results: conv_id, call_id, content; of several the smallest content counts, a call without one has linked false. schemas:
    name, field, kind (a JSON type: STRING, BIGINT, DOUBLE, BOOLEAN), required. valid is false where the name has no schema, the
    arguments are no JSON object, a required field is missing or null, a field isn't in the schema or is of another kind (a whole
    number passes as DOUBLE). (level, call_id) orders a conversation's calls
    topologically; level is null in cycles. Rows with
    a null conv_id or call_id are left out. Empty tables give empty results.
    """
    calls = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("name", "arguments", "after_id")).alias("c")).select("conv_id", "call_id", "c.*")
    results = results.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    fields = schemas.groupBy("name").agg(F.map_from_entries(F.collect_set(F.struct("field", "kind"))).alias("kinds"), F.collect_set(F.when(F.col("required"), F.col("field"))).alias("needed"))
    # in brackets, as the parser passes over text behind a value; null for repeated keys
    given = F.try_parse_json(F.concat(F.lit("["), "arguments", F.lit("]"))).cast("array<variant>")
    given = F.when((F.size(given) == 1) & F.schema_of_variant(given[0]).startswith("OBJECT"), given[0].cast("map<string,variant>"))
    rows = calls.join(results, ["conv_id", "call_id"], "left").join(levels(calls), ["conv_id", "call_id"]).join(fields, "name", "left").withColumn("given", given)

    def fits(key: Column, value: Column) -> Column:
        kind, want = F.schema_of_variant(value), F.element_at("kinds", key)
        return F.coalesce((kind == want) | ((want == "DOUBLE") & (kind.startswith("DECIMAL") | (kind == "BIGINT"))), F.lit(False))

    valid = (
        F.col("kinds").isNotNull() & F.col("given").isNotNull()
        & F.forall("needed", lambda f: F.coalesce(F.array_contains(F.map_keys("given"), f) & (F.schema_of_variant(F.element_at("given", f)) != "VOID"), F.lit(False)))
        & F.forall(F.map_entries("given"), lambda e: fits(e["key"], e["value"]))
    )
    pairs = F.transform(F.array_sort(F.map_keys("given")), lambda k: F.concat(quoted(k), F.lit(":"), canonical(F.element_at("given", k))))
    body = F.when(F.col("given").isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
    message = F.concat(
        F.lit('{"arguments":'), body, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.when(F.col("content").isNull(), F.lit("null")).otherwise(quoted(F.col("content"))), F.lit("}"),
    )
    return rows.select("conv_id", "call_id", "name", "level", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce(valid, F.lit(False)).alias("valid"), message.alias("message"))


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas that a table of turns (conv_id, turn, role, text) stands for.

    A user turn is a call: even turns `search` with {"query", "turn"}, odd ones `lookup` with {"key", "exact"}; it comes after the turn of half its
    number. An assistant turn is the result of the turn before it.
    """
    turn = F.col("turn")
    text = F.coalesce("text", F.lit(""))
    ident = lambda c: F.concat(F.lit("t"), c.cast("string"))
    users = conversations.filter("role = 'user' and turn is not null")
    arguments = F.when(turn % 2 == 0, F.concat(F.lit('{"turn": '), turn.cast("string"), F.lit(', "query": '), quoted(text), F.lit("}"))).otherwise(
        F.concat(F.lit('{"key": '), quoted(text), F.when(F.length(text) % 2 == 0, F.lit(', "exact": true}')).otherwise(F.lit(', "exact": "yes"}')))
    )
    half = F.floor(turn / 2).cast("long")
    calls = users.select("conv_id", ident(turn).alias("call_id"), F.when(half < turn, ident(half)).alias("after_id"), F.when(turn % 2 == 0, "search").otherwise("lookup").alias("name"), arguments.alias("arguments"))
    results = conversations.filter("role = 'assistant' and turn is not null").select("conv_id", ident(turn - 1).alias("call_id"), text.alias("content"))
    schemas = conversations.sparkSession.createDataFrame(
        [("search", "query", "STRING", True), ("search", "turn", "BIGINT", True), ("lookup", "key", "STRING", True), ("lookup", "exact", "BOOLEAN", False)], "name string, field string, kind string, required boolean"
    )
    return calls, results, schemas

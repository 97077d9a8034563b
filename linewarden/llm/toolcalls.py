"""Tool-call linking: results joined to calls by identifier, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on (conversation, identifier).  A call may name one earlier call that it
builds on; pointer doubling gives each call its level in that order, in a number of rounds that grows with the
logarithm of the longest chain, and finds cycles.  Arguments are checked against a table of schemas, and
serialised with sorted keys and no blanks.  Built-in functions only; no conversation is gathered in one place.

Defined results: a call without a result is ``missing``, a result without a call ``orphan``.  Of several
calls or results with one identifier the first by turn counts (ties: the least text, then the least tool and earlier
call), others are ``repeated``; rows that are alike in all columns count once.  A NULL identifier or conversation
never links: such calls are ``missing``, such results ``orphan``.  A call that builds on an unknown call starts a chain; calls on a cycle, or
behind one, have no level.  NULL or broken arguments are no object and fail.  Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.session import work_folder

#: What values of a declared type look like in JSON; a string may be anything.
TYPES = {"integer": r"^-?(0|[1-9][0-9]*)$", "number": r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][-+]?[0-9]+)?$", "boolean": "^(true|false)$"}
#: Longest chain as a power of two.
MOST_ROUNDS = 48
BROADCAST_SCHEMAS = 10_000


def _json(value: Column) -> Column:
    """A JSON string literal."""
    text = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def _first(df: DataFrame, *ties: str) -> DataFrame:
    """Rows with ``first``: whether a row is the first of its identifier, by turn and then by ``ties``."""
    key = F.struct("turn", *ties)
    least = df.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(key).alias("least"))
    return df.join(least, ["conv_id", "call_id"], "left").withColumn("first", F.coalesce(key == F.col("least"), F.lit(False)))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for a call that builds on none, else one more than that call's; NULL on cycles."""
    spark = calls.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        folder = work_folder(spark, "call-levels")
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    known = calls.select("conv_id", "call_id", "after")
    there = known.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    at = stored(
        known.join(there, ["conv_id", "after"], "left").select(
            "conv_id",
            "call_id",
            F.when(F.col("there"), F.col("after")).alias("up"),
            F.when(F.col("there"), 1).otherwise(0).alias("level"),
        )
    )
    for _ in range(MOST_ROUNDS):
        if at.where("up IS NOT NULL").isEmpty():
            break
        higher = at.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("level2"))
        open_calls = at.where("up IS NOT NULL").join(higher, ["conv_id", "up"], "left")
        moved = open_calls.select("conv_id", "call_id", F.col("up2").alias("up"), (F.col("level") + F.col("level2")).cast("int").alias("level"))
        new = stored(at.where("up IS NULL").union(moved))
        if new.where("up IS NOT NULL").isEmpty():
            at = new
            break
        done = new.where("up IS NULL").count() == at.where("up IS NULL").count()
        at = new
        if done:  # no call reached the start of its chain in a round: the rest are cycles
            break
    return at.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def checked_arguments(arguments: Column, fields: Column) -> tuple[Column, Column]:
    """(errors, canonical JSON) of an arguments text against an array of (field, type, required)."""
    parsed = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    value = F.transform_values(parsed, lambda _, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null")))
    shown = F.transform_values(parsed, lambda _, v: F.to_json(v))
    names = F.array_sort(F.map_keys(parsed))
    required = F.transform(F.filter(fields, lambda f: f["required"]), lambda f: f["field"])
    missing = F.transform(F.array_except(required, names), lambda n: F.concat(F.lit("missing "), n))
    unknown = F.transform(
        F.array_except(names, F.transform(fields, lambda f: f["field"])), lambda n: F.concat(F.lit("unknown "), n)
    )

    def wrong(f: Column) -> Column:
        text, raw = F.element_at(value, f["field"]), F.element_at(shown, f["field"])
        quoted = raw.startswith('"')
        fits = F.when(f["type"] == "string", quoted)
        for name, pattern in TYPES.items():
            fits = fits.when(f["type"] == name, ~quoted & text.rlike(pattern))
        return text.isNotNull() & ~F.coalesce(fits, F.lit(True))

    mistyped = F.transform(F.filter(fields, wrong), lambda f: F.concat(F.lit("type "), f["field"]))
    errors = F.array_sort(F.concat(missing, unknown, mistyped))
    errors = F.when(parsed.isNull(), F.array(F.lit("no object"))).when(fields.isNull(), F.array(F.lit("unknown tool"))).otherwise(errors)
    body = F.array_join(F.transform(names, lambda n: F.concat(_json(n), F.lit(":"), F.element_at(shown, n))), ",")
    return errors, F.when(parsed.isNotNull(), F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.lit("null"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result that no call takes.

    calls: conv_id, turn, call_id, after, tool, arguments; results: conv_id, turn, call_id, content;
    schemas: tool, field, type, required.  Gives conv_id, turn, call_id, level, status, errors, json.
    """
    calls = calls.select("conv_id", "turn", "call_id", "after", "tool", "arguments")
    results = results.select("conv_id", "turn", "call_id", "content")
    fields = schemas.groupBy("tool").agg(F.array_sort(F.collect_set(F.struct("field", "type", "required"))).alias("fields"))
    if schemas.count() <= BROADCAST_SCHEMAS:
        fields = F.broadcast(fields)
    numbered = _first(calls.join(fields, "tool", "left"), "arguments", "tool", "after")
    heads = numbered.where("first").dropDuplicates(["conv_id", "call_id"])
    answers = _first(results, "content")
    taken = answers.where("first").dropDuplicates(["conv_id", "call_id"])
    linked = heads.join(
        taken.select("conv_id", "call_id", "content", F.col("turn").alias("result_turn"), F.lit(True).alias("answered")),
        ["conv_id", "call_id"],
        "left",
    ).join(levels(heads), ["conv_id", "call_id"], "left")
    errors, arguments = checked_arguments(F.col("arguments"), F.col("fields"))
    pieces = [
        ("arguments", arguments),
        ("id", _json(F.col("call_id"))),
        ("name", _json(F.col("tool"))),
        ("result", _json(F.col("content"))),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in pieces]), F.lit("}"))
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("answered"), "linked").otherwise("missing")
    good = linked.select("conv_id", "turn", "call_id", "level", status.alias("status"), F.array_join(errors, ";").alias("errors"), text.alias("json"))
    empty = [F.lit(None).cast("int").alias("level")]

    def lone(df: DataFrame, status: Column) -> DataFrame:
        return df.select("conv_id", "turn", "call_id", *empty, status.alias("status"), F.lit("").alias("errors"), F.lit("null").alias("json"))

    marked = answers.join(heads.select("conv_id", "call_id", F.lit(True).alias("known")), ["conv_id", "call_id"], "left")
    orphans = lone(marked.where("known IS NULL"), F.lit("orphan"))
    # Of equal first rows one counts, the others are repeated; NULL identifiers are calls without a link.
    extra_calls = lone(numbered.where("call_id IS NULL OR NOT first"), F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "missing").otherwise("repeated"))
    extra_results = lone(marked.where("known AND NOT first"), F.lit("repeated"))
    return good.unionByName(orphans).unionByName(extra_calls).unionByName(extra_results)


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a table of plain turns implies: every assistant turn calls a tool with its text.

    The turn after it is the result; a turn without a role (NULL) is not the assistant's.  A call builds on the assistant's turn before, but for every third.
    """
    turn, conv = F.col("turn"), F.col("conv_id")

    def name(at: Column) -> Column:
        return F.concat(F.lit("call_"), conv, F.lit("_"), at)

    kind = F.pmod(conv + turn, F.lit(3))
    arguments = (
        F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("query"), turn.alias("limit"))))
        .when(kind == 1, F.to_json(F.struct(F.col("text").alias("text"), turn.cast("string").alias("limit"))))
        .otherwise(F.to_json(F.struct((turn % 2 == 0).alias("strict"), F.col("text").alias("text"))))
    )
    calls = conversations.where("role = 'assistant'").select(
        "conv_id",
        "turn",
        name(turn).alias("call_id"),
        F.when((turn > 2) & (F.pmod(conv + turn, F.lit(9)) != 0), name(turn - 2)).alias("after"),
        F.element_at(F.array(F.lit("search"), F.lit("count"), F.lit("check")), (kind + 1).cast("int")).alias("tool"),
        arguments.alias("arguments"),
    )
    results = conversations.where("NOT (role <=> 'assistant')").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


#: The tools of ``calls_of_conversations``: tool, field, type, required.
SCHEMAS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("count", "text", "string", True),
    ("count", "limit", "integer", False),
    ("check", "text", "string", True),
    ("check", "strict", "boolean", True),
)

"""Expressions that find JSON pieces in free text.

Nesting is beyond a regex, so the text is cut into few tokens (quotes, brackets, escape pairs, runs of
everything else) and one ``aggregate`` walks over them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_array(text: Column) -> Column:
    """From the first ``[`` to its partner; to the end if it has none; the whole text if there is no ``[``."""
    tail = F.regexp_extract(text, r"(?s)\[.*", 0)
    tokens = F.regexp_extract_all(tail, F.lit(r'(?s)\\.|["\[\]\\]|[^"\\\[\]]+'), F.lit(0))
    state = F.struct(
        F.lit(0).alias("length"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("closed")
    )

    def step(s, token):
        depth = (
            F.when(~s["quoted"] & (token == "["), s["depth"] + 1)
            .when(~s["quoted"] & (token == "]"), s["depth"] - 1)
            .otherwise(s["depth"])
        )
        return F.when(s["closed"], s).otherwise(
            F.struct(
                (s["length"] + F.char_length(token)).alias("length"),
                depth.alias("depth"),
                F.when(token == '"', ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
                (~s["quoted"] & (token == "]") & (s["depth"] == 1)).alias("closed"),
            )
        )

    length = F.aggregate(tokens, state, step, lambda s: s["length"])
    return F.when(tail == "", text).otherwise(F.left(tail, length))


def object_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}\\]|[^"\\{}]+'), F.lit(0))


def object_spans(tokens: Column) -> Column:
    """Every outermost ``{...}`` as ``(start, length)`` in tokens; an object that is never closed runs to the end."""
    state = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("start"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("quoted"),
        F.array().cast("array<struct<start:int,length:int>>").alias("found"),
    )

    def piece(start, end):
        return F.struct(start.alias("start"), (end - start + 1).alias("length"))

    def step(s, token):
        at = s["at"] + 1
        outside = s["depth"] == 0
        # outside of objects a backslash means nothing, so "\{" opens one as well
        opens = outside & F.endswith(token, F.lit("{"))
        live = ~outside & ~s["quoted"]
        closes = live & (token == "}") & (s["depth"] == 1)
        depth = (
            F.when(opens, F.lit(1))
            .when(live & (token == "{"), s["depth"] + 1)
            .when(live & (token == "}"), s["depth"] - 1)
            .otherwise(s["depth"])
        )
        return F.struct(
            at.alias("at"),
            F.when(opens, at).otherwise(s["start"]).alias("start"),
            depth.alias("depth"),
            F.when(outside, False).when(token == '"', ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            F.when(closes, F.array_append(s["found"], piece(s["start"], at))).otherwise(s["found"]).alias("found"),
        )

    def finish(s):
        return F.when(s["depth"] > 0, F.array_append(s["found"], piece(s["start"], s["at"]))).otherwise(s["found"])

    return F.aggregate(tokens, state, step, finish)


def object_texts(tokens: Column, spans: Column) -> Column:
    """The objects as texts.  Both columns must be plain ones: a lambda evaluates what it encloses once an element."""
    rest = lambda p: F.array_join(F.slice(tokens, p["start"] + 1, p["length"] - 1), "")
    return F.transform(spans, lambda p: F.concat(F.lit("{"), rest(p)))


def objects(text: Column) -> Column:
    """Every outermost ``{...}`` of a short text, in one expression."""
    tokens = object_tokens(text)
    return object_texts(tokens, object_spans(tokens))


def field(obj: Column, name: str) -> Column:
    """Text value of ``name`` in an almost-JSON object: key quoted or not, ``:`` or ``=``; NULL if none or empty.

    A quote after a backslash belongs to the value, unless no other quote follows to close it.
    """
    value = r'"([^"]*+(?:(?<=\\)"[^"]*+)*+(?=")|(?s:.*)(?="))'
    raw = F.regexp_extract(obj, rf'(?U)"?{name}"?\s*[:=]\s*{value}', 1)
    plain = F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    # a filter names its value once, where nullif would have it evaluated twice
    return F.get(F.filter(F.array(plain), lambda v: v != ""), 0)


def unsigned32(text: Column) -> Column:
    number = text.try_cast("bigint")
    return F.when(number.between(0, 4294967295), number)

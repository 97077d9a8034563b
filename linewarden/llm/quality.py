"""Quality rules: a table of thresholds compiled into one projection of ratios.

Every rule is a named ratio with a bound; the table is turned into columns that Spark evaluates in one pass
over the texts, without user functions, joins or shuffles.

Defined results: NULL and blank texts have no words, so all counts are 0 and the document fails the base
rules.  Ratios of empty sets are 0.  Repeated rows are judged each for itself, very long texts whole.  Columns
of the input that are named like a result column are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.columns import settled

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is for that it with as was be on by this are from or an at "
    "der die das und den von zu mit ist dem ein eine nicht im auf für sich "
    "le la les de des un une et en que qui pour dans du est pas au sur par "
    "el los las y del se con no su lo una es como más"
).split()


class Threshold(NamedTuple):
    """A document fails if it has at least ``words`` words and the ratio is out of bounds."""

    name: str
    ratio: str
    low: float
    high: float
    words: int = 0


#: Ratios are explained in ``ratios``.  A text fails by one line of the table.
THRESHOLDS = (
    Threshold("mean_word_length", "word_length", 1.5, 20.0, 20),
    Threshold("symbols_to_words", "symbol", 0.0, 0.3),
    Threshold("stop_words", "stop", 0.04, 1.0, 60),
    Threshold("repeated_lines", "dup_line", 0.0, 0.5),
    Threshold("stuttered_words", "stutter", 0.0, 0.3),
)


def _rolled(words: Column) -> Column:
    """A 64-bit hash of every window of eight words."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))


def _covered(grams: Column) -> Column:
    """Words inside windows that occur twice or more: sort the windows, keep equal neighbours, join their spans."""
    ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.transform(
        F.array(ranked),
        lambda a: F.aggregate(
            F.array_sort(
                F.transform(
                    F.filter(
                        a,
                        lambda x, k: ((k > 0) & (F.get(a, k - 1)["g"] == x["g"]))
                        | F.coalesce(F.get(a, k + 1)["g"] == x["g"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(
                (p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n")
            ),
            lambda acc: acc["n"],
        ),
    )[0]


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop and n_stutter."""
    whole = F.coalesce(F.col(text), F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_stutter")
    kept = [c for c in docs.columns if c not in names]
    words = F.array_remove(F.split(whole, SPACE), "")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = settled(docs.select(*kept), __words=words, __lines=lines)
    n = F.size("__words")
    grams = F.when(n > WINDOW, _rolled(F.col("__words")))
    out = settled(out, __grams=grams)
    repeated = F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), _covered(F.col("__grams"))).otherwise(0)
    stop = F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS)))
    stutter = F.size(F.filter("__words", lambda w, i: (i > 0) & (F.get(F.col("__words"), i - 1) == w)))
    return settled(
        out,
        n_words=n.cast("long"),
        word_chars=F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
        n_symbols=(F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        n_repeat_words=repeated.cast("long"),
        n_lines=F.size("__lines").cast("long"),
        n_stop=stop.cast("long"),
        n_stutter=stutter.cast("long"),
    ).drop("__words", "__lines", "__grams")


def ratios() -> dict[str, Column]:
    """The ratios that thresholds may name, from the counts; 0 where nothing is counted."""

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "word_length": per("word_chars", "n_words"),
        "symbol": per("n_symbols", "n_words"),
        "stop": per("n_stop", "n_words"),
        "dup_line": per("n_dup_lines", "n_lines"),
        "stutter": per("n_stutter", "n_words"),
    }


def failures(table: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The names of the thresholds that a counted document misses, as one expression."""
    known = ratios()
    missed = [
        F.when((F.col("n_words") >= t.words) & ~known[t.ratio].between(t.low, t.high), F.lit(t.name)) for t in table
    ]
    return F.array_compact(F.array(*missed))


def judge(docs: DataFrame, text: str = "text", table: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The counted input with ``base_failed``, ``failed`` (names of missed thresholds) and ``kept``."""
    counted = counts(docs.drop("base_failed", "failed", "kept"), text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = counted.withColumn("base_failed", base).withColumn("failed", failures(table))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))

"""Column expressions on paths, file text and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewarden.sources.rules import EXTENSIONS, OVERRIDES

# Unicode classes, and "\n" as the only line terminator, for every pattern of the library.
DIALECT = "(?Ud)"
TRIM_PATTERN = r"(?U)^\s+|\s+\z"


def sql_text(text: str) -> str:
    """A Python string as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; '' for none and for dot-files such as ``.c``."""
    return F.regexp_extract(path, r"[^/][.]([^./]+)\z", 1)


def detect_language(path: Column) -> Column:
    """Language label by (case-sensitive) extension, else NULL."""
    return F.element_at(F.expr(f"map({', '.join(map(sql_text, sum(EXTENSIONS.items(), ())))})"), extension(path))


def override_language(name: str) -> str:
    if name not in OVERRIDES:
        raise ValueError(f"unknown language {name!r}; expected one of {sorted(OVERRIDES)}")
    return OVERRIDES[name]


def split_lines(content: Column) -> Column:
    """Lines of a text as an array: split at LF, a CR before the LF goes too, no last empty line."""
    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    text = F.when(F.endswith(content, F.lit("\n")), F.left(text, F.char_length(text) - 1)).otherwise(text)
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def fold_case_sql(text: str) -> str:
    """Lower case; the long s has no other lower case but matches "s" where case is ignored."""
    return f"lower(replace({text}, 'ſ', 's'))"


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, TRIM_PATTERN, "")

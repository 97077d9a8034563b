"""Rule catalogues: the built-in rules, user rules and the check that every pattern compiles."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from linewarden.functions.ambiguity import exponential
from linewarden.functions.text import DIALECT
from linewarden.sources.rules import LANGUAGES, RULES

RULE_SCHEMA = (
    "lang string, rule_ord int, name string, regex string, severity string, description string, cwe string"
)
REJECTED_SCHEMA = "lang string, name string, regex string, reason string"

# Constructs that Java accepts but the rule language does not have.
_UNSUPPORTED = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<)")


@dataclass(frozen=True)
class Rule:
    lang: str
    name: str
    regex: str
    severity: str
    description: str
    cwe: str | None = None
    needles: tuple[str, ...] = ()
    rule_ord: int = 0

    @property
    def pattern(self) -> str:
        """The regex with the dialect flags of the library."""
        return DIALECT + self.regex


@dataclass(frozen=True)
class Catalogue:
    rules: tuple[Rule, ...]
    rejected: tuple[tuple[str, str, str, str], ...] = field(default=())

    @classmethod
    def builtin(cls) -> Catalogue:
        return cls(
            tuple(
                Rule(lang, name, regex, severity, text, f"CWE-{cwe}" if cwe else None, needles, i)
                for lang, rows in RULES.items()
                for i, (name, severity, cwe, regex, needles, text) in enumerate(rows, 1)
            )
        )

    def of(self, lang: str) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.lang == lang)

    def with_rules(self, spark: SparkSession, user_rules: Iterable[Rule | Mapping[str, str]]) -> Catalogue:
        """Append rules after the existing ones of their language.

        A rule whose pattern does not compile is set aside in ``rejected``; a known (language, name)
        or an unknown language is an error.
        """
        rules, rejected = list(self.rules), list(self.rejected)
        seen = {(r.lang, r.name) for r in rules}
        size = {lang: len(self.of(lang)) for lang in LANGUAGES}
        for raw in user_rules:
            rule = raw if isinstance(raw, Rule) else Rule(**raw)
            if rule.lang not in LANGUAGES:
                raise ValueError(f"unknown language {rule.lang!r}; expected one of {LANGUAGES}")
            if (rule.lang, rule.name) in seen:
                raise ValueError(f"duplicate rule {rule.name!r} for {rule.lang}")
            seen.add((rule.lang, rule.name))
            reason = pattern_error(spark, rule.regex)
            if reason:
                rejected.append((rule.lang, rule.name, rule.regex, reason))
                continue
            size[rule.lang] += 1
            rules.append(
                Rule(rule.lang, rule.name, rule.regex, rule.severity, rule.description, rule.cwe,
                     tuple(n.lower() for n in rule.needles), size[rule.lang])
            )
        return Catalogue(tuple(rules), tuple(rejected))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r.lang, r.rule_ord, r.name, r.regex, r.severity, r.description, r.cwe) for r in self.rules]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    def rejected_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rejected), REJECTED_SCHEMA)


def pattern_error(spark: SparkSession, regex: str) -> str | None:
    """Why a pattern cannot be used, or None."""
    if _UNSUPPORTED.search(regex):
        return "look-around and back-references are not supported"
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(DIALECT + regex)
    except Exception as error:  # py4j wraps PatternSyntaxException
        return str(error).strip().splitlines()[-1] or "pattern does not compile"
    return exponential(regex)

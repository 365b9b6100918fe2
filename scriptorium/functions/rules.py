"""Ordered first-match rule lists as Spark expressions.

A rule list is ``[(pattern, value), ...]`` where the *list position* decides
which rule wins when several match (not the position of the match in the
text).  The list is folded into one array literal so the lookup is a single
projection inside whole-stage codegen: no join, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from scriptorium.functions import fixed_values as fv


def country_rules() -> list[tuple[str, str]]:
    """(lower-case substring, country) in priority order: countries, aliases,
    US institutions, then two state patterns per state."""
    rules: list[tuple[str, str]] = [(c.lower(), c) for c in fv.COUNTRIES]
    rules += [(alias.lower(), country) for alias, country in fv.COUNTRY_ALIASES]
    rules += [(inst.lower(), fv.UNITED_STATES) for inst in fv.US_INSTITUTIONS]
    for state in fv.US_STATES:
        s = state.lower()
        rules += [(f", {s} ", fv.UNITED_STATES), (f", {s}.", fv.UNITED_STATES)]
    return rules


def rules_literal(rules: Sequence[tuple[str, str]]) -> Column:
    """array<struct<pat:string, val:string>> literal, list order preserved; one
    parsed expression, since building it column by column takes seconds."""
    def text(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ", ".join(f"named_struct('pat', {text(p)}, 'val', {text(v)})" for p, v in rules) + ")")


def first_substring_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Value of the first rule whose pattern is a substring of ``text``
    (patterns are compared as given; lower-case the text beforehand if the
    rules are case-insensitive).  Null when nothing matches."""
    hits = F.filter(rules_literal(rules), lambda r: F.contains(text, r["pat"]))
    return F.get(hits, 0)["val"]

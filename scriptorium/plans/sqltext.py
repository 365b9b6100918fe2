"""Helpers to write literal lists into oracle SQL text."""

from __future__ import annotations


def q(s) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def values_rows(rows) -> str:
    out = []
    for row in rows:
        out.append("(" + ", ".join(q(v) if isinstance(v, str) or v is None else repr(v) for v in row) + ")")
    return ", ".join(out)

"""Affiliation → country.

Plan shape at scale: the affiliation column is first reduced to its distinct
values with counts (partial aggregation on the map side, so a value that holds
a third of all rows costs one hash-map entry per task, not a hot shuffle key);
only distinct strings meet the 354-rule lookup; the per-country totals are a
second, tiny aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.rules import country_rules, first_substring_match


def only_no_affiliation(col: Column) -> Column:
    """True when the field is nothing but repeated ``No Affiliation``
    (optionally ``;`` and at most one whitespace between repeats)."""
    return col.rlike("^" + fv.NO_AFFILIATION_ONLY + r"\z")


def keep_affiliation(col: Column) -> Column:
    """F1 filter; a null field yields null and is dropped by ``where``."""
    return ~only_no_affiliation(col)


def country_of(col: Column, mode: str = "reference") -> Column:
    """First-match country.  ``No Affiliation`` → null; no rule → Unknown.

    ``mode="reference"`` keeps plain case-insensitive substring tests in list
    order (so `Nigeria` gives Niger, `campus` gives United States).
    ``mode="word_boundary_longest"`` is the corrected variant: patterns must
    stand as whole words and the longest matching pattern wins within a tier.
    """
    low = F.lower(col)
    if mode == "reference":
        hit = first_substring_match(low, country_rules())
    elif mode == "word_boundary_longest":
        hit = _word_boundary_country(low)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return (F.when(col == F.lit(fv.NO_AFFILIATION), F.lit(None).cast("string"))
            .otherwise(F.coalesce(hit, F.lit(fv.UNKNOWN_COUNTRY))))


def _word_boundary_country(low: Column) -> Column:
    import re

    tiers = [
        [(c.lower(), c) for c in fv.COUNTRIES],
        [(a.lower(), c) for a, c in fv.COUNTRY_ALIASES],
        [(i.lower(), fv.UNITED_STATES) for i in fv.US_INSTITUTIONS],
    ]
    out = None
    for tier in tiers:
        ordered = sorted(tier, key=lambda pc: -len(pc[0]))
        branch = None
        for pat, val in ordered:
            cond = low.rlike(r"(?<![\p{L}\p{N}])" + re.escape(pat) + r"(?![\p{L}\p{N}])")
            branch = F.when(cond, F.lit(val)) if branch is None else branch.when(cond, F.lit(val))
        out = branch if out is None else F.coalesce(out, branch)
    states = "|".join(s.lower() for s in fv.US_STATES)
    state_hit = F.when(low.rlike(r", (?:" + states + r")[ .]"), F.lit(fv.UNITED_STATES))
    return F.coalesce(out, state_hit)


def label_countries(df: DataFrame, col: str = "Affiliations", out: str = "Country",
                    mode: str = "reference") -> DataFrame:
    """Row-level labelling (F1 then P7): keeps every surviving row."""
    return df.where(keep_affiliation(F.col(col))).withColumn(out, country_of(F.col(col), mode))


def country_frequency(df: DataFrame, col: str = "Affiliations", by: list[str] | None = None,
                      mode: str = "reference") -> DataFrame:
    """A1 + O1: ``Country, Count`` (plus ``by`` keys), nulls left out,
    descending count, ties by name."""
    by = list(by or [])
    distinct_counts = (df.where(keep_affiliation(F.col(col)))
                       .groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n")))
    labelled = distinct_counts.select(*by, country_of(F.col(col), mode).alias("Country"), "_n")
    return (labelled.where(F.col("Country").isNotNull())
            .groupBy(*by, "Country").agg(F.sum("_n").alias("Count"))
            .orderBy(*by, F.desc("Count"), "Country"))

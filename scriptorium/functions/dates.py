"""Publication dates.

A date string is tried against an explicit list of formats, row by row; a
value no format accepts becomes null (the reference coerces bad dates to
null, but infers one format from the first value and nulls the rest).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# --- FIXED VALUES: accepted date formats, tried in order ----------------------
DATE_FORMATS = ["yyyy-MM-dd", "yyyy MMM", "MM/dd/yyyy", "yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                "yyyy MMM d", "yyyy/MM/dd", "yyyy-MM", "MMM yyyy", "yyyy-M-d"]


def parse_date(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(col.cast("string"), F.lit(f)) for f in formats])


def pub_year(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Year of the first format that parses, else null."""
    return F.year(parse_date(col, formats))


def decade(year: Column) -> Column:
    """(year // 10) * 10."""
    return (F.floor(year / 10) * 10).cast("int")


def label_or_decade(label: Column | None, year: Column) -> Column:
    """P10: a given label, else the decade; as a string (``"2010"``, not
    ``"2010.0"``)."""
    dec = decade(year).cast("string")
    return dec if label is None else F.coalesce(label.cast("string"), dec)


def in_year_range(year: Column, lo: int, hi: int) -> Column:
    """inclusive range; null years drop out."""
    return year.between(lo, hi)

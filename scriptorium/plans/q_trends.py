"""Registered queries: dates, years, decades, multi-valued field counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.dates import in_year_range, pub_year
from scriptorium.operators.trends import burst_states, bursts, part_frequency, records_per_decade, records_per_year
from scriptorium.plans.standins import (AFFILIATION_TEMPLATES, SQL_PUBLICATION_DATES, SQL_YEAR,
                                        affiliations, publication_dates)
from scriptorium.plans.sqltext import str_list
from scriptorium.session import read_table

# The stand-in publication dates span 1995-2001, so the fixture range is
# moved into that span; the reference's own constants are fixed_values.YEAR_RANGE.
FIXTURE_YEARS = (1996, 1998)


def pubs(spark, sf_dir):
    return publication_dates(read_table(spark, sf_dir, "orders"))


def records_per_year_q(spark, sf_dir):
    return records_per_year(pubs(spark, sf_dir), "Publication_Date")


def records_per_decade_q(spark, sf_dir):
    return records_per_decade(pubs(spark, sf_dir), "Publication_Date")


def year_range_filter_q(spark, sf_dir):
    lo, hi = FIXTURE_YEARS
    df = pubs(spark, sf_dir).withColumn("Year", pub_year(F.col("Publication_Date")))
    return df.where(in_year_range(F.col("Year"), lo, hi))


def institution_frequency_q(spark, sf_dir):
    meta = affiliations(read_table(spark, sf_dir, "customer"))
    return part_frequency(meta, "Affiliations", r";\s*", "institution")


# the fields whose bursts are sought are the nations of the records' customers, by month
BURST_FACTOR, BURST_RISE = 1.5, 0.5


def field_months(spark, sf_dir):
    """One row a record: its field and the month of its date."""
    orders, customer = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_nationkey").cast("int").alias("field"), month.alias("month"))


def field_bursts_q(spark, sf_dir):
    found = bursts(burst_states(field_months(spark, sf_dir), "field", "month", BURST_FACTOR, BURST_RISE))
    return found.withColumnRenamed("key", "field").orderBy("field", "first_period")


def field_burst_states_q(spark, sf_dir):
    states = burst_states(field_months(spark, sf_dir), "field", "month", BURST_FACTOR, BURST_RISE)
    return states.select(F.col("key").alias("field"), "period", "hits", "total", "state", F.round("gain", 4).alias("gain"))


_BURST_STATES = f"""WITH RECURSIVE records AS (
  SELECT CAST(c_nationkey AS INTEGER) AS field, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS period
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderdate IS NOT NULL),
periods AS (SELECT period, count(*) AS total, row_number() OVER (ORDER BY period) AS i FROM records GROUP BY period),
whole AS (SELECT sum(total) AS d, count(*) AS n, {BURST_RISE} * ln(count(*)) AS up FROM periods),
shares AS (SELECT field, count(*) / any_value(d) AS p0, least(count(*) / any_value(d) * {BURST_FACTOR}, (count(*) / any_value(d) + 1) / 2) AS p1
  FROM records, whole WHERE field IS NOT NULL GROUP BY field HAVING count(*) < any_value(d)),
hit AS (SELECT field, period, count(*) AS hits FROM records GROUP BY field, period),
grid AS (SELECT s.field, p.i, p.period, coalesce(h.hits, 0) AS hits, p.total,
    coalesce(h.hits, 0) * ln(p1 / p0) + (p.total - coalesce(h.hits, 0)) * ln((1 - p1) / (1 - p0)) AS gain
  FROM shares s CROSS JOIN periods p LEFT JOIN hit h ON h.field = s.field AND h.period = p.period),
walk AS (
  SELECT field, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS c0, CAST(1e308 AS DOUBLE) AS c1, '' AS s0, '' AS s1 FROM shares
  UNION ALL
  SELECT w.field, g.i, least(c0, c1), least(c0 + up, c1) - gain,
    CASE WHEN c1 < c0 THEN s1 ELSE s0 END || '0', CASE WHEN c1 < c0 + up THEN s1 ELSE s0 END || '1'
  FROM walk w JOIN grid g ON g.field = w.field AND g.i = w.i + 1, whole),
best AS (SELECT field, CASE WHEN c1 < c0 THEN s1 ELSE s0 END AS states FROM walk, whole WHERE i = n),
states AS (SELECT field, i, period, hits, total, CAST(substr(states, i, 1) AS INTEGER) AS state, gain FROM grid JOIN best USING (field))"""

_Y = SQL_YEAR.format(x="Publication_Date")
ORACLE = {
    "field_burst_states": _BURST_STATES + """
SELECT field, period, hits, total, state, round(gain, 4) AS gain FROM states""",
    "field_bursts": _BURST_STATES + """,
runs AS (SELECT *, sum(CASE WHEN state = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY field ORDER BY period) AS run FROM states)
SELECT field, min(period) AS first_period, max(period) AS last_period, count(*) AS periods,
  CAST(sum(hits) AS BIGINT) AS hits, round(sum(gain), 4) AS gain
FROM runs WHERE state = 1 GROUP BY field, run ORDER BY field, first_period""",
    "records_per_year": f"""WITH {SQL_PUBLICATION_DATES},
py AS (SELECT CAST({_Y} AS INTEGER) AS year, count(*) AS n_records FROM pubs WHERE {_Y} IS NOT NULL GROUP BY 1)
SELECT year, n_records, CAST(sum(n_records) OVER (ORDER BY year) AS BIGINT) AS cumulative FROM py ORDER BY year""",
    "records_per_decade": f"""WITH {SQL_PUBLICATION_DATES}
SELECT CAST(CAST(floor({_Y} / 10) * 10 AS INTEGER) AS VARCHAR) AS decade, count(*) AS n_records
FROM pubs WHERE {_Y} IS NOT NULL GROUP BY 1 ORDER BY 1""",
    "year_range_filter": f"""WITH {SQL_PUBLICATION_DATES}
SELECT ID, Publication_Date, CAST({_Y} AS INTEGER) AS Year FROM pubs
WHERE {_Y} BETWEEN {FIXTURE_YEARS[0]} AND {FIXTURE_YEARS[1]}""",
    "institution_frequency": f"""
SELECT institution, count(*) AS n FROM (
  SELECT trim(unnest(string_split_regex(({str_list(AFFILIATION_TEMPLATES)})[c_custkey % {len(AFFILIATION_TEMPLATES)} + 1], ';\\s*'))) AS institution
  FROM customer)
WHERE institution <> '' GROUP BY 1 ORDER BY n DESC, institution""",
}

QUERIES = {
    "field_burst_states": field_burst_states_q,
    "field_bursts": field_bursts_q,
    "records_per_year": records_per_year_q,
    "records_per_decade": records_per_decade_q,
    "year_range_filter": year_range_filter_q,
    "institution_frequency": institution_frequency_q,
}

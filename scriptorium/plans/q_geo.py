"""Registered queries: affiliation countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions.rules import country_rules
from scriptorium.operators.geo import country_frequency, country_of
from scriptorium.plans.sqltext import str_list, values_rows
from scriptorium.plans.standins import AFFILIATION_TEMPLATES, affiliations, rule_affiliations
from scriptorium.session import read_table, widen


def country_frequency_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = affiliations(read_table(spark, sf_dir, "customer"))
    return country_frequency(meta, "Affiliations")


def country_by_segment_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = affiliations(read_table(spark, sf_dir, "customer"))
    return country_frequency(meta, "Affiliations", by=["c_mktsegment"])


def country_of_rules_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 on affiliations that reach every rule of the list, row by row."""
    # the rules are much work a row: a table in a few splits is spread first
    meta = rule_affiliations(widen(read_table(spark, sf_dir, "customer")), read_table(spark, sf_dir, "nation"))
    return meta.select("ID", "Affiliations", country_of(F.col("Affiliations")).alias("Country"))


_RULES_CTE = ("rules(priority, pat, val) AS (VALUES "
              + values_rows([(i, p, v) for i, (p, v) in enumerate(country_rules())]) + ")")
_META_CTE = (f"meta AS (SELECT c_custkey AS ID, c_mktsegment, "
             f"({str_list(AFFILIATION_TEMPLATES)})[c_custkey % {len(AFFILIATION_TEMPLATES)} + 1] "
             f"AS Affiliations FROM customer)")
_LABEL_CTES = f"""{_RULES_CTE},
{_META_CTE},
kept AS (SELECT * FROM meta WHERE NOT regexp_full_match(Affiliations, '(No Affiliation;?\\s?)+')),
lab AS (
  SELECT d.Affiliations,
         CASE WHEN d.Affiliations = 'No Affiliation' THEN NULL
              ELSE coalesce(arg_min(r.val, r.priority), 'Unknown') END AS Country
  FROM (SELECT DISTINCT Affiliations FROM kept) d
  LEFT JOIN rules r ON contains(lower(d.Affiliations), r.pat)
  GROUP BY d.Affiliations)"""

_PATTERNS = str_list([p for p, _ in country_rules()])
ORACLE = {
    "country_of_rules": f"""WITH {_RULES_CTE},
named AS (SELECT c_custkey, n_name, 'Unit ' || c_name || ' of ' || ({_PATTERNS})[c_custkey % {len(country_rules())} + 1] || '-' AS a
          FROM customer JOIN nation ON c_nationkey = n_nationkey),
cased AS (SELECT c_custkey, n_name, CASE WHEN c_custkey % 2 = 0 THEN upper(a) ELSE a END AS a FROM named),
meta AS (SELECT c_custkey AS ID, CASE WHEN c_custkey % 3 = 0 THEN a || '; ' || n_name ELSE a END AS Affiliations FROM cased)
SELECT ID, Affiliations, coalesce(arg_min(r.val, r.priority), 'Unknown') AS Country
FROM meta LEFT JOIN rules r ON contains(lower(Affiliations), r.pat) GROUP BY ID, Affiliations""",
    "country_frequency": f"""WITH {_LABEL_CTES}
SELECT lab.Country AS Country, count(*) AS Count
FROM kept JOIN lab USING (Affiliations)
WHERE lab.Country IS NOT NULL
GROUP BY lab.Country ORDER BY Count DESC, Country""",
    "country_by_segment": f"""WITH {_LABEL_CTES}
SELECT kept.c_mktsegment AS c_mktsegment, lab.Country AS Country, count(*) AS Count
FROM kept JOIN lab USING (Affiliations)
WHERE lab.Country IS NOT NULL
GROUP BY kept.c_mktsegment, lab.Country ORDER BY c_mktsegment, Count DESC, Country""",
}

QUERIES = {
    "country_of_rules": country_of_rules_q,
    "country_frequency": country_frequency_q,
    "country_by_segment": country_by_segment_q,
}

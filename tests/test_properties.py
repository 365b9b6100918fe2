"""Property tests: Spark expressions vs the DuckDB formulations on generated
strings (many fragments that hit phrase, tag, case and rule edge cases)."""

import duckdb
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.text import remove_forbidden_phrases
from scriptorium.operators.geo import country_of
from scriptorium.plans.q_geo import _RULES_CTE
from scriptorium.plans.q_text import sql_remove_phrases

PHRASE_BITS = fv.FORBIDDEN_PHRASES + [p.lower() for p in fv.FORBIDDEN_PHRASES] + [
    "<b>", "</b>", "<i>", "</i>", "<strong>", "</strong>", " ", "  ", "\n", "\t", "abc", "Results", "x<y",
    "methods", ":", "[", "]", "see text", "•"]
RULE_BITS = (fv.COUNTRIES[::7] + [a for a, _ in fv.COUNTRY_ALIASES] + fv.US_INSTITUTIONS[::5]
             + [", ca ", ", NY.", ", ma;", "Dept of ", "campus", "Duke ", "Indiana", "Lagos", "; ", " ", "UK"])


def texts(bits):
    return st.lists(st.lists(st.sampled_from(bits), min_size=0, max_size=8).map("".join),
                    min_size=1, max_size=60)


def spark_column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def duck_column(values, sql_expr, ctes=""):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    return [r[0] for r in con.execute(f"{ctes} SELECT {sql_expr} FROM t ORDER BY i").fetchall()]


@settings(max_examples=6, deadline=None)
@given(texts(PHRASE_BITS))
def test_phrase_removal_matches_sql(spark, values):
    assert spark_column(spark, values, remove_forbidden_phrases) == duck_column(values, sql_remove_phrases("x"))


@settings(max_examples=6, deadline=None)
@given(texts(RULE_BITS))
def test_country_rules_match_sql(spark, values):
    got = spark_column(spark, values, country_of)
    want = duck_column(values, """CASE WHEN x = 'No Affiliation' THEN NULL ELSE coalesce(
        (SELECT arg_min(val, priority) FROM rules WHERE contains(lower(x), pat)), 'Unknown') END""",
                       ctes=f"WITH {_RULES_CTE}")
    assert got == want

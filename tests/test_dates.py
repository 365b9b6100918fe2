from pyspark.sql import functions as F

from scriptorium.functions.dates import decade, label_or_decade, pub_year


def test_years_and_decades(spark):
    rows = [("2020-01-02",), ("2021",), ("1999 Mar",), ("03/04/2011",), ("2020-02-30",), ("n.d.",), (None,)]
    df = spark.createDataFrame(rows, "d string").select(pub_year(F.col("d")).alias("y"))
    ys = [r.y for r in df.collect()]
    assert ys == [2020, 2021, 1999, 2011, None, None, None]     # Q-D1: per-row formats
    out = df.select(decade(F.col("y")).alias("dec"), label_or_decade(None, F.col("y")).alias("lab")).collect()
    assert [r.dec for r in out] == [2020, 2020, 1990, 2010, None, None, None]
    assert out[3].lab == "2010"                                  # Q-K3: no "2010.0"

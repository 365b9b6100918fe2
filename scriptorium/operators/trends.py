"""Trends by year and decade (A15, A16, W5); bursts of a key over periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from scriptorium.functions.dates import decade, pub_year
from scriptorium.session import materialize

#: Periods are places on a calendar; more of them than this are taken for a wrong column.
MAX_PERIODS = 20_000


def records_per_year(df: DataFrame, date_col: str) -> DataFrame:
    """A15 + W5: records per year with a running total.

    The running-total window has no partition key, but it runs over the
    per-year aggregate (one row per year), never over the records.
    """
    per_year = (df.select(pub_year(F.col(date_col)).alias("year"))
                .where(F.col("year").isNotNull())
                .groupBy("year").agg(F.count(F.lit(1)).alias("n_records")))
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_year.withColumn("cumulative", F.sum("n_records").over(w)).orderBy("year")


def records_per_decade(df: DataFrame, date_col: str) -> DataFrame:
    y = pub_year(F.col(date_col))
    return (df.select(decade(y).cast("string").alias("decade"))
            .where(F.col("decade").isNotNull())
            .groupBy("decade").agg(F.count(F.lit(1)).alias("n_records"))
            .orderBy("decade"))


def part_frequency(df: DataFrame, col: str, sep_regex: str, out: str) -> DataFrame:
    """Split a multi-valued field, trim the parts, count each part."""
    parts = F.explode(F.split(F.col(col), sep_regex)).alias("_p")
    return (df.select(parts).select(F.trim(F.col("_p")).alias(out))
            .where(F.col(out) != F.lit(""))
            .groupBy(out).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), out))


def burst_states(df: DataFrame, key_col: str, period_col: str, factor: float = 2.0, rise: float = 1.0) -> DataFrame:
    """Decode for every key in which periods it occurs unusually often: a two-state model.

    In state 0 a record of a period has the key with the key's overall share, in
    state 1 with ``factor`` times that (at most half way to one).  Entering
    state 1 costs ``rise`` times the logarithm of the number of periods, leaving
    it nothing; the states are the cheapest sequence (Viterbi), ties to state 0.

    Returns ``key, period, hits, total, state, gain``, one row per key and period
    of the table; ``gain`` is the log likelihood that state 1 gains over state 0.
    Periods are integers.  Records without one take no part, records without a key count in the
    totals only; a key that all records have cannot burst and is left out.  The
    records are aggregated first, so a hot key costs one row a period; only the
    totals, one number a period, pass through the driver.
    """
    dated = df.select(F.col(key_col).alias("key"), F.col(period_col).alias("period")).where(F.col("period").isNotNull())
    counted = materialize(dated.groupBy("key", "period").agg(F.count(F.lit(1)).alias("hits")))
    totals = counted.groupBy("period").agg(F.sum("hits").alias("total")).orderBy("period").limit(MAX_PERIODS + 1).collect()
    if len(totals) > MAX_PERIODS:
        raise ValueError(f"{period_col} has more than {MAX_PERIODS} periods")
    all_records = sum(r.total for r in totals)
    up = F.log(F.lit(float(max(len(totals), 1)))) * F.lit(float(rise))
    period_type = counted.schema["period"].dataType.simpleString()
    calendar = F.from_json(F.lit("[" + ",".join(f'{{"period":{r.period},"total":{r.total}}}' for r in totals) + "]"),
                           f"array<struct<period:{period_type},total:bigint>>")
    share = F.col("n") / F.lit(float(max(all_records, 1)))
    keys = (counted.where(F.col("key").isNotNull()).groupBy("key")
            .agg(F.sum("hits").alias("n"), F.map_from_entries(F.collect_list(F.struct("period", "hits"))).alias("by_period"))
            .where(F.col("n") < all_records)
            .withColumn("p0", share).withColumn("p1", F.least(share * factor, (share + 1) / 2))
            .withColumn("on", F.log(F.col("p1") / F.col("p0"))).withColumn("off", F.log((1 - F.col("p1")) / (1 - F.col("p0")))))

    def seen(t):
        hits = F.coalesce(F.try_element_at("by_period", t["period"]), F.lit(0))
        return F.struct(t["period"].alias("period"), hits.alias("hits"), t["total"].alias("total"),
                        (hits * F.col("on") + (t["total"] - hits) * F.col("off")).alias("gain"))

    def step(acc, x):
        from_high = acc["c1"] < acc["c0"]
        stay_high = acc["c1"] < acc["c0"] + up
        return F.struct(F.least(acc["c0"], acc["c1"]).alias("c0"), (F.least(acc["c0"] + up, acc["c1"]) - x["gain"]).alias("c1"),
                        F.concat(F.when(from_high, acc["s1"]).otherwise(acc["s0"]), F.lit("0")).alias("s0"),
                        F.concat(F.when(stay_high, acc["s1"]).otherwise(acc["s0"]), F.lit("1")).alias("s1"))

    start = F.struct(F.lit(0.0).alias("c0"), F.lit(1e308).alias("c1"), F.lit("").alias("s0"), F.lit("").alias("s1"))
    series = keys.select("key", F.transform(calendar, seen).alias("series"))
    states = series.select("key", "series", F.aggregate("series", start, step, lambda a: F.when(a["c1"] < a["c0"], a["s1"]).otherwise(a["s0"])).alias("states"))
    return states.select("key", "states", F.posexplode("series").alias("at", "x")).select(
        "key", "x.period", "x.hits", "x.total", F.substring("states", F.col("at") + 1, F.lit(1)).cast("int").alias("state"), "x.gain")


def bursts(states: DataFrame) -> DataFrame:
    """Runs of state 1 as ``key, first_period, last_period, periods, hits, gain``."""
    by_period = Window.partitionBy("key").orderBy("period")
    run = F.sum(F.when(F.col("state") == 0, 1).otherwise(0)).over(by_period)
    return (states.withColumn("run", run).where("state = 1").groupBy("key", "run")
            .agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).alias("periods"),
                 F.sum("hits").alias("hits"), F.round(F.sum("gain"), 4).alias("gain")).drop("run"))

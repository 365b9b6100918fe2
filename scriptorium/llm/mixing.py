"""Mixing sources to target word counts by exact budget fitting.

1. Words are counted once; from there on only narrow rows (id, source, size)
   move.
2. The sources' targets come from a water level: weight times level, at most a
   multiple of the source's size.  Each round is one small aggregate over the
   table of sources, which stays distributed.
3. For each source the documents are counted by exact length.  Every length
   first gives the same share of its documents; what is left of the budget is
   fitted by a bounded-knapsack dynamic programme over lengths and the counts
   still free.  One task sees one source's lengths, never its documents.
4. Documents are picked for their length's count in the order of a seeded hash
   of the id.  A length is parted into hash buckets, so one length that holds a
   third of all rows is ranked in as many tasks.

Cases: null texts have size 0 and are never taken; the null source is a source
of its own, last in order; equal rows are documents of their own and, where
only some are taken, which of them is open; an empty table gives an empty
table; only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import common
from scriptorium.operators.indexing import consecutive_index

BUCKETS = 256
#: Words of a source's budget that are left to the dynamic programme, about.
DP_WORDS = 4096


def knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to add so that their sum is as near below ``budget`` as can be."""
    added = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return added
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        left, part = min(int(free[k]), budget // int(lengths[k])), 1
        while left > 0:
            n = min(part, left)
            left, part = left - n, part * 2
            step = n * int(lengths[k])
            new = np.zeros_like(reach)
            new[step:] = reach[:-step] & ~reach[step:]
            by[new] = len(items)
            items.append((k, n))
            reach |= new
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, n = items[by[at]]
        added[k] += n
        at -= n * int(lengths[k])
    return added


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, none above its count, summing to about ``budget``."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if total == 0 or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((take * lengths).sum())
    for k in np.argsort(-lengths, kind="stable").tolist():
        if lengths[k] > 0 and left > dp_words:
            n = min(int(counts[k] - take[k]), (left - dp_words) // int(lengths[k]))
            take[k] += n
            left -= n * int(lengths[k])
    worth = lengths > 0
    take[worth] += knapsack(lengths[worth], (counts - take)[worth], left)
    return take


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Add ``target`` to (is_null, source, source_size): weighted shares under a ceiling.

    The level rises until no more sources reach their ceiling; each round
    fixes at least one more, usually all of them within a few rounds.
    """
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = consecutive_index(sources, ["is_null", "source"], "at", 8).select(
        "src", "source_size", (most * F.col("source_size")).alias("ceiling"),
        F.get(pattern, (F.col("at") % len(weights)).cast("int")).alias("weight"))
    weighed = common.checkpointed(weighed)
    first = weighed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    budget = share * (first["s"] or 0)
    level, fixed = (budget / first["w"] if first["w"] else 0.0), -1
    while True:
        full = F.col("ceiling") <= level * F.col("weight")
        now = weighed.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("ceiling")).otherwise(0.0)).alias("c"),
                          F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if now["n"] == fixed or not now["w"]:
            break
        fixed, level = now["n"], max(level, (budget - now["c"]) / now["w"])
    return weighed.select("src", "source_size", F.least("ceiling", F.lit(level) * F.col("weight")).alias("target"))


def sized_rows(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("src"),
        common.word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, its source's size and target, and the words taken.

    ``weights`` repeat over the sources in code point order, ``share`` is the
    mix's size as a part of all words, ``most`` how often a document may be taken.
    """
    sized = common.checkpointed(sized_rows(df, id_col, text_col, source_col, seed).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")))
    parts = sized.groupBy("src", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    lengths = parts.groupBy("src", "source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("is_null", F.col("source").isNull())
    wanted = targets(sources, weights, share, most)

    def plan(lens: pd.DataFrame) -> pd.DataFrame:
        total, target = int(lens["source_size"].iloc[0]), float(lens["target"].iloc[0])
        whole = min(int(target // total), most) if total else 0
        extra = fit(lens["size"].to_numpy(), lens["n"].to_numpy(), round(target) - whole * total) if whole < most else np.zeros(len(lens), np.int64)
        return lens[["src", "size", "source_size", "target"]].assign(whole=whole, extra=extra)

    planned = (lengths.join(wanted, "src").select("src", "size", "n", "source_size", "target")
               .groupBy("src").applyInPandas(plan, "src string, size bigint, source_size bigint, target double, whole int, extra bigint"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = (parts.select("src", "size", "bucket", before.alias("before")).join(planned, ["src", "size"])
              .select("src", "size", "bucket", "source_size", "target", "whole", (F.col("extra") - F.col("before")).alias("extra")))
    place = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "doc_id"))
    ranked = sized.select("doc_id", "source", "src", "size", "bucket", place.alias("place"))
    return ranked.join(shares, ["src", "size", "bucket"]).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("whole") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0))).cast("long").alias("taken"))


def report(df: DataFrame, **columns) -> DataFrame:
    return mix(df, **columns).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    nth = lambda d: d.withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy("_src", "_size")))
    chosen = mix(df, id_col, text_col, source_col, **options).select(
        F.col("doc_id").alias("_id"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_src"), F.col("size").alias("_size"),
        F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0)).cast("int").alias("_times"))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"),
                     F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_src"), common.word_count(F.col(text_col)).alias("_size"))
    a, b = nth(rows).alias("a"), nth(chosen).alias("b")
    on = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._nth") == F.col("b._nth"))
    joined = a.join(b, on).where(F.col("b._times") > 0).select("a._row", F.explode(F.sequence(F.lit(1), F.col("b._times"))).alias("_copy"))
    return joined.select("_row.*")

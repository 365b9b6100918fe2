"""Classification metrics as aggregations.

Everything derives from the confusion counts (one row per (label,
prediction) pair), so the work after the first aggregation is bounded by the
number of classes squared, whatever the test-set size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import fixed_values as fv


def confusion(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """A9."""
    return pred.groupBy(label_col, pred_col).agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """precision, recall, f1, support per class (labels of truth ∪ predictions);
    an undefined ratio counts as 0.

    Each confusion cell is unfolded into its true-label role and its
    predicted-label role, so one aggregation gives tp, support and predicted.
    """
    hit = F.col(label_col) == F.col(pred_col)
    roles = F.array(
        F.struct(F.col(label_col).alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col(pred_col).alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd"),
                 F.lit(0).cast("long").alias("tp")))
    t = (conf.select(F.inline(roles))
         .groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("support"),
                             F.sum("prd").alias("predicted")))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    t = t.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.withColumn("f1", f1)


def report(conf: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg``, ``weighted avg``.

    One ``rollup`` over the per-class table yields the class rows and the
    grand-total row in a single pass; the total row is then unfolded into
    the three summary rows.
    """
    pc = per_class(conf, label_col, pred_col)
    s = F.col("support")
    g = pc.rollup("cls").agg(
        F.grouping_id().alias("_total"),
        F.sum("tp").alias("_tp"), F.sum(s).alias("_support"),
        F.avg("precision").alias("_p"), F.avg("recall").alias("_r"), F.avg("f1").alias("_f"),
        F.sum(F.col("precision") * s).alias("_wp"), F.sum(F.col("recall") * s).alias("_wr"),
        F.sum(F.col("f1") * s).alias("_wf"))
    sup = F.col("_support")

    def row(name, p, r, f):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"))

    per_cls = row(None, F.col("_p"), F.col("_r"), F.col("_f"))
    summary = [row("accuracy", F.lit(None), F.lit(None), F.col("_tp") / sup),
               row("macro avg", F.col("_p"), F.col("_r"), F.col("_f")),
               row("weighted avg", F.col("_wp") / sup, F.col("_wr") / sup, F.col("_wf") / sup)]
    rows = F.when(F.col("_total") == 0, F.array(per_cls)).otherwise(F.array(*summary))
    out = g.select(F.col("cls").cast("string").alias("_cls"), sup.cast("bigint").alias("support"),
                   F.explode(rows).alias("r"))
    return out.select(F.coalesce(F.col("r.class"), F.col("_cls")).alias("class"),
                      *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


def run_summary(pred: DataFrame, n_train: int, k: int, model: str = fv.MODEL_NAME,
                mitigation: str = fv.MITIGATION, label_col: str = "label",
                pred_col: str = "prediction") -> DataFrame:
    """``Model, Training Size, Test Size, k, Accuracy, Mitigation``."""
    return pred.agg(F.lit(model).alias("Model"), F.lit(n_train).cast("bigint").alias("Training Size"),
                    F.count(F.lit(1)).alias("Test Size"), F.lit(k).cast("bigint").alias("k"),
                    F.round(F.avg((F.col(label_col) == F.col(pred_col)).cast("double")), 6).alias("Accuracy"),
                    F.lit(mitigation).alias("Mitigation"))

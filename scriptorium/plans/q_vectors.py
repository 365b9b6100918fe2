"""Registered queries: alignment, split, k-NN, evaluation, SMOTE."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.operators.evaluate import confusion, report, run_summary
from scriptorium.operators.metric_knn import pruned_knn
from scriptorium.operators.vectors import classify, knn, oversample, smote, smote_classify, stratified_split
from scriptorium.plans.standins import SQL_PUBLICATION_DATES, SQL_YEAR
from scriptorium.session import read_table, widen
from scriptorium.sources.tables import require_unique


def embeddings(spark, sf_dir):
    return widen(read_table(spark, sf_dir, "embeddings"))


def aligned(spark, sf_dir):
    """Embeddings ⋈ labels on the key; class = quality*2 + toxic."""
    emb = require_unique(embeddings(spark, sf_dir), "vec_id", "embeddings")
    lab = require_unique(read_table(spark, sf_dir, "labels"), "doc_id", "labels")
    lab = lab.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return emb.join(lab, emb.vec_id == lab.doc_id).select(
        "vec_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"), "embedding")


def aligned_decades(spark, sf_dir):
    """The reference's path without a label column: J1 with the metadata
    dates (P8), rows without a year dropped (F3), label = decade as a string
    (P9, P10)."""
    from scriptorium.functions.dates import label_or_decade, pub_year
    from scriptorium.plans.standins import publication_dates
    emb = require_unique(embeddings(spark, sf_dir), "vec_id", "embeddings")
    pubs = require_unique(publication_dates(read_table(spark, sf_dir, "orders")), "ID", "metadata")
    year = pub_year(F.col("Publication_Date"))
    return (emb.join(pubs, emb.vec_id == pubs.ID)
            .select("vec_id", year.alias("year"), "embedding")
            .where(F.col("year").isNotNull())
            .select("vec_id", "year", label_or_decade(None, F.col("year")).alias("label"), "embedding"))


def _split(spark, sf_dir):
    return stratified_split(embeddings(spark, sf_dir), "label", "vec_id")


def _classified(spark, sf_dir):
    return classify(_split(spark, sf_dir), "vec_id", "embedding", "label")


def stratified_split_q(spark, sf_dir):
    return _split(spark, sf_dir).select("vec_id", "label", "is_test")


def knn_neighbors_q(spark, sf_dir):
    split = _split(spark, sf_dir)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    k = min(fv.MAX_NEIGHBOURS, train.count())
    nb = knn(test, train, k, id_col="vec_id", vec_col="embedding")
    return nb.select(F.col("q_id").alias("vec_id"), F.col("b_id").alias("neighbor_id"),
                     F.col("rank").cast("bigint").alias("rank"), F.round("dist", 6).alias("dist"))


def knn_pruned_q(spark, sf_dir):
    """The same neighbours by pivots, radii and the triangle inequality, in blocks of 128 rows."""
    split = _split(spark, sf_dir)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    n = train.count()
    nb = pruned_knn(test, train, min(fv.MAX_NEIGHBOURS, n), id_col="vec_id", vec_col="embedding", block_rows=128, n_base=n)
    return nb.select(F.col("q_id").alias("vec_id"), F.col("b_id").alias("neighbor_id"),
                     F.col("rank").cast("bigint").alias("rank"), F.round("dist", 6).alias("dist"))


def knn_predict_q(spark, sf_dir):
    return _classified(spark, sf_dir)[0]


def knn_confusion_q(spark, sf_dir):
    return confusion(_classified(spark, sf_dir)[0])


def knn_report_q(spark, sf_dir):
    return report(confusion(_classified(spark, sf_dir)[0]))


def knn_run_summary_q(spark, sf_dir):
    pred, k, n_train = _classified(spark, sf_dir)
    return run_summary(pred, n_train, k, mitigation=fv.NO_OVERSAMPLING)


def embedding_align_q(spark, sf_dir):
    return aligned(spark, sf_dir).select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"))


def align_diagnostics_q(spark, sf_dir):
    """Shapes before and after the alignment, one row.

    Three aggregates, each filling its own columns, are stacked with a union
    and folded by one global aggregation (no join between them)."""
    emb = read_table(spark, sf_dir, "embeddings")
    lab = read_table(spark, sf_dir, "labels")
    cols = ["n_embeddings", "n_embedding_ids", "dims", "n_metadata", "n_metadata_ids", "n_common"]

    def part(df, **vals):
        return df.agg(*[(vals[c] if c in vals else F.lit(None)).cast("bigint").alias(c) for c in cols])

    e = part(emb, n_embeddings=F.count(F.lit(1)), n_embedding_ids=F.count_distinct("vec_id"),
             dims=F.max(F.size("embedding")))
    m = part(lab, n_metadata=F.count(F.lit(1)), n_metadata_ids=F.count_distinct("doc_id"))
    common = emb.select(F.col("vec_id").alias("id")).intersect(lab.select(F.col("doc_id").alias("id")))
    c = part(common, n_common=F.count(F.lit(1)))
    return e.unionByName(m).unionByName(c).agg(*[F.max(x).alias(x) for x in cols])


def smote_points_q(spark, sf_dir):
    syn = smote(aligned(spark, sf_dir), "vec_id", "embedding", "label")
    return syn.select("vec_id", "label", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"),
                      "base_id", "neighbour_id", F.round("u", 6).alias("u"))


def smote_neighbour_spread_q(spark, sf_dir):
    """Per base row: the points made from it and how many of its neighbours they use."""
    syn = smote(aligned(spark, sf_dir), "vec_id", "embedding", "label")
    return syn.groupBy("label", "base_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.count_distinct("neighbour_id").alias("n_neighbours"))


def smote_counts_q(spark, sf_dir):
    al = aligned(spark, sf_dir)
    before = al.groupBy("label").agg(F.count(F.lit(1)).alias("n_before"))
    after = oversample(al, "vec_id", "embedding", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, "label")


def knn_smote_summary_q(spark, sf_dir):
    """The reference's classification run: align → SMOTE → split → k-NN."""
    pred, k, n_train = smote_classify(aligned(spark, sf_dir), "vec_id", "embedding", "label", "before_split")
    return run_summary(pred, n_train, k, mitigation=fv.MITIGATION)


def decade_labels_q(spark, sf_dir):
    return aligned_decades(spark, sf_dir).select("vec_id", "year", "label")


def knn_decade_summary_q(spark, sf_dir):
    """The reference run with decade labels: SMOTE → split → k-NN."""
    al = aligned_decades(spark, sf_dir).drop("year")
    pred, k, n_train = smote_classify(al, "vec_id", "embedding", "label", "before_split")
    return run_summary(pred, n_train, k, mitigation=fv.MITIGATION)


def knn_smote_train_only_summary_q(spark, sf_dir):
    """Q-K2, leak-free order: align → split → SMOTE on training rows → k-NN."""
    pred, k, n_train = smote_classify(aligned(spark, sf_dir), "vec_id", "embedding", "label", "train_only")
    return run_summary(pred, n_train, k, mitigation="SMOTE (train only)")


def resume_todo_q(spark, sf_dir):
    """J8 + W6: documents without a stored embedding, in batches of 50."""
    from scriptorium.operators.indexing import consecutive_index
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    store = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    todo = docs.join(store, "doc_id", "left_anti")
    idx = consecutive_index(todo, ["doc_id"], out="_i")
    return idx.select("doc_id", F.floor(F.col("_i") / fv.BATCH_SIZE).cast("bigint").alias("batch"))


# --- oracle ------------------------------------------------------------------

_SPLIT = """split AS (
  SELECT vec_id, label, embedding,
         row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 10007, vec_id)
           <= (count(*) OVER (PARTITION BY label) + 4) // 5 AS is_test
  FROM embeddings)"""
_NEIGH = _SPLIT + """,
train AS (SELECT * FROM split WHERE NOT is_test),
test AS (SELECT * FROM split WHERE is_test),
kk AS (SELECT least(5, count(*)) AS k FROM train),
d AS (
  SELECT t.vec_id AS q_id, b.vec_id AS b_id, b.label AS b_label, t.label AS label,
         list_distance(CAST(t.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist
  FROM test t, train b),
nb AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS rank FROM d)
  WHERE rank <= (SELECT k FROM kk))"""
_NEIGHBOURS = f"""WITH {_NEIGH}
SELECT q_id AS vec_id, b_id AS neighbor_id, rank, round(dist, 6) AS dist FROM nb"""
_PRED = _NEIGH + """,
nbw AS (SELECT *, min(dist) OVER (PARTITION BY q_id) AS mind FROM nb),
sc AS (
  SELECT q_id, b_label, sum(CASE WHEN mind = 0 THEN (CASE WHEN dist = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                                 ELSE 1.0::DOUBLE / dist END) AS s
  FROM nbw GROUP BY q_id, b_label),
best AS (
  SELECT q_id, b_label AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, b_label) AS r FROM sc) WHERE r = 1),
pred AS (SELECT t.vec_id, t.label, b.prediction FROM test t LEFT JOIN best b ON b.q_id = t.vec_id),
conf AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY label, prediction)"""
_REPORT = _PRED + """,
cls AS (SELECT label AS cls FROM conf UNION SELECT prediction FROM conf),
pc AS (
  SELECT c.cls,
         coalesce((SELECT sum(n) FROM conf WHERE label = c.cls AND prediction = c.cls), 0) AS tp,
         coalesce((SELECT sum(n) FROM conf WHERE label = c.cls), 0) AS support,
         coalesce((SELECT sum(n) FROM conf WHERE prediction = c.cls), 0) AS predicted
  FROM cls c),
pr AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0::DOUBLE END AS precision,
            CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0::DOUBLE END AS recall
  FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                      ELSE 0.0::DOUBLE END AS f1 FROM pr)"""

_ALIGNED = """al AS (
  SELECT e.vec_id AS id, l.quality * 2 + l.toxic AS cls, e.embedding AS vec
  FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id
  WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL)"""
def _smote_sql(src: str) -> str:
    """SMOTE CTEs over relation ``src`` (id, cls, vec); the result is ``syn``."""
    return f"""cnt AS (SELECT cls, count(*) AS n_c, row_number() OVER (ORDER BY cls) - 1 AS cidx FROM {src} GROUP BY cls),
plan AS (
  SELECT cls, cidx, n_c, n_max - n_c AS need, least(5, n_c - 1) AS k_c,
         coalesce(sum(n_max - n_c) OVER (ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS id_off
  FROM cnt, (SELECT max(n_c) AS n_max FROM cnt) mx WHERE n_c < n_max),
ranked AS (
  SELECT a.*, row_number() OVER (PARTITION BY a.cls ORDER BY (a.id * 7919) % 10007, a.id) AS rn
  FROM {src} a JOIN plan p ON p.cls = a.cls),
nn AS (
  SELECT a.id AS base_id, b.id AS nb_id,
         row_number() OVER (PARTITION BY a.id ORDER BY list_distance(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), b.id) AS m
  FROM ranked a JOIN ranked b ON a.cls = b.cls AND a.id <> b.id),
todo AS (
  SELECT p.*, j, j % n_c + 1 AS rn, ((j % n_c + 1) * 31 + cidx * 17 + j // n_c) % k_c + 1 AS m,
         CAST(((j % n_c + 1) * 742938285 + (j // n_c) * 950706376 + cidx * 104729 + 13) % 2147483647 AS DOUBLE)
           / 2147483647.0::DOUBLE AS u,
         CAST(-(id_off + j + 1) AS BIGINT) AS syn_id
  FROM plan p, (SELECT unnest(range(0, (SELECT max(need) FROM plan))) AS j) js
  WHERE j < p.need),
syn AS (
  SELECT t.syn_id AS vec_id, t.cls AS label, r.id AS base_id, n.nb_id AS neighbour_id, t.u,
         list_transform(list_zip(CAST(r.vec AS DOUBLE[]), CAST(v.vec AS DOUBLE[])),
                        lambda x: x[1] + t.u * (x[2] - x[1])) AS embedding
  FROM todo t
  JOIN ranked r ON r.cls = t.cls AND r.rn = t.rn
  JOIN nn n ON n.base_id = r.id AND n.m = t.m
  JOIN {src} v ON v.id = n.nb_id)"""


_SMOTE = _ALIGNED + ",\n" + _smote_sql("al")


_Y = SQL_YEAR.format(x="Publication_Date")
_DECADES = f"""{SQL_PUBLICATION_DATES},
dl AS (
  SELECT e.vec_id AS id, CAST({_Y} AS INTEGER) AS year,
         CAST(CAST(floor({_Y} / 10) * 10 AS INTEGER) AS VARCHAR) AS cls, e.embedding AS vec
  FROM embeddings e JOIN pubs p ON p.ID = e.vec_id
  WHERE {_Y} IS NOT NULL)"""


def _knn_summary_sql(split: str, mitigation: str) -> str:
    """k-NN + run summary over relation ``split`` (vec_id, label, embedding DOUBLE[], is_test)."""
    return f"""tr AS (SELECT * FROM {split} WHERE NOT is_test),
te AS (SELECT * FROM {split} WHERE is_test),
kk AS (SELECT least(5, count(*)) AS k FROM tr),
d AS (SELECT t.vec_id AS q_id, b.vec_id AS b_id, b.label AS b_label, list_distance(t.embedding, b.embedding) AS dist
      FROM te t, tr b),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS rank FROM d)
       WHERE rank <= (SELECT k FROM kk)),
nbw AS (SELECT *, min(dist) OVER (PARTITION BY q_id) AS mind FROM nb),
sc AS (SELECT q_id, b_label, sum(CASE WHEN mind = 0 THEN (CASE WHEN dist = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                                      ELSE 1.0::DOUBLE / dist END) AS s FROM nbw GROUP BY q_id, b_label),
best AS (SELECT q_id, b_label AS prediction FROM (
           SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, b_label) AS r FROM sc) WHERE r = 1),
pred AS (SELECT t.vec_id, t.label, b.prediction FROM te t LEFT JOIN best b ON b.q_id = t.vec_id)
SELECT '{fv.MODEL_NAME}' AS "Model", (SELECT count(*) FROM tr) AS "Training Size", count(*) AS "Test Size",
       CAST((SELECT k FROM kk) AS BIGINT) AS k,
       round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS "Accuracy",
       '{mitigation}' AS "Mitigation"
FROM pred"""


ORACLE = {
    "stratified_split": f"WITH {_SPLIT} SELECT vec_id, label, is_test FROM split",
    "knn_neighbors": _NEIGHBOURS,
    "knn_pruned": _NEIGHBOURS,
    "knn_predict": f"WITH {_PRED} SELECT vec_id, label, prediction FROM pred",
    "knn_confusion": f"WITH {_PRED} SELECT label, prediction, n FROM conf",
    "knn_report": f"""WITH {_REPORT}
SELECT CAST(cls AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM pf""",
    "knn_run_summary": f"""WITH {_PRED}
SELECT '{fv.MODEL_NAME}' AS "Model", (SELECT count(*) FROM train) AS "Training Size", count(*) AS "Test Size",
       CAST((SELECT k FROM kk) AS BIGINT) AS k,
       round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS "Accuracy",
       'No Oversampling' AS "Mitigation"
FROM pred""",
    "embedding_align": """
SELECT e.vec_id, l.quality * 2 + l.toxic AS label, len(e.embedding) AS dims
FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
    "align_diagnostics": """
SELECT (SELECT count(*) FROM embeddings) AS n_embeddings,
       (SELECT count(DISTINCT vec_id) FROM embeddings) AS n_embedding_ids,
       (SELECT CAST(max(len(embedding)) AS BIGINT) FROM embeddings) AS dims,
       (SELECT count(*) FROM labels) AS n_metadata,
       (SELECT count(DISTINCT doc_id) FROM labels) AS n_metadata_ids,
       (SELECT count(*) FROM (SELECT vec_id FROM embeddings INTERSECT SELECT doc_id FROM labels)) AS n_common""",
    "smote_points": f"""WITH {_SMOTE}
SELECT vec_id, label, list_transform(embedding, lambda x: round(x, 6) + 0.0) AS embedding, base_id, neighbour_id,
       round(u, 6) AS u FROM syn""",
    # from the class sizes alone: base rows in their order, points dealt round, every neighbour in turn
    "smote_neighbour_spread": f"""WITH {_ALIGNED},
cnt AS (SELECT cls, count(*) AS n_c FROM al GROUP BY cls),
ranked AS (SELECT id, cls, row_number() OVER (PARTITION BY cls ORDER BY (id * 7919) % 10007, id) AS rn FROM al),
pts AS (SELECT r.cls, r.id, c.n_c, (SELECT max(n_c) FROM cnt) - c.n_c - r.rn AS left_over
        FROM ranked r JOIN cnt c USING (cls))
SELECT cls AS label, id AS base_id, left_over // n_c + 1 AS n_points,
       least(left_over // n_c + 1, 5, n_c - 1) AS n_neighbours
FROM pts WHERE left_over >= 0""",
    "smote_counts": f"""WITH {_ALIGNED},
cnt AS (SELECT cls, count(*) AS n_c FROM al GROUP BY cls)
SELECT cls AS label, n_c AS n_before, (SELECT max(n_c) FROM cnt) AS n_after FROM cnt""",
    "knn_smote_summary": f"""WITH {_SMOTE},
res AS (SELECT id AS vec_id, cls AS label, CAST(vec AS DOUBLE[]) AS embedding FROM al
        UNION ALL SELECT vec_id, label, embedding FROM syn),
sp AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY ((vec_id * 7919) % 10007 + 10007) % 10007, vec_id)
              <= (count(*) OVER (PARTITION BY label) + 4) // 5 AS is_test
  FROM res),
{_knn_summary_sql("sp", "SMOTE")}""",
    "decade_labels": f"""WITH {_DECADES}
SELECT id AS vec_id, year, cls AS label FROM dl""",
    "knn_decade_summary": f"""WITH {_DECADES},
{_smote_sql("dl")},
res AS (SELECT id AS vec_id, cls AS label, CAST(vec AS DOUBLE[]) AS embedding FROM dl
        UNION ALL SELECT vec_id, label, embedding FROM syn),
sp AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY ((vec_id * 7919) % 10007 + 10007) % 10007, vec_id)
              <= (count(*) OVER (PARTITION BY label) + 4) // 5 AS is_test
  FROM res),
{_knn_summary_sql("sp", "SMOTE")}""",
    "knn_smote_train_only_summary": f"""WITH {_ALIGNED},
sp0 AS (
  SELECT *, row_number() OVER (PARTITION BY cls ORDER BY (id * 7919) % 10007, id)
              <= (count(*) OVER (PARTITION BY cls) + 4) // 5 AS is_test
  FROM al),
trn AS (SELECT id, cls, vec FROM sp0 WHERE NOT is_test),
{_smote_sql("trn")},
sp AS (SELECT id AS vec_id, cls AS label, CAST(vec AS DOUBLE[]) AS embedding, false AS is_test FROM trn
       UNION ALL SELECT vec_id, label, embedding, false FROM syn
       UNION ALL SELECT id, cls, CAST(vec AS DOUBLE[]), true FROM sp0 WHERE is_test),
{_knn_summary_sql("sp", "SMOTE (train only)")}""",
    "resume_todo": """
SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 50) AS BIGINT) AS batch
FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
}

QUERIES = {
    "stratified_split": stratified_split_q,
    "knn_neighbors": knn_neighbors_q,
    "knn_pruned": knn_pruned_q,
    "knn_predict": knn_predict_q,
    "knn_confusion": knn_confusion_q,
    "knn_report": knn_report_q,
    "knn_run_summary": knn_run_summary_q,
    "embedding_align": embedding_align_q,
    "align_diagnostics": align_diagnostics_q,
    "smote_points": smote_points_q,
    "smote_counts": smote_counts_q,
    "smote_neighbour_spread": smote_neighbour_spread_q,
    "knn_smote_summary": knn_smote_summary_q,
    "knn_smote_train_only_summary": knn_smote_train_only_summary_q,
    "decade_labels": decade_labels_q,
    "knn_decade_summary": knn_decade_summary_q,
    "resume_todo": resume_todo_q,
}


# --- rows-only: approximate neighbours and the 2-D map ---------------------------

def knn_approx_q(spark, sf_dir):
    """LSH neighbours of the test rows among the train rows, with the recall
    against the exact neighbours per query."""
    from scriptorium.operators.vectors import approx_knn
    split = _split(spark, sf_dir)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    k = fv.MAX_NEIGHBOURS
    approx = approx_knn(test, train, k, id_col="vec_id", vec_col="embedding")
    exact = knn(test, train, k, id_col="vec_id", vec_col="embedding")
    hits = approx.select("q_id", "b_id").join(exact.select("q_id", "b_id"), ["q_id", "b_id"])
    return (exact.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_exact"))
            .join(hits.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_found")), "q_id", "left")
            .fillna(0, ["n_found"])
            .select(F.col("q_id").alias("vec_id"), "n_exact", "n_found",
                    (F.col("n_found") / F.col("n_exact")).alias("recall")))


def pca_projection_q(spark, sf_dir):
    from scriptorium.operators.vectors import project_2d
    return project_2d(embeddings(spark, sf_dir), "vec_id", "embedding", ["label"])


QUERIES.update({"knn_approx": knn_approx_q, "pca_projection": pca_projection_q})

"""k-NN, split, vote, SMOTE and metrics against brute force / hand values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators.evaluate import confusion, report
from scriptorium.operators.vectors import knn, smote, stratified_split, weighted_vote


def frame(spark, ids, vecs, labels):
    rows = [(int(i), [float(x) for x in v], int(l)) for i, v, l in zip(ids, vecs, labels)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int")


def brute(Q, qid, B, bid, k, exclude_self=False):
    out = {}
    for i, q in zip(qid, Q):
        d = np.sqrt(((B - q) ** 2).sum(1))
        cand = [(dd, b) for dd, b in zip(d, bid) if not (exclude_self and b == i)]
        out[i] = [b for _, b in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("block_rows", [7, 64, 4096])
def test_blocked_knn_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    B, Q = rng.normal(size=(150, 8)), rng.normal(size=(40, 8))
    base = frame(spark, range(150), B, [0] * 150)
    qry = frame(spark, range(1000, 1040), Q, [0] * 40)
    got = knn(qry, base, 5, block_rows=block_rows).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.q_id, r.rank)):
        res.setdefault(r.q_id, []).append(r.b_id)
    assert res == brute(Q, range(1000, 1040), B, np.arange(150), 5)


def test_grouped_self_knn(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(90, 4))
    lab = [i % 3 for i in range(90)]
    df = frame(spark, range(90), X, lab)
    got = knn(df, df, 3, group_col="label", exclude_self=True, block_rows=10).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.q_id, r.rank)):
        res.setdefault(r.q_id, []).append(r.b_id)
    for c in range(3):
        idx = np.array([i for i in range(90) if lab[i] == c])
        want = brute(X[idx], idx, X[idx], idx, 3, exclude_self=True)
        for i in idx:
            assert res[i] == want[i]


def test_distance_zero_vote(spark):
    neigh = spark.createDataFrame([(1, 0.0, 2), (1, 0.5, 1), (1, 0.6, 1), (2, 1.0, 3), (2, 1.0, 4)],
                                  "q_id long, dist double, b_label int")
    got = dict((r.q_id, r.prediction) for r in weighted_vote(neigh).collect())
    assert got == {1: 2, 2: 3}   # Q-K4 exact match wins; tie → smallest label


def test_split_sizes(spark):
    df = frame(spark, range(103), np.zeros((103, 2)), [0] * 50 + [1] * 50 + [2] * 3)
    out = stratified_split(df, "label", "id").groupBy("label").agg(F.sum(F.col("is_test").cast("int")).alias("t"))
    assert dict((r.label, r.t) for r in out.collect()) == {0: 10, 1: 10, 2: 1}


def test_smote_properties(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(60, 3))
    lab = [0] * 40 + [1] * 12 + [2] * 8
    df = frame(spark, range(60), X, lab)
    syn = smote(df, "id", "vec", "label").collect()
    counts = {1: 12, 2: 8}
    for r in syn:
        counts[r.label] += 1
        assert lab[r.base_id] == r.label and lab[r.neighbour_id] == r.label
        a, b = X[r.base_id], X[r.neighbour_id]
        assert np.allclose(np.array(r.vec), a + r.u * (b - a))
        assert 0 <= r.u < 1
    assert counts == {1: 40, 2: 40}
    assert len({r.id for r in syn}) == len(syn) and all(r.id < 0 for r in syn)


def test_smote_single_row_class_raises(spark):
    df = frame(spark, range(5), np.eye(5), [0, 0, 0, 0, 1])
    with pytest.raises(ValueError):
        smote(df, "id", "vec", "label")


def test_report_values(spark):
    pred = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 1)], "label int, prediction int")
    rep = {r["class"]: r for r in report(confusion(pred)).collect()}
    assert rep["0"].precision == pytest.approx(2 / 3) and rep["0"].recall == pytest.approx(2 / 3)
    assert rep["2"].precision == 0 and rep["2"].f1 == 0 and rep["2"].support == 1
    assert rep["accuracy"].f1 == pytest.approx(0.5) and rep["accuracy"].support == 6
    p1 = 1 / 3
    assert rep["macro avg"].precision == pytest.approx(round((2 / 3 + p1 + 0) / 3, 6))
    w = (2 / 3 * 3 + p1 * 2 + 0) / 6
    assert rep["weighted avg"].precision == pytest.approx(round(w, 6))


def test_smote_chunked_generation_for_tiny_class(spark, monkeypatch):
    import scriptorium.operators.vectors as V
    monkeypatch.setattr(V, "GEN_CHUNK", 3)
    rng = np.random.default_rng(1)
    X = rng.normal(size=(32, 2))
    lab = [0] * 30 + [1] * 2          # class 1 needs 28 points from two rows
    syn = V.smote(frame(spark, range(32), X, lab), "id", "vec", "label").collect()
    assert len(syn) == 28 and sorted(r.id for r in syn) == list(range(-28, 0))
    assert {r.base_id for r in syn} == {30, 31}
    assert all({r.base_id, r.neighbour_id} == {30, 31} for r in syn)


def test_confusion_total_equals_test_rows(spark):
    from scriptorium.operators.vectors import classify
    rng = np.random.default_rng(4)
    df = frame(spark, range(120), rng.normal(size=(120, 6)), [i % 4 for i in range(120)])
    split = stratified_split(df, "label", "id")
    pred, k, n_train = classify(split, "id", "vec", "label")
    n_test = split.where(F.col("is_test")).count()
    assert confusion(pred).agg(F.sum("n")).first()[0] == n_test == pred.count()
    assert k == 5 and n_train == 120 - n_test


def test_lsh_classifier_agrees_with_exact(spark, sf_dir):
    from scriptorium.operators.vectors import classify
    from scriptorium.session import read_table
    split = stratified_split(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")
    exact = classify(split, "vec_id", "embedding", "label")[0]
    approx = classify(split, "vec_id", "embedding", "label", method="lsh")[0]
    same = exact.join(approx.withColumnRenamed("prediction", "p2"), ["vec_id", "label"]) \
        .where(F.col("prediction") == F.col("p2")).count()
    assert same / exact.count() > 0.9


def test_report_agrees_with_mllib_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    rng = np.random.default_rng(8)
    y = rng.integers(0, 4, 300)
    p = np.where(rng.random(300) < 0.6, y, rng.integers(0, 4, 300))
    pred = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "label int, prediction int")
    rep = {r["class"]: r for r in report(confusion(pred)).collect()}
    ev = pred.select(F.col("label").cast("double"), F.col("prediction").cast("double"))
    m = {name: MulticlassClassificationEvaluator(metricName=name).evaluate(ev)
         for name in ("accuracy", "weightedPrecision", "weightedRecall", "f1")}
    assert rep["accuracy"].f1 == pytest.approx(m["accuracy"], abs=1e-6)
    assert rep["weighted avg"].precision == pytest.approx(m["weightedPrecision"], abs=1e-6)
    assert rep["weighted avg"].recall == pytest.approx(m["weightedRecall"], abs=1e-6)
    assert rep["weighted avg"].f1 == pytest.approx(m["f1"], abs=1e-6)

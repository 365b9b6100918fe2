"""k-NN pruned by pivots against brute force, and how much it leaves out."""

import numpy as np
import pytest

from scriptorium.operators import metric_knn
from scriptorium.operators.vectors import exact_knn


def frame(spark, ids, vecs, kind="long"):
    return spark.createDataFrame([(i, [float(x) for x in v], int(abs(v[0]) * 10)) for i, v in zip(ids, vecs)], f"id {kind}, vec array<double>, label int")


def clustered(seed, n, centres=30, dim=16, spread=1.0):
    rng = np.random.default_rng(seed)
    of = np.random.default_rng(99).normal(size=(centres, dim)) * 20
    return of[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


def check(spark, base_ids, base, query_ids, queries, k, kind="long", **kw):
    got = {}
    rows = metric_knn.pruned_knn(frame(spark, query_ids, queries, kind), frame(spark, base_ids, base, kind), k, extra_cols=["label"], **kw).collect()
    for r in rows:
        got.setdefault(r.q_id, []).append((r["rank"], r.b_id, r.b_label, r.dist))
    assert len(rows) == len(query_ids) * min(k, len(base_ids))
    for i, v in zip(query_ids, queries):
        d = np.sqrt(((np.array(base) - v) ** 2).sum(1))
        want = sorted(zip(d, base_ids, base), key=lambda x: x[:2])[:k]
        assert [(r, b, l) for r, b, l, _ in sorted(got[i])] == [(j + 1, w[1], int(abs(w[2][0]) * 10)) for j, w in enumerate(want)]
        assert np.allclose([g[3] for g in sorted(got[i])], [w[0] for w in want])


def test_clusters_with_one_hot_spot(spark):
    base = clustered(1, 1500)
    base[:400] = base[0]          # rows at one place: one ring, several parts
    check(spark, list(range(1500)), base, list(range(5000, 5200)), np.vstack([clustered(2, 150), np.repeat(base[:1], 50, 0)]), 5, block_rows=64)


@pytest.mark.parametrize("base, queries, k", [
    (np.random.default_rng(3).normal(size=(300, 8)), np.random.default_rng(4).normal(size=(60, 8)), 5),        # nothing can be ruled out
    (np.random.default_rng(3).normal(size=(300, 3)) * 1e-3 + 1e6, np.random.default_rng(4).normal(size=(40, 3)) * 1e-3 + 1e6, 4),   # far from the origin
    (np.repeat([[1.0, 2.0], [3.0, 4.0]], 40, 0), np.array([[1.0, 2.0], [2.0, 3.0], [-500.0, 0.0]]), 50),       # two places, k beyond one of them
    (np.array([[0.0, 0.0], [1.0, 1.0]]), np.array([[0.2, 0.1]]), 5),                                           # fewer rows than k
])
def test_awkward_spaces(spark, base, queries, k):
    check(spark, list(range(len(base))), base, list(range(1000, 1000 + len(queries))), queries, k, block_rows=16)


def test_string_ids(spark):
    base, queries = clustered(5, 120, 6, 4), clustered(6, 20, 6, 4)
    check(spark, [f"b{i:04d}" for i in range(120)], base, [f"q{i}" for i in range(20)], queries, 3, "string", block_rows=16)


def test_empty_sides(spark):
    some, none = frame(spark, [1], [[1.0]]), frame(spark, [], [])
    assert metric_knn.pruned_knn(some, none, 3).collect() == [] and metric_knn.pruned_knn(none, some, 3).collect() == []


def test_under_a_quarter_of_the_cells_on_clusters_and_less_than_quadratic(spark):
    searched = []
    for n in (2500, 10000):
        some, every = metric_knn.pruned_cells(frame(spark, range(n // 2), clustered(7, n // 2)), frame(spark, range(n), clustered(8, n)), 5, block_rows=100)
        assert some < every / 4
        searched.append(some)
    assert searched[1] < 8 * searched[0]   # four times the rows on both sides: the grid grows by sixteen


def test_exact_knn_takes_either_way_to_the_same_rows(spark):
    base, queries = frame(spark, range(400), clustered(9, 400)), frame(spark, range(900, 960), clustered(10, 60))
    ways = [sorted((r.q_id, r["rank"], r.b_id) for r in exact_knn(queries, base, 4, id_col="id", vec_col="vec", sizes=(400, 60), block_rows=b).collect())
            for b in (30, 4096)]
    assert ways[0] == ways[1] and len(ways[0]) == 240


def test_rows_of_a_call_and_copies_stay_bounded(spark):
    """Distances to pivots are computed a slice at a time; seats carry no vectors; blocks grow with the tables up to bytes."""
    import pandas as pd
    pivots = metric_knn.Pivots(np.random.default_rng(1).normal(size=(64, 4)))
    old, metric_knn.DISTANCES = metric_knn.DISTANCES, 640
    try:
        slices = [len(s) for s in metric_knn._slices(iter([pd.DataFrame({"x": range(25)}), pd.DataFrame({"x": []})]), pivots)]
    finally:
        metric_knn.DISTANCES = old
    assert slices == [10, 10, 5]
    q, b = (frame(spark, range(n), clustered(s, n)).drop("label") for s, n in ((11, 300), (12, 900)))
    *_, seats = metric_knn._plan(q, b, 5, 900, 20, True)
    assert set(seats.columns) == {"group", "pivot", "ring", "part", "chunk"}
    from scriptorium.operators.vectors import SHIPPED_ROWS, shipped_rows
    assert shipped_rows(1000, 1000, 128, 64) == 128 and 128 < shipped_rows(40000, 10000, 128, 64) < SHIPPED_ROWS
    assert shipped_rows(10 ** 7, 10 ** 6, 128, 64) == SHIPPED_ROWS and shipped_rows(10 ** 7, 10 ** 6, 128, 4096) == 256

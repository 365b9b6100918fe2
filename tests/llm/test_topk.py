"""Exact top-k search against plain scoring, with awkward vectors and many equal scores."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import grid, topk

SCHEMA = "vec_id long, embedding array<{kind}>, label int, block int, id string, vector string, rank int"


def whole(vector):
    return [math.floor(256 * Fraction(x)) for x in vector]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def brute(rows, k=5):
    rows = [(r[0], whole(r[1])) for r in rows if usable(r[1])]
    out = []
    for i, q in rows:
        if i is not None and i % 50 == 0:
            scored = [(-max(-grid.LONG, min(grid.LONG - 1, sum(a * b for a, b in zip(q, v)))), j is None, j or 0, j) for j, v in rows if j != i]
            best = sorted(scored, key=lambda x: x[:3])[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, _, _, j) in enumerate(best)]
    return sorted(out, key=str)


def check(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, 1, 2, "x", "y", 3) for i, v in rows], SCHEMA.format(kind=kind))
    got = topk.report(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def unit(rng, n, dim):
    v = rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()


def test_awkward_vectors_equal_plain_scoring(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(unit(rng, 200, 6))]
    rows += [(1000, None), (1001, [None, 1.0]), (1050, [float("nan")] * 6), (1100, [float("inf")] + [0.0] * 5), (1150, []), (1200, [0.0] * 6),
             (None, [0.5] * 6), (None, [0.5] * 6), (1250, [1.0, 2.0]), (1300, [-1.0] * 9), (-50, [0.25] * 6), (0, [0.1] * 6)]
    rows += [(77, [1.0] * 6)] * 8 + [(50, rows[50][1])]
    check(spark, rows)


def test_equal_scores_go_to_smaller_ids_across_blocks(spark):
    r = random.Random(1)
    check(spark, [(i, [float(r.randint(0, 1)), 0.5]) for i in range(0, 9000, 3)])


def test_components_beyond_the_digits_of_a_double(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([1e30, -1e30, 3e12, 1.0, 2.0 ** 40 + i]) for _ in range(3)]) for i in range(60)]
    check(spark, rows, "double")


def test_empty_table_and_single_row(spark):
    check(spark, [])
    check(spark, [(50, [1.0, 2.0])])


def test_search_equals_scoring_and_reads_only_as_far_as_the_bound_demands():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 4)) * 300
    rows = (centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 4)) * 5).round()
    lists = np.argsort(-rows, axis=0, kind="stable").T
    depths = topk._depths(len(rows))
    read = 0
    for i in range(0, 200):
        bound = topk.bounds(rows[i:i + 1], rows, lists, depths)[0]
        places, scores = topk.threshold_search(rows[i], rows, lists, depths, bound, -np.inf, 5, np.ones(len(rows), bool))
        assert (scores == rows[places] @ rows[i]).all()
        want = np.sort(rows @ rows[i])[-5:]
        assert (np.sort(scores)[-5:] == want).all()
        read += len(places)
    assert read < 0.6 * 200 * len(rows)


@pytest.mark.parametrize("floor", [10 ** 9, -10 ** 9])
def test_floor_above_the_bound_reads_nothing(floor):
    rows = np.random.default_rng(5).integers(-50, 50, (100, 8)).astype(float)
    lists = np.argsort(-rows, axis=0, kind="stable").T
    depths = topk._depths(100)
    bound = topk.bounds(rows[:1], rows, lists, depths)[0]
    places, _ = topk.threshold_search(rows[0], rows, lists, depths, bound, floor, 5, np.ones(100, bool))
    assert (len(places) == 0) == (floor > 0)

"""Hard negatives against plain scoring, the intervals against the scores."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import negatives

SCHEMA = "vec_id long, embedding array<{kind}>, label int, block int, id string, vector string, rank int, floors int"


def whole(vector):
    return [math.floor(256 * Fraction(x)) for x in vector]


def usable(r):
    return r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])


def brute(rows):
    rows = [(r[0], whole(r[1]), (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2]) for r in rows if usable(r)]
    first = lambda found, k: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    out = []
    for i, q, label in rows:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), j, other == label) for j, v, other in rows if j != i]
        for score, j, _ in first([x for x in scored if x[2]], 5):
            inside = [x for x in scored if not x[2] and 50 * score <= 100 * x[0] <= 95 * score]
            out += [(i, j, rank + 1, x[1], score, x[0]) for rank, x in enumerate(first(inside, 3))]
    return sorted(out, key=str)


def check(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, label, 2, "x", "y", 3, 4) for i, v, label in rows], SCHEMA.format(kind=kind))
    got = negatives.report(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(rows)
    return got


def test_awkward_vectors_equal_plain_scoring(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)).astype(np.float32).tolist()
    rows = [(i, x, i % 4) for i, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [None, 1.0], 1), (1050, [float("nan")] * 6, 1), (1100, [float("inf")] + [0.0] * 5, 1), (1150, [], 1), (1200, [0.0] * 6, 2),
             (1250, [1.0, 2.0], 3), (1300, [-1.0] * 9, 3), (-50, [0.25] * 6, 9), (0, [0.1] * 6, 2), (1350, v[3], None), (1351, v[3], 77)]
    rows += [(None, [0.5] * 6, label) for label in (1, 2, 2, None)] + [(77, [1.0] * 6, 1)] * 8 + [(50, v[50], 50 % 4)]
    assert check(spark, rows)


def test_equal_scores_across_blocks_and_one_frequent_label(spark):
    r = random.Random(1)
    assert check(spark, [(i, [float(r.randint(0, 2)), 0.5, float(r.randint(0, 3))], 0 if i % 3 else i % 11) for i in range(5, 16000, 5)])


def test_empty_table_and_anchor_without_positives(spark):
    assert check(spark, []) == []
    assert check(spark, [(50, [1.0, 2.0], 1), (51, [1.0, 2.0], 2)]) == []


@pytest.mark.parametrize("width, scale", [(3, 1.0), (64, 256.0), (130, 1e9)])
def test_intervals_hold_every_score_and_exclude_some(width, scale):
    rng = np.random.default_rng(width)
    rows = np.floor(rng.normal(size=(500, width)) * scale)
    rows[:250] *= 0.01
    rows = np.floor(rows)
    codes, aligned, lengths = negatives.encode(rows)
    out = 0
    for anchor in rows[::25]:
        lower, upper = negatives.Planes(anchor).intervals(codes, aligned, lengths)
        scores = rows @ anchor
        assert (lower <= scores).all() and (scores <= upper).all()
        out += (upper < scores.max()).sum()
    assert out > 0


def test_codes_are_signs_and_alignments_of_the_turned_vectors():
    rows = np.floor(np.random.default_rng(1).normal(size=(40, 70)) * 99)
    codes, aligned, lengths = negatives.encode(rows)
    turned = rows @ negatives.rotation(70)
    signs = np.where(turned >= 0, 1, -1) / np.sqrt(70)
    assert np.allclose((signs * turned).sum(1), aligned) and np.allclose(np.linalg.norm(turned, axis=1), lengths)
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    assert (bits[:, :70] == (turned >= 0)).all() and not bits[:, 70:].any()


def test_windows_are_whole_ends_of_the_shares():
    for positive in [-7, -1, 0, 1, 19, 20, 21, 40, 12345]:
        low, high = negatives.window_of(positive, 50, 95)
        inside = [s for s in range(-20000, 20000) if 50 * positive <= 100 * s <= 95 * positive]
        assert inside == list(range(low, high + 1))

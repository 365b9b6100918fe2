"""The topic fit over tables against a plain batch fit, its bound, and its independence of blocks and partitions."""

import hashlib
import math
import random

import numpy as np
import pytest

from scriptorium.operators import topics

WORDS = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "kappa") for b in ("one", "two", "six", "ten", "nil")]


def corpus(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        own = WORDS[5 * (i % 5):5 * (i % 5) + 5]
        rows.append((i, " ".join(r.choice(own if r.random() < 0.8 else WORDS) for _ in range(r.randint(0, 40)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "the of and"), (n + 3, "alphaone " * 500)]


def psi(x):
    shift = 0.0
    while x < 40:
        shift, x = shift - 1 / x, x + 1
    return shift + math.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4)


PSI = np.vectorize(psi, otypes=[float])
LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def plain_fit(texts, k, passes, updates, change, seed=42):
    """Every document on its own, dense arrays; weights, shares and the bound before each pass."""
    vocab = sorted({w for t in texts for w in (t or "").split() if w in WORDS})
    counts = np.array([[(t or "").split().count(w) for w in vocab] for t in texts], float)
    lam = np.array([[0.5 + int(hashlib.md5(f"{seed}:{j}:{w}".encode()).hexdigest()[:8], 16) / 2 ** 32 for w in vocab] for j in range(k)])
    alpha, bounds = 1 / k, []

    def document(row, beta):
        gamma = np.full(k, alpha + row.sum() / k)
        for _ in range(updates):
            t = np.exp(PSI(gamma) - psi(gamma.sum()))
            new = alpha + t * (beta @ (row / (t @ beta)))
            moved, gamma = np.abs(new - gamma).mean(), new
            if moved < change:
                break
        return gamma

    for _ in range(passes):
        logs = PSI(lam) - PSI(lam.sum(1))[:, None]
        beta, stats, bound = np.exp(logs), np.zeros_like(lam), 0.0
        for row in counts:
            gamma = document(row, beta)
            left = PSI(gamma) - psi(gamma.sum())
            t = np.exp(left)
            stats += t[:, None] * beta * (row / (t @ beta))
            bound += (row * np.log(t @ beta)).sum() + ((alpha - gamma) * left + LGAMMA(gamma) - math.lgamma(alpha)).sum() + math.lgamma(k * alpha) - math.lgamma(gamma.sum())
        bound += ((alpha - lam) * logs + LGAMMA(lam) - math.lgamma(alpha)).sum() + (math.lgamma(len(vocab) * alpha) - LGAMMA(lam.sum(1))).sum()
        bounds.append(bound)
        lam = alpha + stats
    beta = np.exp(PSI(lam) - PSI(lam.sum(1))[:, None])
    shares = np.array([g / g.sum() for g in (document(row, beta) for row in counts)])
    return vocab, lam, shares, bounds


def fitted(spark, rows, partitions=3, **kw):
    df = spark.createDataFrame(rows, "doc long, text string").repartition(partitions)
    fit = topics.fit_topics(df, "doc", "text", **kw)
    weights = {r.term: np.array(r[1:]) for r in fit.weights.collect()}
    shares = {r.id: np.array(r.shares) for r in topics.topic_shares(fit).collect()}
    return fit, weights, shares


@pytest.mark.parametrize("k, updates, change", [(3, 100, 1e-3), (5, 4, 0.0)])
def test_fit_equals_a_plain_batch_fit(spark, k, updates, change):
    rows = corpus(1, 60)
    vocab, lam, want, bounds = plain_fit([t for _, t in rows], k, 4, updates, change)
    fit, weights, shares = fitted(spark, rows, k=k, max_iter=4, doc_updates=updates, doc_change=change, block_tokens=200, track_bound=True)
    assert sorted(weights) == vocab and len(shares) == len(rows)
    assert max(np.abs(weights[w] - lam[:, i]).max() for i, w in enumerate(vocab)) < 1e-6
    assert max(np.abs(shares[i] - want[j]).max() for j, (i, _) in enumerate(rows)) < 1e-6
    assert np.allclose(fit.bounds, bounds, rtol=1e-9)
    assert np.allclose(shares[60], 1 / k) and np.allclose(shares[62], 1 / k)


def test_bound_never_falls(spark):
    fit, _, _ = fitted(spark, corpus(2, 80), k=4, max_iter=6, doc_updates=500, doc_change=1e-9, track_bound=True)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(fit.bounds, fit.bounds[1:])) and fit.bounds[-1] > fit.bounds[0]


def test_blocks_and_partitions_do_not_matter(spark):
    rows = corpus(3, 50)
    _, one, some = fitted(spark, rows, 1, max_iter=3, block_tokens=10 ** 9)
    _, two, others = fitted(spark, rows, 7, max_iter=3, block_tokens=60)
    assert all(np.abs(one[w] - two[w]).max() < 1e-9 for w in one) and one.keys() == two.keys()
    assert all(np.abs(some[i] - others[i]).max() < 1e-9 for i in some)


def test_limited_vocabulary_string_ids_and_nothing_to_count(spark):
    rows = [(f"d{i}", t) for i, t in corpus(4, 20)]
    df = spark.createDataFrame(rows, "doc string, text string")
    fit = topics.fit_topics(df, "doc", "text", max_iter=2, vocab_size=7)
    assert fit.weights.count() == 7 and topics.topic_shares(fit).count() == len(rows)
    for none in (df.where("false"), df.where("text is null")):
        fit = topics.fit_topics(none, "doc", "text", max_iter=2)
        assert fit.weights.count() == 0 and all(r.shares == [0.2] * 5 for r in topics.topic_shares(fit).collect())


def test_special_functions():
    for x in (0.05, 0.2, 1.0, 3.7, 250.0):
        assert abs(topics.digamma(np.float64(x), np.log) - psi(x)) < 1e-10
        assert abs(topics.log_gamma(np.float64(x), np.log) - math.lgamma(x)) < 1e-9


def test_documents_of_all_lengths_settle_as_one_by_one():
    r = np.random.default_rng(5)
    lengths = r.integers(0, 60, 900)
    lengths[7] = 40_000   # longer than what goes side by side
    doc = np.repeat(np.arange(900), lengths)
    n, beta = r.integers(1, 5, len(doc)).astype(float), r.random((3, len(doc))) + 1e-3
    gamma, parts, norm = topics.update_documents(doc, n, beta, 900, 50, 1e-3)
    for d in (0, 7, 8, 500, 899):
        own = doc == d
        alone = topics.update_documents(np.zeros(own.sum(), int), n[own], beta[:, own], 1, 50, 1e-3)
        assert np.allclose(gamma[:, d], alone[0][:, 0], rtol=1e-9) and np.allclose(norm[own], alone[2], rtol=1e-9)
    x = np.array([0.05, 0.2, 1.0, 3.7, 250.0])
    assert np.allclose(topics.exp_digamma(x), np.exp(PSI(x)), rtol=1e-9)

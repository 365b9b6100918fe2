"""Blocks of the topic fit: their terms are those of the token expressions, and a fit leaves no shuffle files behind."""

import glob
import os
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import topic_tokens, vectorizer_terms
from scriptorium.operators import topics

ODD = ["The cat's  (CATS) don't x's. a b\tc\x0bÉtude\fété—dash", "", None, "  \n ", "--.,;!", "n" + "." * 40 + " " + "-" * 30 + "end" + "-" * 30,
       "ΑΣ ΣΑΣ. İstanbul’s ‘quoted’ “x” ½ ² 日本語 日本", "line ends\u0085here's\u0085 now's ", "3.14 a1b2 12th 007 _under_ e-mail x", "A B　C the the"]


def test_pieces_are_cut_at_white_space_and_trimmed():
    sizes, pieces = topics.cut_pieces(pa.array(["x", None, " It's  A.b, (c)", "", "é;Ünï. --x--", "y"]).slice(1, 4))
    assert sizes.tolist() == [0, 3, 0, 2] and pieces.to_pylist() == ["it's", "a.b", "c", "é;Ünï", "x"]


@pytest.mark.parametrize("block_tokens", [3, 10 ** 6])
def test_terms_of_blocks_are_those_of_the_token_expressions(spark, monkeypatch, block_tokens):
    monkeypatch.setattr(topics, "SLICE_BYTES", 50)
    docs = spark.createDataFrame(list(enumerate(ODD * 3)), "doc long, text string")
    want = {r.doc: Counter(r.t) for r in docs.select("doc", vectorizer_terms(topic_tokens(F.col("text"))).alias("t")).collect()}
    got = {}
    blocks = topics.pack_documents(topics.prepare_corpus(docs, "doc", "text", block_tokens)).collect()
    for b in blocks:
        lengths, slot, n = (topics._spread(b[c]).tolist() for c in ("lengths", "slot", "n"))
        at = 0
        for doc, length in zip(b.ids, lengths, strict=True):
            got[doc] = Counter({b.terms[s]: c for s, c in zip(slot[at:at + length], n[at:at + length])})
            at += length
        assert b.terms == sorted(set(b.terms)) and sum(b.counts) == sum(n)
    assert got == want and sum(map(len, want.values())) > 30
    assert len({b.block for b in blocks}) == len(blocks) and (block_tokens > 3 or len(blocks) >= 20)


def test_a_fit_leaves_no_shuffle_files(spark):
    own = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    found = lambda: {f for d in own for f in glob.glob(os.path.join(d, "*", "shuffle_*.data"))}
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 11}") for i in range(200)], "doc long, text string")
    before = found()
    fit = topics.fit_topics(docs, "doc", "text", max_iter=2)
    until = time.time() + 20   # executors are told without waiting
    while found() - before and time.time() < until:
        time.sleep(0.2)
    assert not found() - before and topics.topic_shares(fit).count() == 200


def test_rounds_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"word{(i * j) % 23}" for j in range(i % 30))) for i in range(90)], "doc string, text string").repartition(5)
    def fitted():
        fit = topics.fit_topics(docs, "doc", "text", k=3, max_iter=2, block_tokens=40, track_bound=True)
        return {r.term: r[1:] for r in fit.weights.collect()}, {r.id: r.shares for r in topics.topic_shares(fit).collect()}, fit.bounds
    monkeypatch.setattr(topics, "ROUNDS", 1)
    whole = fitted()
    monkeypatch.setattr(topics, "ROUNDS", 3)
    monkeypatch.setattr(topics, "ROUND_TERMS", 50)
    parts = fitted()
    for a, b in zip(whole[:2], parts[:2]):
        assert a.keys() == b.keys() and all(abs(x - y) < 1e-9 for t in a for x, y in zip(a[t], b[t]))
    assert len(parts[1]) == 90 and all(abs(x - y) < 1e-6 for x, y in zip(whole[2], parts[2], strict=True))

"""Subword tokens: greedy pieces against trying every cut, whole texts against a plain count."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import textops

PIECES = ["a", "ab", "abc", "b", "##b", "##c", "##cd", "##d", "##bcd", "c", "iron", "##ic", "oxide", "1", "##2", ",", "é"]


def plain(word, pieces):
    at, n = 0, 0
    while at < len(word):
        fits = [e for e in range(at + 1, len(word) + 1) if ("##" if at else "") + word[at:e] in pieces]
        if not fits:
            return 1
        at, n = max(fits), n + 1
    return n


def test_greedy_pieces_equal_trying_every_end():
    tries, r = textops.piece_trie(PIECES), random.Random(1)
    words = ["".join(r.choice("abcd12é") for _ in range(r.randint(1, 9))) for _ in range(3000)] + ["ironic", "oxide", "abcd"]
    assert all(textops.word_pieces_count(w, *tries) == plain(w, set(PIECES)) for w in words)
    assert textops.word_pieces_count("a" + "b" * 100, *tries) == 1 and textops.word_pieces_count("a" + "b" * 99, *tries) == 99


def test_whole_texts(spark):
    texts = [None, "", " \n", "Ironic, oxide!", "abcd éa 12 ?? iron", "ab " * 3000]
    vocabulary = spark.createDataFrame([(p,) for p in PIECES + [None, ""]], "piece string")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, lang string")
    got = {r.id: r.n for r in df.select("id", textops.subword_count(F.col("text"), vocabulary).alias("n")).collect()}
    want = {i: 2 + sum(plain(w.lower(), set(PIECES)) for w in re.findall(r"[^\W_]+", t or "")) + len(re.findall(r"[^\w\s]", t or "")) for i, t in enumerate(texts)}
    assert got == want
    row = textops.subword_stats(df, "text", ["lang"], vocabulary).first()
    assert (row.n_docs, row.max_tokens, row.max_model_tokens, row.n_truncated) == (6, 3002, 512, 1)


def test_too_large_a_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(textops, "MAX_PIECES", 2)
    with pytest.raises(ValueError, match="3 pieces"):
        textops.subword_count(F.col("text"), spark.createDataFrame([("a",), ("b",), ("c",)], "piece string"))

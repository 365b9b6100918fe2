"""The Bloom filter before the lexicon join: no term is lost, few others stay."""

import pytest

from scriptorium.operators import chem


def test_no_term_is_lost_and_few_others_stay(spark):
    lexicon = chem.lexicon_table(spark.range(20_000).selectExpr("concat('term ', id) term"))
    grams = spark.range(60_000).selectExpr("id", "concat('term ', id) term", "2 n_words")
    left = [r.id for r in chem.possible_terms(grams, lexicon, 20_000).select("id").collect()]
    assert set(range(20_000)) <= set(left) and len(left) == len(set(left))
    assert 0 < len(left) - 20_000 < 0.01 * 40_000


def test_filter_is_as_large_as_stated(spark):
    lexicon = chem.lexicon_table(spark.range(5000).selectExpr("concat('t', id) term"))
    pages = chem.term_filter(lexicon, 5000).collect()
    assert len(pages) == 3 and all(len(p.bits) == 4096 for p in pages)
    ones = sum(bin(int.from_bytes(p.bits, "big")).count("1") for p in pages)
    assert 0.95 * 5000 * 3 * 0.9 < ones <= 5000 * 3


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_mentions_with_and_without_the_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(chem, "MAX_FILTER_BYTES", limit)
    docs = spark.createDataFrame([(1, "Iron oxide and iron, not tin."), (2, None), (3, "tin tin iron oxide dust"), (4, "")], "id long, text string")
    terms = spark.createDataFrame([("iron",), ("Iron  Oxide",), ("tin",), (None,), (" ",)], "term string")
    got = sorted((r.id, r.pos, r.term) for r in chem.mentions(docs, "id", "text", terms).collect())
    assert got == [(1, 1, "iron oxide"), (1, 4, "iron"), (1, 6, "tin"), (3, 1, "tin"), (3, 2, "tin"), (3, 3, "iron oxide")]


def test_empty_lexicon(spark):
    docs = spark.createDataFrame([(1, "Iron oxide")], "id long, text string")
    assert chem.mentions(docs, "id", "text", spark.createDataFrame([], "term string")).collect() == []


def test_grams_of_a_table_start_at_first_words_only(spark):
    from pyspark.sql import functions as F
    text = "red iron oxide dust " * 50 + "iron"
    docs = spark.createDataFrame([(1, text), (None, text), (None, text)], "id long, text string")
    terms = spark.createDataFrame([("iron oxide dust",), ("iron",), ("oxide tin",), ("Dust Red",)], "term string")
    lexicon = chem.lexicon_table(terms)
    grams = chem.table_grams(docs.select("id", F.split(F.trim("text"), " ").alias("_toks")), "id", lexicon, 4, 3)
    starts = {r.term.split(" ")[0] for r in grams.collect()}
    assert starts <= {"iron", "oxide", "dust"} and "iron" in starts
    got = chem.mentions(docs, "id", "text", terms)
    assert got.where("id = 1").groupBy("term").count().orderBy("term").collect() == [("iron", 1), ("iron oxide dust", 50)]
    cands = chem.candidate_mentions(docs, "id", "text", terms).groupBy("id", "term").count().collect()
    per = {"iron": 51, "iron oxide dust": 50, "dust red": 49}
    assert {(r.id, r.term): r["count"] for r in cands} == {(i, t): n * k for i, k in ((1, 1), (None, 2)) for t, n in per.items()}

"""Mentions: overlap rule, empty result (Q-C4), lookups; session helpers."""


from scriptorium.operators.chem import cache_frame, cache_misses, mention_summary, mentions
from scriptorium.session import widen

LEX = ["collagen", "collagen beta", "beta sheet", "tau", "collagen beta peptide"]
CACHE = [("tau", "C1", "tau protein", "CHEBI:23431"), ("collagen beta peptide", None, None, None)]


def test_overlaps_and_counts(spark):
    docs = spark.createDataFrame([(1, "Collagen beta peptide forms a beta sheet; tau, TAU and collagen."),
                                  (2, "nothing here")], "id long, text string")
    got = sorted((r.id, r.pos, r.term) for r in mentions(docs, "id", "text", LEX).collect())
    # tokens: collagen(1) beta(2) peptide(3) forms(4) a(5) beta(6) sheet(7) tau(8) tau(9) and(10) collagen(11)
    # the longest term at position 1 wins; 'collagen beta' and 'collagen' at 1 are dropped
    assert got == [(1, 1, "collagen beta peptide"), (1, 6, "beta sheet"), (1, 8, "tau"), (1, 9, "tau"),
                   (1, 11, "collagen")]
    summary = {r.Term: r for r in mention_summary(mentions(docs, "id", "text", LEX),
                                                   cache_frame(spark, CACHE), "id").collect()}
    assert summary["tau"].Frequency == 2 and summary["tau"]["ChEBI Class Name"] == "Analgesic"
    assert summary["tau"]["PubChem Info"] == '{"molecular_formula": "C1", "iupac_name": "tau protein"}'
    assert summary["collagen"]["PubChem Info"] == '{"molecular_formula": "N/A", "iupac_name": "N/A"}'
    assert summary["collagen"]["ChEBI Class Name"] == "Unknown Class"
    misses = {r.term for r in cache_misses(mentions(docs, "id", "text", LEX), cache_frame(spark, CACHE)).collect()}
    assert misses == {"collagen", "beta sheet"}


def test_no_mentions_gives_empty_table(spark):
    docs = spark.createDataFrame([(1, "nothing to see")], "id long, text string")
    out = mention_summary(mentions(docs, "id", "text", LEX), cache_frame(spark, CACHE), "id")
    assert out.count() == 0
    assert out.columns == ["Term", "Entity Type", "ChEBI Class", "ChEBI Class Name", "PubChem Info", "Frequency"]


def test_widen_only_when_needed(spark):
    one = spark.range(100).coalesce(1)
    assert widen(one, 4).rdd.getNumPartitions() == 4
    many = spark.range(100).repartition(6)
    assert widen(many, 4) is many

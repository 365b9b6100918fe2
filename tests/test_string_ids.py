"""Ids that are not numbers, through metadata, embeddings, k-NN, SMOTE and the classifier."""

import numpy as np
import pytest

from scriptorium.functions.rules import first_substring_match
from scriptorium.operators.embed import hash_embedding
from scriptorium.operators.vectors import knn, smote, smote_classify
from scriptorium.sources.tables import read_cache_json, read_metadata, read_wide_embeddings, write_cache_json


def test_metadata_ids(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("ID,Abstract\nPMC12,a\n7.0,b\n,c\n")
    assert [r.ID for r in read_metadata(spark, str(p), id_type="string").collect()] == ["PMC12", "7.0", None]
    with pytest.raises(Exception, match="not a number"):
        read_metadata(spark, str(p)).collect()
    p.write_text("ID,Abstract\n 12,a\n,b\n")
    assert [r.ID for r in read_metadata(spark, str(p)).collect()] == [12, None]


def test_wide_embedding_ids(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("ID,a,b\nPMC1,1.0,2.0\n")
    assert read_wide_embeddings(spark, str(p), id_type="string").first().id == "PMC1"
    with pytest.raises(Exception, match="not a number"):
        read_wide_embeddings(spark, str(p)).collect()


def vectors(spark, n=60):
    rng = np.random.default_rng(5)
    rows = [(f"PMC{i}" if i % 3 else f"x{i}", "a" if i % 4 else "b", [float(x) for x in rng.integers(0, 3, 2)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, label string, vec array<double>")


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_knn_with_string_ids(spark, block_rows):
    rows, df = vectors(spark)
    got = {}
    for r in knn(df, df, 4, exclude_self=True, block_rows=block_rows).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.b_id)
    for i, _, v in rows:
        near = sorted((np.linalg.norm(np.subtract(v, w)), j) for j, _, w in rows if j != i)
        assert got[i] == [j for _, j in near[:4]]


def test_classifier_with_string_ids(spark):
    rows, df = vectors(spark)
    new = smote(df, "id", "vec", "label").collect()
    assert len(new) == 30 and len({r.id for r in new}) == 30 and all(r.id.startswith("synthetic-") for r in new)
    for mode, n in (("before_split", 90), ("none", 60)):
        pred, _, n_train = smote_classify(df, "id", "vec", "label", mode)
        done = pred.collect()
        assert n_train + len(done) == n and all(r.prediction in ("a", "b") for r in done)
    pred, _, _ = smote_classify(df, "id", "vec", "label", "none", method="lsh")
    assert all(r.prediction in ("a", "b") for r in pred.collect())


def test_json_cache(spark, tmp_path):
    one = tmp_path / "one"
    one.mkdir()
    (one / "api_cache.json").write_text('{\n "water": {"molecular_formula": "H2O", "iupac_name": "oxidane"},\n "x": {"iupac_name": null}\n}')
    assert sorted(map(tuple, read_cache_json(spark, str(one)).collect())) == [("water", "H2O", "oxidane", None), ("x", None, None, None)]
    rows = [(f"t{i}", None if i % 2 else "C", 'say "x"\n', f"CHEBI:{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "term string, molecular_formula string, iupac_name string, chebi_class string")
    write_cache_json(df, str(tmp_path / "many"), n_objects=4)
    assert sorted(map(tuple, read_cache_json(spark, str(tmp_path / "many")).collect())) == sorted(rows)
    (one / "api_cache.json").write_text('{"water": {"molecular_formula"')
    with pytest.raises(Exception):
        read_cache_json(spark, str(one)).collect()


def test_rules_with_quotes_and_backslashes(spark):
    rules = [("cote d'ivoire", "Côte d'Ivoire"), ("a\\b", "back"), ("x", "y")]
    df = spark.createDataFrame([("in cote d'ivoire x",), ("a\\b",), ("x",), ("z",)], "t string")
    assert [r[0] for r in df.select(first_substring_match(df.t, rules)).collect()] == ["Côte d'Ivoire", "back", "y", None]


def test_hash_embedding_counts(spark):
    df = spark.createDataFrame([("a b b c a a",), ("",), (None,)], "t string")
    full, empty, none = [r[0] for r in df.select(hash_embedding(df.t, 8)).collect()]
    assert none is None and empty == [0.0] * 8 and abs(sum(x * x for x in full) - 1) < 1e-9

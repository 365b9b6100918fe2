import pytest
from pyspark.sql import functions as F

from scriptorium.sources.tables import (append_cache, read_cache, read_metadata, read_wide_embeddings,
                                        require_columns, require_rows, require_unique)


def test_metadata_csv_with_na_tokens(spark, tmp_path):
    p = tmp_path / "metadata.csv"
    p.write_text('ID,Abstract,Affiliations,Publication_Date\n1,"multi\nline",NA,2020-01-01\n2,,"Rome, Italy",n/a\n')
    df = read_metadata(spark, str(p), required=["ID", "Affiliations"])
    rows = sorted(df.collect(), key=lambda r: r.ID)
    assert rows[0].Abstract == "multi\nline" and rows[0].Affiliations is None
    assert rows[1].Publication_Date is None and rows[1].Affiliations == "Rome, Italy"


def test_guards(spark):
    df = spark.createDataFrame([(1,)], "ID long")
    with pytest.raises(ValueError):
        require_columns(df, ["ID", "Abstract"])
    with pytest.raises(ValueError):
        require_rows(df.where(F.lit(False)))
    assert require_rows(df) is df


def test_wide_embeddings(spark, tmp_path):
    p = tmp_path / "emb.csv"
    p.write_text("ID,f0,f1,f2\n7,0.5,1.5,2.5\n8,1,2,3\n")
    got = {r.id: r.embedding for r in read_wide_embeddings(spark, str(p)).collect()}
    assert got == {7: [0.5, 1.5, 2.5], 8: [1.0, 2.0, 3.0]}


def test_cache_absent_then_appended_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache = read_cache(spark, path)
    assert cache.count() == 0
    new = spark.createDataFrame([("caffeine", "C8H10N4O2", "x", None), ("caffeine", "C8H10N4O2", "x", None)],
                                "term string, molecular_formula string, iupac_name string, chebi_class string")
    assert append_cache(new, cache, path).count() == 1
    again = append_cache(new, read_cache(spark, path), path)
    assert again.count() == 0 and read_cache(spark, path).count() == 1


def test_csv_sink_and_raw_landing(spark, tmp_path):
    from scriptorium.sources.tables import land_raw, write_csv
    df = spark.createDataFrame([("Italy", 3), ("Oman", 1)], "Country string, Count long")
    write_csv(df, str(tmp_path / "freq"))
    back = spark.read.option("header", True).csv(str(tmp_path / "freq"))
    assert back.columns == ["Country", "Count"] and back.count() == 2
    raw = spark.createDataFrame([(0, "<x/>"), (1, "<y/>")], "batch int, payload string")
    land_raw(raw, str(tmp_path / "raw"))
    assert sorted(p.name for p in (tmp_path / "raw").iterdir() if p.name.startswith("batch=")) == ["batch=0", "batch=1"]


def test_duplicate_ids_are_refused(spark):
    ok = spark.createDataFrame([(1,), (2,)], "ID long")
    assert require_unique(ok, "ID") is ok
    with pytest.raises(ValueError, match="duplicate ID 2"):
        require_unique(spark.createDataFrame([(1,), (2,), (2,)], "ID long"), "ID")


def test_csv_columns_matched_by_name(spark, tmp_path):
    p = tmp_path / "meta.csv"
    p.write_text("Affiliations,extra,ID\n\"Rome, Italy\",x,5\n")
    df = read_metadata(spark, str(p), required=["ID", "Affiliations"])
    row = df.first()
    assert row.ID == 5 and row.Affiliations == "Rome, Italy" and row.Abstract is None
    with pytest.raises(ValueError, match="Abstract"):
        read_metadata(spark, str(p), required=["ID", "Abstract"])

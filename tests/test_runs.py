"""End-to-end runs on files written from the fixture tables."""

import os

from pyspark.sql import functions as F

from scriptorium.plans import runs
from scriptorium.plans.q_chem import CACHE, LEXICON
from scriptorium.plans.standins import AFFILIATION_TEMPLATES, CORRUPT_EVERY, citation_xml, pick, publication_dates
from scriptorium.session import read_table
from scriptorium.sources.tables import write_csv


def make_inputs(spark, sf_dir, root):
    docs = read_table(spark, sf_dir, "documents")
    pubs = publication_dates(read_table(spark, sf_dir, "orders"))
    meta = (docs.join(pubs, docs.doc_id == pubs.ID)
            .select(F.col("doc_id").alias("ID"), F.col("text").alias("Abstract"),
                    pick(AFFILIATION_TEMPLATES, F.col("doc_id")).alias("Affiliations"), "Publication_Date"))
    write_csv(meta, os.path.join(root, "metadata"))
    emb = read_table(spark, sf_dir, "embeddings")
    write_csv(emb.select(F.col("vec_id").alias("ID"), *[F.col("embedding")[i].alias(f"f{i}") for i in range(64)]),
              os.path.join(root, "embeddings"))
    write_csv(docs.select(F.get(F.split("text", "\n"), 0).alias("Title")), os.path.join(root, "patents"))
    citation_xml(docs).select("raw").repartition(3).write.text(os.path.join(root, "xml"))
    docs.select(F.col("doc_id").cast("string").alias("value")).write.text(os.path.join(root, "pmids"))
    spark.createDataFrame(CACHE, "term string, molecular_formula string, iupac_name string, chebi_class string") \
        .write.parquet(os.path.join(root, "cache"))
    return meta


def test_all_runs(spark, sf_dir, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    meta = make_inputs(spark, sf_dir, root)
    n_docs = meta.count()

    recs = runs.citation_run(spark, os.path.join(root, "xml"), os.path.join(root, "pmids"), out)
    missing = spark.read.text(os.path.join(out, "missing_abstracts")).count()
    assert recs.count() + missing == n_docs and missing == n_docs // CORRUPT_EVERY
    stored = runs.embedding_run(spark, os.path.join(out, "unique_abstracts"), os.path.join(out, "store"))
    assert 0 < stored <= recs.count()

    freq = runs.country_run(spark, os.path.join(root, "metadata"), out)
    assert freq.count() > 5
    summary = runs.compound_run(spark, os.path.join(root, "metadata"), LEXICON, os.path.join(root, "cache"), out)
    assert summary.count() > 0
    assert len(runs.topic_run(spark, os.path.join(root, "metadata"), out, years=(1996, 1998)).collect()) == 5
    assert len(runs.patent_topic_run(spark, os.path.join(root, "patents"), out).collect()) == 5

    knn_summary, rep = runs.classification_run(spark, os.path.join(root, "embeddings"),
                                               os.path.join(root, "metadata"), out)
    row = knn_summary.first()
    assert row.Mitigation == "SMOTE" and row.k == 5 and 0 <= row.Accuracy <= 1
    assert {"accuracy", "macro avg", "weighted avg", "1990", "2000"} <= {r["class"] for r in rep.collect()}
    for name in ("abstracts", "country_frequency", "compounds_summary", "topic_frequencies", "knn_results"):
        assert os.path.isdir(os.path.join(out, name))

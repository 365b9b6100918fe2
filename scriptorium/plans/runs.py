"""End-to-end runs, file in → file out, one per workflow of the reference.

Each run composes the operators of this package; nothing here is a new
operator.  Paths may be local folders or shared storage; outputs are written
by Spark (one folder per output table).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.dates import in_year_range, label_or_decade, pub_year
from scriptorium.operators.chem import cache_misses, mention_summary, mentions
from scriptorium.operators.embed import embed_increment, hash_embedding
from scriptorium.operators.evaluate import confusion, report, run_summary
from scriptorium.operators.geo import country_frequency
from scriptorium.operators.textops import dedupe_exact
from scriptorium.operators.topics import fit_topics, topic_table
from scriptorium.operators.vectors import smote_classify
from scriptorium.sources.citations import (missing_ids, read_blocks, read_citations, read_id_list,
                                           write_blocks, write_id_list)
from scriptorium.sources.tables import (read_cache, read_csv, read_metadata, read_wide_embeddings, require_rows,
                                        require_unique, write_csv)


def unique_records(recs: DataFrame) -> DataFrame:
    """U4: one record per distinct abstract; records without an abstract all stay."""
    fields = ["title", "authors", "abstract", "journal", "pub_date"]
    text = F.when(F.col("abstract") != F.lit(fv.NO_ABSTRACT), F.col("abstract"))
    return dedupe_exact(recs.withColumn("_text", text), "_text", "pmid", fields).select("pmid", *fields)


def citation_run(spark: SparkSession, xml_path: str, ids_path: str, out_dir: str) -> DataFrame:
    """Citation files + requested ids → text blocks and missing-id list."""
    # parsed once: the records are written and read back for the other outputs
    parsed = os.path.join(out_dir, "records")
    read_citations(spark, xml_path).write.mode("overwrite").parquet(parsed)
    recs = spark.read.parquet(parsed)
    write_blocks(recs, os.path.join(out_dir, "abstracts"))
    write_blocks(unique_records(recs), os.path.join(out_dir, "unique_abstracts"))
    missing = missing_ids(read_id_list(spark, ids_path), recs)
    write_id_list(missing, os.path.join(out_dir, "missing_abstracts"))
    return recs


def embedding_run(spark: SparkSession, blocks_path: str, store_path: str, embedder=hash_embedding) -> int:
    """Text blocks → keyed embedding store; resumes where the store stops."""
    blocks = read_blocks(spark, blocks_path)
    return embed_increment(spark, blocks.select("pmid", "block"), "pmid", "block", store_path, embedder)


def country_run(spark: SparkSession, metadata_csv: str, out_dir: str) -> DataFrame:
    """Affiliations → country frequency table."""
    meta = read_metadata(spark, metadata_csv, required=["Affiliations"], id_type="string")
    freq = country_frequency(meta, "Affiliations")
    write_csv(freq, os.path.join(out_dir, "country_frequency"))
    return freq


def compound_run(spark: SparkSession, metadata_csv: str, lexicon: Sequence[str], cache_path: str,
                 out_dir: str) -> DataFrame:
    """Abstract mentions → looked-up compound summary (+ names to look up)."""
    meta = read_metadata(spark, metadata_csv, required=["ID", "Abstract"], id_type="string")
    ment = mentions(meta.where(F.col("Abstract").isNotNull()), "ID", "Abstract", lexicon)
    cache = read_cache(spark, cache_path)
    summary = mention_summary(ment, cache, "ID")
    write_csv(summary, os.path.join(out_dir, "compounds_summary"))
    write_csv(cache_misses(ment, cache), os.path.join(out_dir, "lookup_needed"))
    return summary


def topic_run(spark: SparkSession, metadata_csv: str, out_dir: str,
              years: tuple[int, int] = fv.YEAR_RANGE) -> DataFrame:
    """Abstracts published in ``years`` → topic table."""
    meta = read_metadata(spark, metadata_csv, required=["ID", "Abstract", "Publication_Date"], id_type="string")
    dated = meta.withColumn("year", pub_year(F.col("Publication_Date")))
    chosen = require_rows(dated.where(in_year_range(F.col("year"), *years)), "abstracts in the year range")
    table = topic_table(fit_topics(chosen, "ID", "Abstract"))
    write_csv(table, os.path.join(out_dir, "topic_frequencies"))
    return table


def patent_topic_run(spark: SparkSession, patents_csv: str, out_dir: str) -> DataFrame:
    """Patent titles → topic table."""
    schema = T.StructType([T.StructField("Title", T.StringType())])
    # keyed by content, so the topics do not depend on how the files were split
    titles = (read_csv(spark, patents_csv, schema).where(F.col("Title").isNotNull())
              .groupBy("Title").agg(F.count(F.lit(1)).alias("n"))
              .select("Title", F.explode(F.expr("sequence(1L, n)")).alias("copy"))
              .withColumn("pid", F.xxhash64("Title", "copy")))
    table = topic_table(fit_topics(titles, "pid", "Title"))
    write_csv(table, os.path.join(out_dir, "patent_topic_frequencies"))
    return table


def classification_run(spark: SparkSession, embeddings_csv: str, metadata_csv: str, out_dir: str,
                       oversample_mode: str = "before_split", method: str = "exact") -> tuple[DataFrame, DataFrame]:
    """Wide embeddings + metadata → SMOTE (or none) → split → k-NN → run summary
    and per-class report.  Ids may be of any form.  The label is the metadata's ``label`` column, else
    the publication decade."""
    emb = require_unique(read_wide_embeddings(spark, embeddings_csv, "ID", id_type="string"), "id", "embeddings")
    meta = require_unique(read_metadata(spark, metadata_csv, required=["ID"], id_type="string"), "ID", "metadata")
    year = pub_year(F.col("Publication_Date"))
    labelled = (meta.withColumn("year", year)
                .withColumn("label", label_or_decade(F.col("label"), F.col("year")))
                .where(F.col("label").isNotNull()))
    aligned = require_rows(emb.join(labelled.select(F.col("ID").alias("id"), "label"), "id"), "aligned data")
    pred, k, n_train = smote_classify(aligned, "id", "embedding", "label", oversample_mode, method=method)
    mitigation = {"before_split": fv.MITIGATION, "none": fv.NO_OVERSAMPLING}.get(oversample_mode, f"{fv.MITIGATION} ({oversample_mode})")
    summary = run_summary(pred, n_train, k, mitigation=mitigation)
    rep = report(confusion(pred))
    write_csv(summary, os.path.join(out_dir, "knn_results"))
    write_csv(rep, os.path.join(out_dir, "classification_report"))
    return summary, rep

"""Registered queries: file sources and sinks.

Each query lands a driver table as files in a fresh folder under the shared
checkpoint location, reads them back with the library's source, and returns
what a user would get.  The oracle is written over the driver table itself.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from scriptorium.operators.embed import embed_increment, embed_increment_table, model_embedding, read_store
from scriptorium.plans.q_citations import _EXPECTED
from scriptorium.plans.q_embed import ORACLE as EMBED_ORACLE
from scriptorium.plans.standins import CORRUPT_EVERY, citation_xml
from scriptorium.session import read_table
from scriptorium.sources.citations import (RECORD_TAG, parse_raw, quarantine, read_blocks, read_citations, read_raw_records,
                                           records, write_blocks)
from scriptorium.sources.tables import (land_raw, read_cache_json, read_metadata, read_wide_embeddings, write_cache_json,
                                        write_csv)
from scriptorium.streaming.ingest import work_dir

#: Entries of one JSON object of the landed cache, about.
CACHE_ENTRIES = 5000
BATCHES = 4


def _citation_files(spark, sf_dir) -> str:
    landing = os.path.join(work_dir(spark, "citation-files"), "landing")
    citation_xml(read_table(spark, sf_dir, "documents")).select("raw").write.text(landing)
    return landing


def citation_files_parse_q(spark, sf_dir):
    """S1 from files, with truncated records between whole ones."""
    return read_citations(spark, _citation_files(spark, sf_dir))


def citation_files_quarantine_q(spark, sf_dir):
    """F8, K7 from files: the truncated records, each once."""
    bad = quarantine(parse_raw(read_raw_records(spark, _citation_files(spark, sf_dir))))
    # a record cut off at the end of a file has the closing tag put back
    cut = F.regexp_replace("raw", rf"\s*(?:</{RECORD_TAG}>)?\s*$", "")
    return bad.select(F.regexp_extract("raw", r"<PMID[^>]*>([0-9]+)</PMID>", 1).alias("pmid"), F.length(cut).alias("raw_chars"))


def blocks_roundtrip_q(spark, sf_dir):
    """Records written as text blocks and read back."""
    path = os.path.join(work_dir(spark, "blocks"), "blocks")
    write_blocks(records(parse_raw(citation_xml(read_table(spark, sf_dir, "documents")))), path)
    return read_blocks(spark, path).drop("block")


def csv_roundtrip_q(spark, sf_dir):
    """K4, S3: metadata with whole texts (line feeds, quotes) through CSV."""
    path = os.path.join(work_dir(spark, "csv"), "metadata")
    docs = read_table(spark, sf_dir, "documents")
    write_csv(docs.select(F.col("lang").alias("label"), F.col("text").alias("Abstract"), F.col("doc_id").alias("ID")), path)
    return read_metadata(spark, path, ["ID", "Abstract"]).select(
        F.col("ID").cast("bigint").alias("doc_id"), "label", F.md5("Abstract").alias("text_md5"))


def wide_embeddings_q(spark, sf_dir):
    """One CSV column a feature."""
    path = os.path.join(work_dir(spark, "wide"), "embeddings")
    emb = read_table(spark, sf_dir, "embeddings")
    dims = emb.agg(F.max(F.size("embedding"))).first()[0] or 0
    write_csv(emb.select(F.col("vec_id").alias("ID"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(dims)]), path)
    return read_wide_embeddings(spark, path).select(
        F.col("id").alias("vec_id"), F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def cache_json_q(spark, sf_dir):
    """The lookup cache as JSON objects of name → answer."""
    path = os.path.join(work_dir(spark, "cache"), "json")
    part = read_table(spark, sf_dir, "part")
    n = part.count()
    rows = part.select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("term"),
        F.when(F.pmod("p_partkey", F.lit(7)) != 0, F.col("p_brand")).alias("molecular_formula"),
        F.concat(F.lit('a "quoted" '), F.col("p_type")).alias("iupac_name"),
        F.when(F.pmod("p_partkey", F.lit(3)) != 0, F.concat(F.lit("CHEBI:"), F.col("p_size").cast("string"))).alias("chebi_class"))
    write_cache_json(rows, path, n_objects=-(-n // CACHE_ENTRIES))
    return read_cache_json(spark, path)


def store_resume_q(spark, sf_dir):
    """A run that stopped half-way is resumed; nothing is embedded twice."""
    store = os.path.join(work_dir(spark, "store"), "store")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    embed_increment(spark, docs.where(F.pmod("doc_id", F.lit(2)) == 0), "doc_id", "text", store)
    embed_increment(spark, docs, "doc_id", "text", store)
    return read_store(spark, store).select(
        F.col("id").alias("doc_id"), F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def store_resume_table_q(spark, sf_dir):
    """The same through a table bucketed by id, whose rows stay where they are."""
    table = f"embedding_store_{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    embed_increment_table(spark, docs.where(F.pmod("doc_id", F.lit(2)) == 0), "doc_id", "text", table)
    embed_increment_table(spark, docs, "doc_id", "text", table)
    return spark.table(table).select(
        F.col("id").alias("doc_id"), F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def raw_landing_q(spark, sf_dir):
    """K3: raw payloads kept as data, one folder a batch."""
    path = os.path.join(work_dir(spark, "raw"), "raw")
    docs = read_table(spark, sf_dir, "documents")
    land_raw(docs.select("doc_id", F.col("text").alias("raw"), F.pmod("doc_id", F.lit(BATCHES)).alias("batch")), path)
    return spark.read.parquet(path).select("doc_id", F.col("batch").cast("bigint").alias("batch"), F.md5("raw").alias("raw_md5"))


def _letter_counter():
    """A fixed small model: characters, blanks and letters e of each text."""
    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([[len(t), t.count(" "), t.count("e")] for t in texts.ravel()], np.float32).reshape(-1, 3)
    return predict


def model_embedding_q(spark, sf_dir):
    """T5: a batch model over a text column."""
    docs = read_table(spark, sf_dir, "documents")
    model = model_embedding(_letter_counter, 3)
    return docs.select("doc_id", model(F.coalesce("text", F.lit(""))).cast("array<double>").alias("embedding"))


_COUNT = "CAST(length({t}) - length(replace({t}, '{c}', '')) AS DOUBLE)"

ORACLE = {
    "citation_files_parse": f"WITH {_EXPECTED} SELECT * FROM expected",
    "citation_files_quarantine": f"""
SELECT CAST(doc_id AS VARCHAR) AS pmid, 120 AS raw_chars FROM documents
WHERE doc_id % {CORRUPT_EVERY} = {CORRUPT_EVERY - 1}""",
    "blocks_roundtrip": f"WITH {_EXPECTED} SELECT * FROM expected",
    "csv_roundtrip": "SELECT doc_id, lang AS label, CASE WHEN text <> '' THEN md5(text) END AS text_md5 FROM documents",
    "wide_embeddings": "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS embedding FROM embeddings",
    "cache_json": """
SELECT p_name || ' ' || p_partkey AS term, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS molecular_formula,
       'a "quoted" ' || p_type AS iupac_name, CASE WHEN p_partkey % 3 <> 0 THEN 'CHEBI:' || p_size END AS chebi_class
FROM part""",
    "store_resume": EMBED_ORACLE["hash_embedding"],
    "store_resume_table": EMBED_ORACLE["hash_embedding"],
    "raw_landing": f"SELECT doc_id, CAST(doc_id % {BATCHES} AS BIGINT) AS batch, md5(text) AS raw_md5 FROM documents",
    "model_embedding": f"""
SELECT doc_id, [CAST(length(t) AS DOUBLE), {_COUNT.format(t='t', c=' ')}, {_COUNT.format(t='t', c='e')}] AS embedding
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
}

QUERIES = {
    "citation_files_parse": citation_files_parse_q,
    "citation_files_quarantine": citation_files_quarantine_q,
    "blocks_roundtrip": blocks_roundtrip_q,
    "csv_roundtrip": csv_roundtrip_q,
    "wide_embeddings": wide_embeddings_q,
    "cache_json": cache_json_q,
    "store_resume": store_resume_q,
    "store_resume_table": store_resume_table_q,
    "raw_landing": raw_landing_q,
    "model_embedding": model_embedding_q,
}

"""Registered queries: citation XML parse, export blocks, quarantine, missing ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.operators.trends import part_frequency
from scriptorium.plans.q_text import sql_remove_phrases
from scriptorium.plans.sqltext import str_list
from scriptorium.plans.standins import (CORRUPT_EVERY, FORENAMES, JOURNALS, SECTION_HEADINGS, SURNAMES,
                                        citation_xml, requested_id_lines)
from scriptorium.session import read_table, widen
from scriptorium.sources.citations import missing_ids, parse_id_lines, parse_raw, quarantine, records, render_block


def _parsed(spark, sf_dir):
    return parse_raw(citation_xml(widen(read_table(spark, sf_dir, "documents"))))


def citation_parse_q(spark, sf_dir):
    return records(_parsed(spark, sf_dir))


def citation_export_q(spark, sf_dir):
    return render_block(records(_parsed(spark, sf_dir)))


def citation_quarantine_q(spark, sf_dir):
    q = quarantine(_parsed(spark, sf_dir))
    return q.select(F.regexp_extract("raw", r"<PMID[^>]*>([0-9]+)</PMID>", 1).alias("pmid"), "raw_chars")


def author_frequency_q(spark, sf_dir):
    """Authors of the parsed records, split on ``; `` and counted;
    the sentinels (no author, unnamed author) are not authors."""
    recs = records(_parsed(spark, sf_dir)).where(F.col("authors") != F.lit(fv.NO_AUTHORS))
    counts = part_frequency(recs, "authors", "; ", "author")
    return counts.where(F.col("author") != F.lit(fv.NO_NAME))


def citation_missing_q(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    requested = docs.select(F.col("doc_id").cast("string").alias("pmid"))
    return missing_ids(requested, records(_parsed(spark, sf_dir)))


def missing_ids_q(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    requested = parse_id_lines(requested_id_lines(docs))
    received = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("pmid"))
    return missing_ids(requested, received)


def _clean(x):
    return f"replace(replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\"', ''), '''', '')"


_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_EXPECTED = f"""lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
  WHERE doc_id % {CORRUPT_EVERY} <> {CORRUPT_EVERY - 1}),
parts AS (
  SELECT doc_id, {_TRIM.format(x='l[1]')} AS title,
         list_filter(list_transform(l[2:], lambda s: {_TRIM.format(x='s')}), lambda s: s <> '') AS secs
  FROM lines),
expected AS (
  SELECT CAST(doc_id AS VARCHAR) AS pmid,
         CASE WHEN title = '' THEN 'No Title' ELSE title END AS title,
         CASE WHEN doc_id % 4 = 0 THEN 'No Authors' ELSE array_to_string(list_transform(range(doc_id % 4),
           lambda j: CASE WHEN (doc_id + j) % 7 = 0 THEN 'No Name'
                          ELSE {_clean(f'{str_list(SURNAMES)}[(doc_id + j) % {len(SURNAMES)} + 1]')} || ', ' ||
                               {_clean(f'{str_list(FORENAMES)}[(doc_id * 3 + j) % {len(FORENAMES)} + 1]')} END), '; ')
         END AS authors,
         CASE WHEN len(secs) = 0 THEN 'No Abstract'
              ELSE {sql_remove_phrases(_TRIM.format(x=f"array_to_string(list_concat([{_TRIM.format(x=f'{str_list(SECTION_HEADINGS)}[doc_id % {len(SECTION_HEADINGS)} + 1] || secs[1]')}], secs[2:]), ' ')"))}
         END AS abstract,
         CASE WHEN doc_id % 10 = 9 THEN 'No Journal'
              ELSE {_clean(f'{str_list(JOURNALS)}[doc_id % {len(JOURNALS)} + 1]')} END AS journal,
         CASE WHEN doc_id % 11 = 5 THEN 'No Date' ELSE CAST(1990 + doc_id % 36 AS VARCHAR) END AS pub_date
  FROM parts)"""

_BLOCK_SQL = """'Abstract #' || pmid || chr(10) || 'Title: ' || title || chr(10) || 'Authors: ' || authors || chr(10)
       || 'Abstract: ' || abstract || chr(10) || 'Journal: ' || journal || chr(10)
       || 'Publication Date: ' || pub_date || chr(10)"""

ORACLE = {
    "citation_parse": f"WITH {_EXPECTED} SELECT * FROM expected",
    "citation_export": f"""WITH {_EXPECTED}
SELECT pmid, {_BLOCK_SQL} AS block FROM expected""",
    "author_frequency": f"""WITH {_EXPECTED}
SELECT author, count(*) AS n FROM (SELECT trim(unnest(string_split(authors, '; '))) AS author FROM expected
                                   WHERE authors <> 'No Authors')
WHERE author <> 'No Name' AND author <> '' GROUP BY author""",
    "citation_quarantine": f"""
SELECT CAST(doc_id AS VARCHAR) AS pmid, 120 AS raw_chars FROM documents
WHERE doc_id % {CORRUPT_EVERY} = {CORRUPT_EVERY - 1}""",
    "citation_missing": f"""
SELECT CAST(doc_id AS VARCHAR) AS pmid FROM documents WHERE doc_id % {CORRUPT_EVERY} = {CORRUPT_EVERY - 1}""",
    "missing_ids": """
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS pmid FROM documents
WHERE doc_id % 17 <> 0 OR doc_id % 13 = 0
EXCEPT SELECT CAST(doc_id AS VARCHAR) FROM labels""",
}

QUERIES = {
    "citation_parse": citation_parse_q,
    "citation_export": citation_export_q,
    "citation_quarantine": citation_quarantine_q,
    "citation_missing": citation_missing_q,
    "author_frequency": author_frequency_q,
    "missing_ids": missing_ids_q,
}

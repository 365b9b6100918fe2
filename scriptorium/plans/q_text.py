"""Registered queries: text cleaning, tokens, vocabulary, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.text import remove_forbidden_phrases
from scriptorium.operators.textops import (dedupe_exact, group_term_counts, subword_stats, term_counts, token_stats,
                                          top_terms, vocabulary)
from scriptorium.plans.sqltext import q, str_list
from scriptorium.plans.standins import pick
from scriptorium.session import read_table, widen

# --- FIXED VALUES: headings inserted into documents for the phrase filter -----
# (first at the start of the text, second after every line break)
HEADINGS = [
    "BACKGROUND: ",
    "<strong>BACKGROUND</strong> ",
    "Methods: ",
    "results:",
    "[Figurre: see text]",
    "• ",
    "Materials and methods: ",
    "CONCLUSION: ",
    "[reaction: see text] ",
    "",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(read_table(spark, sf_dir, "documents"))


def with_headings(docs: DataFrame) -> DataFrame:
    first = pick(HEADINGS, F.col("doc_id"))
    later = pick(HEADINGS, F.col("doc_id") + 3)
    body = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), later))
    return docs.select("doc_id", F.concat(first, body).alias("text"))


def forbidden_phrases_q(spark, sf_dir):
    docs = with_headings(documents(spark, sf_dir))
    return docs.select("doc_id", remove_forbidden_phrases(F.col("text")).alias("abstract"))


def processed_text_q(spark, sf_dir):
    """P11 + P12: the token list of each document joined back to text."""
    from scriptorium.functions.text import join_tokens, topic_tokens
    return documents(spark, sf_dir).select("doc_id", join_tokens(topic_tokens(F.col("text"))).alias("processed_text"))


def dedupe_records_q(spark, sf_dir):
    return dedupe_exact(documents(spark, sf_dir), "text", "doc_id", ["lang", "source", "n_chars"])


def token_stats_q(spark, sf_dir):
    return token_stats(documents(spark, sf_dir), "text", ["lang"])


_SINGLE = "abcdefghijklmnopqrstuvwxyz0123456789"


def piece_vocabulary(part: DataFrame) -> DataFrame:
    """Stand-in for a model's vocabulary: the words of part names, their first and (to
    continue) last three letters, and letters and digits either way."""
    word = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).where("w <> ''").distinct()
    forms = F.array("w", F.substring("w", 1, 3), F.concat(F.lit("##"), F.right("w", F.lit(3))))
    single = F.split(F.lit(_SINGLE), "")
    singles = part.sparkSession.range(1).select(F.explode(F.concat(single, F.transform(single, lambda c: F.concat(F.lit("##"), c)))).alias("piece"))
    return word.select(F.explode(forms).alias("piece")).union(singles).where("piece NOT IN ('', '##')").distinct()


def subword_stats_q(spark, sf_dir):
    return subword_stats(documents(spark, sf_dir), "text", ["lang"], piece_vocabulary(read_table(spark, sf_dir, "part")))


def doc_term_counts_q(spark, sf_dir):
    return term_counts(documents(spark, sf_dir), "doc_id", "text")


def vocabulary_q(spark, sf_dir):
    return vocabulary(term_counts(documents(spark, sf_dir), "doc_id", "text"), "doc_id")


def top_terms_per_group_q(spark, sf_dir):
    return top_terms(group_term_counts(documents(spark, sf_dir), "lang", "text"), "lang", 10)


# --- oracle ------------------------------------------------------------------

def re2_escape(s: str) -> str:
    return "".join("\\" + ch if ch in "\\^$.|?*+()[]{}" else ch for ch in s)


def sql_remove_phrases(expr: str) -> str:
    out = expr
    for p in fv.FORBIDDEN_PHRASES:
        pat = r"(<.*?>)*\s*" + re2_escape(p) + r"\s*(</.*?>)*"
        out = f"regexp_replace({out}, {q(pat)}, ' ', 'gi')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


STOP_SQL = str_list(fv.ENGLISH_STOP_WORDS)
SQL_TOPIC_TOKENS = (
    "list_filter(list_transform(string_split_regex(lower({x}), '\\s+'), "
    "lambda t: regexp_replace(regexp_replace(t, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), "
    "'[''’]s$', '')), "
    "lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+') AND NOT list_contains(" + STOP_SQL.replace("{", "{{").replace("}", "}}") + ", t))"
)


def sql_topic_tokens(x: str) -> str:
    return SQL_TOPIC_TOKENS.format(x=x)


def sql_terms(x: str) -> str:
    return f"list_filter({sql_topic_tokens(x)}, lambda t: length(t) >= 2)"


SQL_WORD_PIECES = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"

_HEAD = str_list(HEADINGS)
DOC_TERMS = f"""doc_terms AS (
  SELECT doc_id, term, count(*) AS n
  FROM (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents)
  GROUP BY doc_id, term)"""

_SUBWORDS = f"""pieces AS (
  SELECT DISTINCT piece FROM (
    SELECT unnest([w, substr(w, 1, 3), '##' || right(w, 3)]) AS piece FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> ''
    UNION ALL SELECT unnest(list_concat(string_split('{_SINGLE}', ''), list_transform(string_split('{_SINGLE}', ''), lambda c: '##' || c))))),
doc_words AS (SELECT doc_id, unnest({SQL_WORD_PIECES.format(x='text')}) AS w FROM documents),
cut AS (
  SELECT w, 0::bigint AS done, 0::bigint AS n FROM (SELECT DISTINCT w FROM doc_words)
  UNION ALL
  SELECT w, done + coalesce(max(l) FILTER (p.piece IS NOT NULL), 1000), n + 1
  FROM cut JOIN (SELECT unnest(range(1, 101)) AS l) ON l <= length(w) - done
  LEFT JOIN pieces p ON p.piece = CASE WHEN done = 0 THEN '' ELSE '##' END || substr(w, done + 1, l)
  WHERE done < length(w) AND length(w) <= 100 GROUP BY w, done, n),
per_word AS (SELECT w, CASE WHEN length(w) > 100 OR max(done) > length(w) THEN 1 ELSE max(n) END AS n FROM cut GROUP BY w),
per_doc AS (
  SELECT d.doc_id, any_value(d.lang) AS lang, 2 + coalesce(sum(p.n), 0)
         + any_value(length(regexp_replace(coalesce(d.text, ''), '[\\p{{L}}\\p{{N}} \\t\\n\\r]', '', 'g'))) AS n
  FROM documents d LEFT JOIN doc_words w USING (doc_id) LEFT JOIN per_word p USING (w) GROUP BY d.doc_id)"""

ORACLE = {
    "subword_stats": f"""WITH RECURSIVE {_SUBWORDS}
SELECT lang, count(*) AS n_docs, round(avg(n), 6) AS avg_tokens, max(n)::bigint AS max_tokens,
       round(avg(least(n, 512)), 6) AS avg_model_tokens, max(least(n, 512))::bigint AS max_model_tokens, count(*) FILTER (n > 512) AS n_truncated
FROM per_doc GROUP BY lang""",
    "forbidden_phrases": f"""
SELECT doc_id, {sql_remove_phrases('text2')} AS abstract
FROM (SELECT doc_id,
             {_HEAD}[doc_id % {len(HEADINGS)} + 1]
             || replace(text, chr(10), chr(10) || {_HEAD}[(doc_id + 3) % {len(HEADINGS)} + 1]) AS text2
      FROM documents)""",
    "processed_text": f"SELECT doc_id, array_to_string({sql_topic_tokens('text')}, ' ') AS processed_text FROM documents",
    "dedupe_records": """
SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source,
       arg_min(n_chars, doc_id) AS n_chars, count(*) AS n_copies
FROM documents GROUP BY text""",
    "token_stats": f"""
SELECT lang, count(*) AS n_docs,
       round(avg(len({SQL_WORD_PIECES.format(x='text')})), 6) AS avg_tokens,
       CAST(max(len({SQL_WORD_PIECES.format(x='text')})) AS BIGINT) AS max_tokens,
       round(avg(least(len({SQL_WORD_PIECES.format(x='text')}), 512)), 6) AS avg_model_tokens,
       CAST(max(least(len({SQL_WORD_PIECES.format(x='text')}), 512)) AS BIGINT) AS max_model_tokens,
       CAST(sum(len({sql_topic_tokens('text')})) AS BIGINT) AS topic_tokens
FROM documents GROUP BY lang""",
    "doc_term_counts": f"WITH {DOC_TERMS} SELECT doc_id, term, n FROM doc_terms",
    "vocabulary": f"""WITH {DOC_TERMS}
SELECT term, count(*) AS doc_freq, CAST(sum(n) AS BIGINT) AS term_freq,
       row_number() OVER (ORDER BY term) - 1 AS term_index
FROM doc_terms GROUP BY term""",
    "top_terms_per_group": f"""WITH {DOC_TERMS},
counts AS (SELECT d.lang, t.term, CAST(sum(t.n) AS BIGINT) AS freq
           FROM doc_terms t JOIN documents d USING (doc_id) GROUP BY d.lang, t.term)
SELECT lang, term, freq, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, term) AS rank FROM counts)
WHERE rank <= 10""",
}

QUERIES = {
    "subword_stats": subword_stats_q,
    "forbidden_phrases": forbidden_phrases_q,
    "processed_text": processed_text_q,
    "dedupe_records": dedupe_records_q,
    "token_stats": token_stats_q,
    "doc_term_counts": doc_term_counts_q,
    "vocabulary": vocabulary_q,
    "top_terms_per_group": top_terms_per_group_q,
}

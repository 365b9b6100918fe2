"""Registered queries: term mentions, compound lookups, treemap, cache misses."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.operators.chem import cache_frame, cache_misses, lexicon_frame, mention_summary, mentions, treemap
from scriptorium.plans.sqltext import values_rows
from scriptorium.session import read_table, widen

# --- FIXED VALUES: stand-in lexicon (frequent n-grams of `documents`) ---------
LEXICON = [
    "thatin", "ononst", "inoran", "hehely", "orantion", "attion", "thanea", "eriner",
    "nicht", "retion", "anea eriner", "eriner thanea", "attion to", "anea eriner thanea",
]

# --- FIXED VALUES: stand-in compound cache (made-up info; some terms absent) --
CACHE = [
    ("thatin", "C8H10N4O2", "1,3,7-trimethylpurine-2,6-dione", "CHEBI:23638"),
    ("ononst", "C9H8O4", "2-acetyloxybenzoic acid", "CHEBI:23432"),
    ("inoran", "C8H9NO2", "N-(4-hydroxyphenyl)acetamide", "CHEBI:23431"),
    ("hehely", "C13H18O2", "2-[4-(2-methylpropyl)phenyl]propanoic acid", "CHEBI:23400"),
    ("orantion", "C6H12O6", "(3R,4S,5S,6R)-6-(hydroxymethyl)oxane-2,3,4,5-tetrol", None),
    ("attion", "H2O", "oxidane", "CHEBI:99999"),
    ("thanea", None, "thanea \"quoted\" name", None),
    ("anea eriner thanea", "C2H6O", "ethanol", "CHEBI:23400"),
    ("anea eriner", "CH4", "methane", None),
]


def _mentions(spark, sf_dir):
    docs = widen(read_table(spark, sf_dir, "documents"))
    return mentions(docs, "doc_id", "text", LEXICON)


def term_mentions_q(spark, sf_dir):
    return mention_summary(_mentions(spark, sf_dir), cache_frame(spark, CACHE), "doc_id")


def mention_treemap_q(spark, sf_dir):
    return treemap(term_mentions_q(spark, sf_dir))


def cache_misses_q(spark, sf_dir):
    return cache_misses(_mentions(spark, sf_dir), cache_frame(spark, CACHE))


def lexicon_table_mentions_q(spark, sf_dir):
    """J9 with the lexicon as a table: the words of all part names and of some phrases."""
    parts = read_table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    table = parts.unionByName(lexicon_frame(spark, LEXICON).select("term"))
    docs = widen(read_table(spark, sf_dir, "documents"))
    return mentions(docs, "doc_id", "text", table).groupBy("term").agg(F.count(F.lit(1)).alias("n_mentions"))


def _lex_rows():
    norm = sorted({" ".join(t.lower().split()) for t in LEXICON})
    return values_rows([(t, len(t.split(" "))) for t in norm])


def _mentions_sql(lex: str) -> str:
    return f"""toks AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t
  FROM documents),
lex(term, n_words) AS ({lex}),
grams AS (
  SELECT doc_id, pos, n AS n_words, array_to_string(t[pos:pos + n - 1], ' ') AS term
  FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS pos FROM toks) p,
       (SELECT unnest(range(1, 4)) AS n) k
  WHERE pos + n - 1 <= len(t)),
cands AS (SELECT g.doc_id, g.pos, g.n_words, g.term FROM grams g JOIN lex USING (term, n_words)),
firsts AS (
  SELECT * FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos, n_words DESC) AS prev_pos FROM cands)
  WHERE prev_pos IS NULL OR prev_pos <> pos),
succ AS (
  SELECT f.doc_id, f.pos, f.n_words, f.term, g.pos AS next_pos
  FROM firsts f ASOF LEFT JOIN firsts g ON f.doc_id = g.doc_id AND f.pos + f.n_words <= g.pos),
ment AS (
  SELECT * FROM succ WHERE (doc_id, pos) IN (SELECT (doc_id, min(pos)) FROM succ GROUP BY doc_id)
  UNION ALL
  SELECT s.* FROM ment m JOIN succ s ON s.doc_id = m.doc_id AND s.pos = m.next_pos),
cache(term, molecular_formula, iupac_name, chebi_class) AS (VALUES {values_rows(CACHE)}),
classes(cid, cname) AS (VALUES {values_rows(fv.CHEBI_CLASS_NAMES)})"""


_MENTIONS = _mentions_sql(f"VALUES {_lex_rows()}")
_TABLE_MENTIONS = _mentions_sql(f"""SELECT DISTINCT w, 1 FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> ''
  UNION SELECT * FROM (VALUES {_lex_rows()})""")

_SUMMARY = """summary AS (
  SELECT p.term AS "Term", 'Chemical' AS "Entity Type",
         coalesce(c.chebi_class, 'N/A') AS "ChEBI Class",
         coalesce(k.cname, 'Unknown Class') AS "ChEBI Class Name",
         CASE WHEN c.term IS NOT NULL AND (c.molecular_formula IS NOT NULL OR c.iupac_name IS NOT NULL
                                           OR c.chebi_class IS NOT NULL)
              THEN '{"molecular_formula": ' || to_json(coalesce(c.molecular_formula, 'N/A'))
                   || ', "iupac_name": ' || to_json(coalesce(c.iupac_name, 'N/A')) || '}'
              ELSE '{"molecular_formula": "N/A", "iupac_name": "N/A"}' END AS "PubChem Info",
         p.n AS "Frequency"
  FROM (SELECT term, count(*) AS n FROM ment GROUP BY term) p
  LEFT JOIN cache c USING (term)
  LEFT JOIN classes k ON k.cid = coalesce(c.chebi_class, 'N/A'))"""

ORACLE = {
    "term_mentions": f"""WITH RECURSIVE {_MENTIONS}, {_SUMMARY}
SELECT "Term", "Entity Type", "ChEBI Class", "ChEBI Class Name", min("PubChem Info") AS "PubChem Info",
       CAST(sum("Frequency") AS BIGINT) AS "Frequency"
FROM summary GROUP BY ALL ORDER BY 1, 2, 3, 4""",
    "mention_treemap": f"""WITH RECURSIVE {_MENTIONS}, {_SUMMARY}
SELECT "Term", "ChEBI Class Name", grouping_id("Term", "ChEBI Class Name") AS level,
       CAST(sum("Frequency") AS BIGINT) AS value,
       round(sum("Frequency" * "Frequency") / sum("Frequency"), 6) AS color
FROM summary GROUP BY ROLLUP ("Term", "ChEBI Class Name")""",
    "lexicon_table_mentions": f"""WITH RECURSIVE {_TABLE_MENTIONS}
SELECT term, count(*) AS n_mentions FROM ment GROUP BY term""",
    "cache_misses": f"""WITH RECURSIVE {_MENTIONS}
SELECT term, count(*) AS n_mentions FROM ment WHERE term NOT IN (SELECT term FROM cache) GROUP BY term""",
}

QUERIES = {
    "term_mentions": term_mentions_q,
    "mention_treemap": mention_treemap_q,
    "cache_misses": cache_misses_q,
    "lexicon_table_mentions": lexicon_table_mentions_q,
}

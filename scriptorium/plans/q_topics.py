"""Registered queries: topic models (rows-only checks where documents are updated until they
settle; SQL for a fit of fixed steps), and the tables made from a model's shares and words."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.dates import in_year_range, pub_year
from scriptorium.operators.topics import (fit_topics, labelled_topics, mean_shares, named_words, shares_by_period,
                                          topic_shares, topic_table, topics_by_period)
from scriptorium.plans.q_text import DOC_TERMS, documents
from scriptorium.plans.q_trends import FIXTURE_YEARS
from scriptorium.plans.standins import publication_dates
from scriptorium.session import read_table


def dated_documents(spark, sf_dir):
    """metadata stand-in: abstract = documents.text, date from orders by key."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    pubs = publication_dates(read_table(spark, sf_dir, "orders"))
    return (docs.join(pubs, docs.doc_id == pubs.ID)
            .select("doc_id", "text", pub_year(F.col("Publication_Date")).alias("year")))


def topic_frequencies_q(spark, sf_dir):
    lo, hi = FIXTURE_YEARS
    docs = dated_documents(spark, sf_dir).where(in_year_range(F.col("year"), lo, hi))
    return topic_table(fit_topics(docs, "doc_id", "text"))


def patent_titles(spark, sf_dir):
    """Title stand-in: every non-blank line of every document is one title
    record (id = "doc_id:line number"), so the whole text is used."""
    docs = read_table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "Title"))
    return (lines.where(F.trim(F.col("Title")) != F.lit(""))
            .select(F.concat_ws(":", "doc_id", "line_no").alias("title_id"), "Title"))


def patent_topic_frequencies_q(spark, sf_dir):
    return topic_table(fit_topics(patent_titles(spark, sf_dir), "title_id", "Title"))


def topics_by_period_q(spark, sf_dir):
    docs = dated_documents(spark, sf_dir).where(F.col("year").isNotNull())
    fit = fit_topics(docs, "doc_id", "text")
    return topics_by_period(fit, docs.select(F.col("doc_id").alias("id"), "year"), "year")


# --- a fit of fixed steps: M1, M2, M3 and A4 as SQL computes them too ---

STEPS, STEP_UPDATES = 2, 3   # passes, and updates of each document in a pass and for the shares


def topic_fit_steps_q(spark, sf_dir):
    """Mean share and expected words of each topic after two passes of three updates a document."""
    docs = read_table(spark, sf_dir, "documents")
    fit = fit_topics(docs, "doc_id", "text", max_iter=STEPS, doc_updates=STEP_UPDATES, doc_change=0.0)
    words = spark.createDataFrame([(j, t) for j, t in enumerate(fit.totals)], "topic int, words double")   # a row a topic
    return (mean_shares(topic_shares(fit)).join(words, "topic")
            .select("topic", F.round("Frequency", 6).alias("Frequency"), F.round("words", 3).alias("words")))


def _sql_digamma(x: str) -> str:
    """The same function by ten steps up."""
    y = f"({x} + 10)"
    return (f"(ln({y}) - 0.5::double / {y} - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6)"
            + "".join(f" - 1 / ({x} + {i})" for i in range(10)) + ")")


def _topic_fit_sql(k: int, passes: int, updates: int) -> str:
    """Batch variational Bayes with every update a table."""
    ctes = [f"""{DOC_TERMS}""",
            "nt AS MATERIALIZED (SELECT doc_id, term, n::double AS n FROM doc_terms)",
            f"topics AS (SELECT unnest(range({k})) AS k)",
            "sizes AS MATERIALIZED (SELECT d.doc_id, coalesce(sum(n), 0) AS size FROM documents d LEFT JOIN nt USING (doc_id) GROUP BY d.doc_id)",
            f"""lam0 AS MATERIALIZED (SELECT term, k, 0.5 + ('0x' || substr(md5('{fv.SEED}:' || k || ':' || term), 1, 8))::ubigint::double / 4294967296 AS l
                FROM (SELECT DISTINCT term FROM nt), topics)"""]

    def documents(name: str, lam: str) -> None:
        """Tables ``name``_g (document, topic, gamma) after all updates and ``name``_p (parts of each term)."""
        ctes.append(f"""{name}_b AS MATERIALIZED (SELECT term, k, exp({_sql_digamma('l')} - {_sql_digamma('total')}) AS b
            FROM (SELECT *, sum(l) OVER (PARTITION BY k) AS total FROM {lam}))""")
        ctes.append(f"{name}_g0 AS MATERIALIZED (SELECT doc_id, k, {1 / k}::double + size / {k} AS g FROM sizes, topics)")
        for u in range(updates + 1):
            ctes.append(f"""{name}_t{u} AS MATERIALIZED (SELECT doc_id, k, exp({_sql_digamma('g')} - {_sql_digamma('total')}) AS t
                FROM (SELECT *, sum(g) OVER (PARTITION BY doc_id) AS total FROM {name}_g{u}))""")
            ctes.append(f"""{name}_p{u} AS MATERIALIZED (SELECT doc_id, term, k, n * w / sum(w) OVER (PARTITION BY doc_id, term) AS p
                FROM (SELECT nt.doc_id, nt.term, t.k, n, t * b AS w FROM nt JOIN {name}_t{u} t USING (doc_id) JOIN {name}_b b ON b.term = nt.term AND b.k = t.k))""")
            if u < updates:
                ctes.append(f"""{name}_g{u + 1} AS MATERIALIZED (SELECT g.doc_id, g.k, {1 / k}::double + coalesce(sum(p), 0) AS g
                    FROM {name}_g0 g LEFT JOIN {name}_p{u} p ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY g.doc_id, g.k)""")

    for i in range(passes):
        documents(f"s{i}", f"lam{i}")
        ctes.append(f"lam{i + 1} AS MATERIALIZED (SELECT term, k, {1 / k}::double + sum(p) AS l FROM s{i}_p{updates} GROUP BY term, k)")
    documents("last", f"lam{passes}")
    return f"""WITH {', '.join(ctes)},
        freq AS (SELECT k, avg(g / total) AS f FROM (SELECT *, sum(g) OVER (PARTITION BY doc_id) AS total FROM last_g{updates}) GROUP BY k),
        words AS (SELECT k, sum(l) AS w FROM lam{passes} GROUP BY k)
        SELECT k::int AS topic, round(f, 6) AS "Frequency", round(w, 3) AS words FROM freq JOIN words USING (k)"""


# --- the tables around a fit (A4, W1, P15, M4, A17), on shares and weights that SQL can compute too ---

SHARE_TOPICS, SHARE_WORDS = 5, 10


def derived_shares(spark, sf_dir):
    """Shares of a few topics: the first values of each embedding, made positive and scaled to one."""
    emb = read_table(spark, sf_dir, "embeddings")
    raw = F.transform(F.slice("embedding", 1, SHARE_TOPICS), lambda x: F.abs(x.cast("double")) + 0.001)
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return (emb.select(F.col("vec_id").alias("id"), "label", raw.alias("raw")).withColumn("total", total)
            .select("id", "label", F.transform("raw", lambda x: x / F.col("total")).alias("shares")))


def derived_words(spark, sf_dir):
    """((topic, rank, idx), (idx, term)): part names as vocabulary, weighed by an arithmetic of the key."""
    part = read_table(spark, sf_dir, "part")
    topics = F.explode(F.sequence(F.lit(0), F.lit(SHARE_TOPICS - 1)))
    weight = F.pmod(F.col("idx") * (F.col("topic") * 104 + 7919), F.lit(10007))
    strongest = Window.partitionBy("topic").orderBy(F.desc("weight"), "idx")
    top = (part.select(F.col("p_partkey").alias("idx"), topics.alias("topic")).withColumn("weight", weight)
           .withColumn("rank", F.row_number().over(strongest) - 1).where(F.col("rank") < SHARE_WORDS))
    return top.select("topic", "rank", "idx"), part.select(F.col("p_partkey").alias("idx"), F.concat_ws(" ", "p_name", "p_partkey").alias("term"))


def topic_table_of_shares_q(spark, sf_dir):
    freq = mean_shares(derived_shares(spark, sf_dir))
    words = named_words(*derived_words(spark, sf_dir))
    return labelled_topics(freq, words).select("Topic", F.round("Frequency", 6).alias("Frequency"), "Top_Words")


def shares_by_period_q(spark, sf_dir):
    shares = derived_shares(spark, sf_dir)
    per = shares_by_period(shares.select("id", "shares"), shares.select("id", F.col("label").alias("period")), "period")
    return per.select("period", "Topic", F.round("Frequency", 6).alias("Frequency"), "n_docs")


_SHARES = f"""raw AS (
  SELECT vec_id, label, list_transform(embedding[1:{SHARE_TOPICS}], lambda x: abs(CAST(x AS DOUBLE)) + 0.001) AS r FROM embeddings),
shares AS (
  SELECT label, t AS topic, r[t + 1] / list_sum(r) AS share FROM raw, (SELECT unnest(range({SHARE_TOPICS})) AS t))"""

QUERIES = {
    "topic_frequencies": topic_frequencies_q,
    "patent_topic_frequencies": patent_topic_frequencies_q,
    "topics_by_period": topics_by_period_q,
    "topic_fit_steps": topic_fit_steps_q,
    "topic_table_of_shares": topic_table_of_shares_q,
    "shares_by_period": shares_by_period_q,
}
ORACLE = {
    "topic_fit_steps": _topic_fit_sql(fv.N_TOPICS, STEPS, STEP_UPDATES),
    "topic_table_of_shares": f"""WITH {_SHARES},
weights AS (
  SELECT t AS topic, p_partkey, p_name || ' ' || p_partkey AS term,
         row_number() OVER (PARTITION BY t ORDER BY (p_partkey * (t * 104 + 7919)) % 10007 DESC, p_partkey) AS n
  FROM part, (SELECT unnest(range({SHARE_TOPICS})) AS t)),
words AS (SELECT topic, string_agg(term, ', ' ORDER BY n DESC) AS w FROM weights WHERE n <= {SHARE_WORDS} GROUP BY topic),
freq AS (SELECT topic, round(avg(share), 6) AS f FROM shares GROUP BY topic)
SELECT 'Topic ' || (topic + 1) AS "Topic", f AS "Frequency", w AS "Top_Words" FROM freq JOIN words USING (topic)""",
    "shares_by_period": f"""WITH {_SHARES}
SELECT label AS period, 'Topic ' || (topic + 1) AS "Topic", round(avg(share), 6) AS "Frequency", count(*) AS n_docs
FROM shares GROUP BY label, topic""",
}

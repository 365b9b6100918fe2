"""Registered queries: the default record embedder and token statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators.embed import DEFAULT_DIM, embed
from scriptorium.session import read_table, widen


def hash_embedding_q(spark, sf_dir):
    docs = widen(read_table(spark, sf_dir, "documents"))
    out = embed(docs, "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"),
                      F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


_D = DEFAULT_DIM


def sql_hash_embedding(rel: str, id_col: str, text_col: str, out_id: str) -> str:
    """The default embedder in DuckDB SQL over relation ``rel`` (CTE part
    ``emb_*`` plus the final SELECT)."""
    return f"""emb_toks AS (
  SELECT {id_col} AS eid,
         list_filter(string_split_regex(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t
  FROM {rel}),
emb_feats AS (
  SELECT eid, list_transform(t, lambda x: {{'b': CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % {_D},
                                           's': CASE WHEN CAST(('0x' || substr(md5(x), 9, 1)) AS BIGINT) < 8
                                                     THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END}}) AS f
  FROM emb_toks),
emb_vecs AS (
  SELECT eid, list_transform(range({_D}), lambda d: list_sum(list_transform(f, lambda x: CASE WHEN x.b = d THEN x.s ELSE 0.0::DOUBLE END))) AS v
  FROM emb_feats)
SELECT eid AS {out_id},
       list_transform(v, lambda x: round(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-300), 6) + 0.0)
       AS embedding
FROM emb_vecs"""


def block_embedding_q(spark, sf_dir):
    """Q-B2: the reference embeds the whole text block of a record (id,
    title, authors, abstract, journal, date), not only the abstract."""
    from scriptorium.plans.q_citations import _parsed
    from scriptorium.sources.citations import records, render_block
    blocks = render_block(records(_parsed(spark, sf_dir)))
    out = embed(blocks, "pmid", "block")
    return out.select(F.col("id").alias("pmid"),
                      F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def _block_oracle() -> str:
    from scriptorium.plans.q_citations import _BLOCK_SQL, _EXPECTED
    return (f"WITH {_EXPECTED},\nblocks AS (SELECT pmid, {_BLOCK_SQL} AS block FROM expected),\n"
            + sql_hash_embedding("blocks", "pmid", "block", "pmid"))


ORACLE = {
    "hash_embedding": "WITH " + sql_hash_embedding("documents", "doc_id", "text", "doc_id"),
    "block_embedding": _block_oracle(),
}

QUERIES = {"hash_embedding": hash_embedding_q, "block_embedding": block_embedding_q}

"""Corpus operators on tokenized text."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.text import topic_tokens, vectorizer_terms, word_pieces
from scriptorium.operators.indexing import consecutive_index


def dedupe_exact(df: DataFrame, text_col: str, id_col: str, keep_cols: list[str] | None = None) -> DataFrame:
    """U4: one row per distinct text, the one with the lowest id, with the
    number of copies.

    Texts are grouped by their SHA-256 digest: the aggregation is a hash
    aggregate on a 64-character key with a long minimum, partial on the map
    side, so neither the texts nor the copies of a hot text are shuffled.
    The kept rows' other columns are joined back by id (narrow columns only).
    """
    keep_cols = list(keep_cols or [])
    # a null text is a copy of nothing: its key is the row's own id
    key = F.coalesce(F.sha2(F.col(text_col), 256), F.concat(F.lit("id "), F.col(id_col).cast("string")))
    rows = df.select(F.col(id_col), key.alias("_h"))
    if dict(df.dtypes)[id_col] == "string":
        # "9" is lower than "10"; ids that are no numbers come last, by their text
        number = F.expr(f"try_cast(`{id_col}` AS DECIMAL(38, 0))")
        least = F.min(F.struct(number.isNull(), number, F.col(id_col).alias("id")))["id"]
    else:
        least = F.min(id_col)
    firsts = rows.groupBy("_h").agg(least.alias(id_col), F.count(F.lit(1)).alias("n_copies"))
    return firsts.join(df.select(id_col, *keep_cols), id_col).select(id_col, *keep_cols, "n_copies")


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, n) for vectorizer terms of each document."""
    terms = vectorizer_terms(topic_tokens(F.col(text_col)))
    return (df.select(id_col, F.explode(terms).alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n")))


def vocabulary(doc_terms: DataFrame, id_col: str) -> DataFrame:
    """Alphabetical vocabulary with index, document and total frequency."""
    agg = doc_terms.groupBy("term").agg(F.count(F.col(id_col)).alias("doc_freq"),
                                        F.sum("n").alias("term_freq"))
    return consecutive_index(agg, ["term"], out="term_index")


def group_term_counts(df: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """(group, term, n): term frequencies per group, aggregated map-side."""
    terms = vectorizer_terms(topic_tokens(F.col(text_col)))
    return (df.select(group_col, F.explode(terms).alias("term"))
            .groupBy(group_col, "term").agg(F.count(F.lit(1)).alias("n")))


def top_terms(term_counts_by_group: DataFrame, group_col: str, k: int) -> DataFrame:
    """W1 form: the k most frequent terms per group, ties by term.

    The window runs over already-aggregated (group, term) counts, whose size
    is bounded by the vocabulary per group, not by the corpus.
    """
    counts = term_counts_by_group.groupBy(group_col, "term").agg(F.sum("n").alias("freq"))
    w = Window.partitionBy(group_col).orderBy(F.desc("freq"), "term")
    return (counts.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= k))


def token_stats(df: DataFrame, text_col: str, by: list[str], max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """A5: average and maximum token counts of whole texts (true counts, not
    padded), the same capped at the model limit ``max_tokens`` (what a
    512-token model sees), and the number of topic-model tokens."""
    n = F.size(word_pieces(F.col(text_col)))
    capped = F.least(n, F.lit(max_tokens))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"),
                               F.round(F.avg(n), 6).alias("avg_tokens"),
                               F.max(n).cast("bigint").alias("max_tokens"),
                               F.round(F.avg(capped), 6).alias("avg_model_tokens"),
                               F.max(capped).cast("bigint").alias("max_model_tokens"),
                               F.sum(F.size(topic_tokens(F.col(text_col)))).cast("bigint").alias("topic_tokens"))


# --- subword tokens (P19, A5) -----------------------------------------------------

MAX_PIECES = 1_000_000   # of a vocabulary: it is sent to every worker
LONGEST_WORD = 100       # characters; a longer word is unknown
MARKS = 2                # tokens before and after a text
CONTINUES = "##"         # in front of a piece that does not begin a word


def piece_trie(pieces: Iterable[str]) -> tuple[dict, dict]:
    """Tries of the pieces that begin a word and of those that continue one; "" marks an end."""
    begin, inside = {}, {}
    for piece in pieces:
        node = inside if piece.startswith(CONTINUES) else begin
        for c in piece.removeprefix(CONTINUES):
            node = node.setdefault(c, {})
        node[""] = True
    return begin, inside


def word_pieces_count(word: str, begin: dict, inside: dict) -> int:
    """Pieces of a word, the longest that fits first; 1 (unknown) where none fits."""
    if len(word) > LONGEST_WORD:
        return 1
    at, n, trie = 0, 0, begin
    while at < len(word):
        node, end = trie, at
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                end = i + 1
        if end == at:
            return 1
        at, n, trie = end, n + 1, inside
    return n


def subword_count(text: Column, vocabulary: DataFrame) -> Column:
    """Tokens of a whole text as a model with this vocabulary (column ``piece``) counts them.

    Letters and digits that stand together are a word, cut into pieces; every other
    character but white space is a token, and ``MARKS`` are added.  A worker cuts
    each different word of a batch once.  Null and empty texts have the marks only.
    """
    n = vocabulary.count()
    if n > MAX_PIECES:
        raise ValueError(f"a vocabulary of {n} pieces is more than {MAX_PIECES}")
    shared = vocabulary.sparkSession.sparkContext.broadcast([r[0] for r in vocabulary.select("piece").collect() if r[0]])
    tries: list = []

    @F.arrow_udf("int")
    def counts(words: pa.Array) -> pa.Array:
        if not tries:
            tries.append(piece_trie(shared.value))
        flat = words.flatten().dictionary_encode()
        each = np.array([word_pieces_count(w, *tries[0]) for w in flat.dictionary.to_pylist()] or [0])
        per_word = each[flat.indices.to_numpy(zero_copy_only=False)]
        sums = np.concatenate([[0], np.cumsum(per_word)])
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        return pa.array(np.diff(sums[ends]).astype(np.int32), pa.int32())

    whole = F.coalesce(text, F.lit(""))
    others = F.length(F.regexp_replace(whole, r"[\p{L}\p{N} \t\n\r]", ""))
    return counts(word_pieces(whole)) + others + MARKS


def subword_stats(df: DataFrame, text_col: str, by: list[str], vocabulary: DataFrame, max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """A5 on subword tokens: average and maximum of whole texts and of what the
    model sees, and how many texts it sees cut."""
    n = df.select(*by, subword_count(F.col(text_col), vocabulary).alias("n"))
    seen = F.least("n", F.lit(max_tokens))
    return n.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n"), 6).alias("avg_tokens"), F.max("n").cast("bigint").alias("max_tokens"),
                              F.round(F.avg(seen), 6).alias("avg_model_tokens"), F.max(seen).cast("bigint").alias("max_model_tokens"),
                              F.count_if(F.col("n") > max_tokens).alias("n_truncated"))

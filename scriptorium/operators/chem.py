"""Dictionary term mentions and compound lookups.

The reference runs a per-row chemical NER model and a remote lookup with a
local cache.  Here a term lexicon plays the NER part: each document's word
pieces are expanded to 1..N-grams and joined to the lexicon.  A lexicon given as
a list is a literal: only grams that *start with one of its first words* leave the
row, and it is broadcast.  One given as a table, of any size, takes part in an
ordinary join: a Bloom filter of the terms' first words picks the positions at
which grams are made, and one of the terms drops nearly all grams that are none
(:func:`table_grams`, :func:`possible_terms`).  Overlapping candidates are resolved per document:
the longest term at a start position wins, and a candidate that starts
inside a kept one is dropped; what was dropped itself drops nothing.  Lookups run after the mentions are
aggregated per term, so the dimension join sees one row per distinct term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.text import word_pieces
from scriptorium.session import materialize
from scriptorium.sources.tables import CACHE_SCHEMA

def lexicon_frame(spark: SparkSession, terms: Sequence[str]) -> DataFrame:
    rows = sorted({" ".join(t.lower().split()) for t in terms})
    return spark.createDataFrame([(t, len(t.split(" "))) for t in rows], "term string, n_words int")


def lexicon_table(terms: DataFrame) -> DataFrame:
    """(term, n_words) of a table with a ``term`` column, as :func:`lexicon_frame`; nulls and blanks are no terms."""
    words = F.filter(F.split(F.lower("term"), r"\s+"), lambda w: w != F.lit(""))
    return (terms.select(words.alias("_w")).where(F.size("_w") > 0)
            .select(F.array_join("_w", " ").alias("term"), F.size("_w").alias("n_words")).distinct())


#: Bits of the filter for each term, hashes of a term, most bytes of a filter that is broadcast.
FILTER_BITS, FILTER_HASHES, MAX_FILTER_BYTES = 16, 3, 64 << 20
_PAGE = 32768   # bits of one bitmap row


def _filter_bits(n_terms: int) -> int:
    return _PAGE * max(1, -(-n_terms * FILTER_BITS // _PAGE))


def term_filter(lexicon: DataFrame, n_terms: int) -> DataFrame:
    """A Bloom filter as bitmap rows: (page, bits), together ``FILTER_BITS`` bits a term."""
    places = F.array(*[F.pmod(F.xxhash64("term", F.lit(j)), F.lit(_filter_bits(n_terms))) for j in range(FILTER_HASHES)])
    return (lexicon.select(F.explode(places).alias("_p"))
            .groupBy(F.floor(F.col("_p") / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("_p") % _PAGE).alias("bits")))


def possible_terms(grams: DataFrame, lexicon: DataFrame, n_terms: int) -> DataFrame:
    """``grams`` without those that are surely no term of the lexicon, before any of them moves.

    Every hash asks one page of the broadcast filter for its bit.  About
    (1 - exp(-3/16))^3 = 0.5 % of the grams that are no terms stay.  A lexicon whose filter
    is larger than ``MAX_FILTER_BYTES`` (32 million terms) goes without: then all grams meet the join.
    """
    if _filter_bits(n_terms) // 8 > MAX_FILTER_BYTES:
        return grams
    pages = materialize(term_filter(lexicon, n_terms))
    for j in range(FILTER_HASHES):
        place = F.pmod(F.xxhash64("term", F.lit(j)), F.lit(_filter_bits(n_terms)))
        own = pages.select(F.col("page").alias("_page"), F.col("bits").alias("_bits"))
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (place % _PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        met = grams.join(F.broadcast(own), F.floor(place / _PAGE) == F.col("_page"))
        grams = met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(grams.columns)
    return grams


def table_grams(toks: DataFrame, id_col: str, lexicon: DataFrame, n_terms: int, max_n: int) -> DataFrame:
    """Grams (id, pos, n_words, term) of (id, _toks) that may be terms of a lexicon table.

    Words are asked first: where no term begins with the word, no gram is made.
    """
    firsts = materialize(lexicon.select(F.substring_index("term", " ", 1).alias("term")).distinct())
    words = toks.select(F.col(id_col), "_toks", F.posexplode("_toks").alias("pos", "term")).withColumn("pos", F.col("pos") + 1)
    starts = possible_terms(words, firsts, firsts.count())
    ns = F.sequence(F.lit(1), F.least(F.lit(max_n), F.size("_toks") - F.col("pos") + 1))
    sized = starts.select(F.col(id_col), "_toks", "pos", F.explode(ns).alias("n_words"))
    grams = sized.select(F.col(id_col), "pos", "n_words", F.array_join(F.slice("_toks", F.col("pos"), F.col("n_words")), " ").alias("term"))
    return possible_terms(grams, lexicon, n_terms)


def candidate_mentions(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str] | DataFrame) -> DataFrame:
    """All lexicon hits: (id, pos, n_words, term), pos 1-based."""
    # tokens become a column first: an expression referenced inside a lambda
    # would be re-evaluated for every array element
    toks = F.col("_toks")
    pieces = docs.select(F.col(id_col), word_pieces(F.col(text_col)).alias("_toks")).where(F.size(toks) > 0)
    if isinstance(terms, DataFrame):
        lexicon = materialize(lexicon_table(terms))
        n_terms, max_n = lexicon.agg(F.count(F.lit(1)), F.max("n_words")).first()
        return table_grams(pieces, id_col, lexicon, n_terms, max_n or 1).join(lexicon, ["term", "n_words"])
    norm = sorted({" ".join(t.lower().split()) for t in terms})
    max_n = max(len(t.split(" ")) for t in norm)
    first_words = sorted({t.split(" ")[0] for t in norm})
    # a literal in the caller's code: broadcasting it is safe
    lexicon = F.broadcast(lexicon_frame(docs.sparkSession, norm))

    def grams_at(i: Column) -> Column:
        ns = F.sequence(F.lit(1), F.least(F.lit(max_n), F.size(toks) - i + 1))
        return F.transform(ns, lambda n: F.struct(i.alias("pos"), n.alias("n_words"),
                                                  F.array_join(F.slice(toks, i, n), " ").alias("term")))

    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))), lambda i: F.get(toks, i - 1).isin(*first_words))
    grams = F.flatten(F.transform(starts, grams_at))
    return pieces.select(F.col(id_col), F.inline(grams)).join(lexicon, ["term", "n_words"])


def resolve_overlaps(cands: DataFrame, id_col: str) -> DataFrame:
    """Longest term per start; then from left to right, a candidate stays if it
    starts behind the last one that stayed.

    Candidates fall into runs, in which each starts inside an earlier one; a
    run is decided by itself, in one fold over its candidates.  The windows and
    the grouping share the document partitioning (one shuffle)."""
    by_start = Window.partitionBy(id_col).orderBy("pos", F.desc("n_words"))
    first = cands.withColumn("_prev_pos", F.lag("pos").over(by_start))
    first = first.where(F.col("_prev_pos").isNull() | (F.col("_prev_pos") != F.col("pos")))
    by_pos = Window.partitionBy(id_col).orderBy("pos")
    reach = F.max(F.col("pos") + F.col("n_words") - 1).over(by_pos.rowsBetween(Window.unboundedPreceding, -1))
    runs = first.withColumn("_opens", F.when(reach >= F.col("pos"), 0).otherwise(1)).withColumn(
        "_run", F.sum("_opens").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    hits = runs.groupBy(id_col, "_run").agg(F.array_sort(F.collect_list(F.struct("pos", "n_words", "term"))).alias("_hits"))
    kind = dict(hits.dtypes)["_hits"]

    def step(kept: Column, hit: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        inside = F.coalesce(last["pos"] + last["n_words"] > hit["pos"], F.lit(False))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(hit)))

    return hits.select(id_col, F.inline(F.aggregate("_hits", F.array().cast(kind), step)))


def mentions(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str] | DataFrame) -> DataFrame:
    """One row per mention (id, pos, n_words, term)."""
    return resolve_overlaps(candidate_mentions(docs, id_col, text_col, terms), id_col)


def json_string(col: Column) -> Column:
    """A JSON string literal for ``col`` (quotes and escapes included)."""
    return F.regexp_extract(F.to_json(F.array(col)), r"^\[(.*)\]$", 1)


def info_json(formula: Column, iupac: Column) -> Column:
    """``{"molecular_formula": ..., "iupac_name": ...}`` with the
    separators of the reference's serializer (``, `` and ``: ``)."""
    return F.concat(F.lit('{"molecular_formula": '), json_string(formula),
                    F.lit(', "iupac_name": '), json_string(iupac), F.lit("}"))


def class_name(class_id: Column, classes: Sequence[tuple[str, str]] = fv.CHEBI_CLASS_NAMES) -> Column:
    """Class id → name; unknown id → ``Unknown Class``."""
    m = F.create_map(*[x for k, v in classes for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, class_id), F.lit(fv.UNKNOWN_CLASS))


def cache_frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), CACHE_SCHEMA)


#: Most rows of a per-term table that are broadcast.
SMALL = 100_000


def term_counts(ment: DataFrame, out: str) -> tuple[DataFrame, bool]:
    """Mentions per term, written once (the texts are not read again), and
    whether the table is small enough to be broadcast."""
    per_term = materialize(ment.groupBy("term").agg(F.count(F.lit(1)).alias(out)))
    return per_term, per_term.count() <= SMALL


def cache_hits(per_term: DataFrame, cache: DataFrame, small: bool) -> DataFrame:
    """Cache rows for the mentioned terms.  Where ``per_term`` is small it is
    broadcast, and the cache, however large, is only streamed past it once;
    the hits are written once because two branches read them."""
    terms = per_term.select("term")
    return materialize(cache.join(F.broadcast(terms) if small else terms, "term"))


def lookup(per_term: DataFrame, cache: DataFrame, small: bool) -> DataFrame:
    """J4 as a left outer join of ``per_term`` with the cache, built from an
    inner join (hits) plus the terms without a hit; a plain outer join could
    not broadcast the preserved small side."""
    hits = cache_hits(per_term, cache, small)
    found = per_term.join(hits, "term")
    missing = (per_term.join(hits.select("term"), "term", "left_anti")
               .select(*per_term.columns, *[F.lit(None).cast(f.dataType).alias(f.name)
                                            for f in cache.schema.fields if f.name != "term"]))
    return found.unionByName(missing)


def mention_summary(ment: DataFrame, cache: DataFrame, id_col: str) -> DataFrame:
    """A2 (after J4, J5): ``Term, Entity Type, ChEBI Class, ChEBI Class Name,
    PubChem Info, Frequency``; one row per distinct term.

    Mentions are counted per term first (map-side partial aggregation), so
    the lookup join and everything after it is bounded by the number of
    distinct terms.
    """
    per_term, small = term_counts(ment, "Frequency")
    joined = lookup(per_term, cache, small)
    hit = F.col("molecular_formula").isNotNull() | F.col("iupac_name").isNotNull() | \
        F.col("chebi_class").isNotNull()
    na = F.lit(fv.NOT_AVAILABLE)
    info = F.when(hit, info_json(F.coalesce("molecular_formula", na), F.coalesce("iupac_name", na))) \
        .otherwise(info_json(na, na))
    cls = F.coalesce(F.col("chebi_class"), na)
    rows = joined.select(F.col("term").alias("Term"), F.lit(fv.ENTITY_TYPE).alias("Entity Type"),
                         cls.alias("ChEBI Class"), class_name(cls).alias("ChEBI Class Name"),
                         info.alias("PubChem Info"), "Frequency")
    keys = ["Term", "Entity Type", "ChEBI Class", "ChEBI Class Name"]
    return (rows.groupBy(*keys)
            .agg(F.min("PubChem Info").alias("PubChem Info"), F.sum("Frequency").alias("Frequency"))
            .orderBy(*keys))


def treemap(summary: DataFrame) -> DataFrame:
    """A3: Term → class hierarchy; value = sum, colour = frequency-weighted
    mean of the children's frequency."""
    f = F.col("Frequency")
    g = summary.rollup("Term", "ChEBI Class Name").agg(
        F.sum(f).alias("value"),
        (F.sum(f * f) / F.sum(f)).alias("color"),
        F.grouping_id().alias("level"))
    return g.select("Term", "ChEBI Class Name", "level", "value", F.round("color", 6).alias("color"))


def cache_misses(ment: DataFrame, cache: DataFrame) -> DataFrame:
    """K6: distinct mention terms the cache cannot answer (to be looked up)."""
    per_term, small = term_counts(ment, "n_mentions")
    return per_term.join(cache_hits(per_term, cache, small).select("term"), "term", "left_anti")

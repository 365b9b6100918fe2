"""Citation XML → records (S1, P1–P6, F7, F8, K7) and the text-block format
(K1, S4).

Parsing is one ``from_xml`` per record, run where the record lives:

1. files are split on the closing ``</PubmedArticle>`` tag with
   ``spark.read.text(lineSep=...)`` (a record never spans two rows, files
   split across tasks like any text input);
2. inline markup (``<i>``, ``<sub>``, ...) is removed from the *raw* string,
   so the parsed value is the text of all descendants;
3. ``from_xml`` in PERMISSIVE mode parses against an explicit schema; a
   malformed record yields nulls plus its raw text in ``_corrupt`` and does
   not disturb its neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.text import clean_text, remove_forbidden_phrases, strip_inline_tags, ustrip

RECORD_TAG = "PubmedArticle"
CORRUPT = "_corrupt"

CITATION_SCHEMA = (
    "MedlineCitation struct<"
    "PMID: string, "
    "Article: struct<"
    "ArticleTitle: string, "
    "AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>, "
    "Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>, "
    "Abstract: struct<AbstractText: array<string>>>>, "
    f"{CORRUPT} string"
)

RECORD_COLUMNS = ["pmid", "title", "authors", "abstract", "journal", "pub_date"]


def read_raw_records(spark: SparkSession, path: str) -> DataFrame:
    """S1 step 1: one row per ``<PubmedArticle>`` element of the files at
    ``path`` (``raw`` column), and what the files hold beside records."""
    end = f"</{RECORD_TAG}>"
    lines = spark.read.text(path, lineSep=end)
    return raw_records_from_chunks(lines, "value")


def raw_records_from_chunks(df: DataFrame, col: str) -> DataFrame:
    """Records of chunks that were cut at the closing tag.

    A chunk is parted at every opening tag: its last part gets the closing tag
    back; a part before it is a truncated record, and text that is neither a
    record nor the file's wrapper is a rejected payload.  Both are kept as they
    are: they do not parse, so they end in :func:`quarantine` (K7, F8).
    """
    end = f"</{RECORD_TAG}>"
    parts = F.split(F.col(col), r"(?=<" + RECORD_TAG + r"[\s>])")
    part = df.select(F.posexplode(parts).alias("_at", "_part"), F.size(parts).alias("_n"))
    is_record = F.col("_part").rlike(r"^<" + RECORD_TAG + r"[\s>]")
    wrapper = r"(?s)<\?xml.*?\?>|<!DOCTYPE[^>]*>|</?" + RECORD_TAG + r"Set(?:\s[^>]*)?/?>|\uFEFF"
    is_payload = F.trim(F.regexp_replace(F.regexp_replace(F.col("_part"), wrapper, ""), r"\s+", "")) != F.lit("")
    return (part.where(is_record | is_payload)
            .select(F.when(is_record & (F.col("_at") == F.col("_n") - 1), F.concat("_part", F.lit(end)))
                    .otherwise(F.col("_part")).alias("raw")))


def parse_raw(df: DataFrame, raw_col: str = "raw", compat: bool = False) -> DataFrame:
    """S1 steps 2–3: add ``parsed`` (struct) and ``leading_text`` flags.

    The struct comes out of a generator over one element, which the optimizer
    does not copy into the filters and projections above: one parse a record.
    """
    raw = F.col(raw_col)
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    out = df.select("*", F.explode(F.array(F.from_xml(strip_inline_tags(raw), CITATION_SCHEMA, opts))).alias("parsed"))
    if compat:
        # reference quirk: a section whose text starts with a child element is
        # skipped; remember, per section, whether it starts with text
        starts = F.regexp_extract_all(raw, F.lit(r"<AbstractText(?:\s[^>]*)?>(<?)"), F.lit(1))
        out = out.withColumn("_leading_text", F.transform(starts, lambda s: s == F.lit("")))
    return out


def _author(a: Column, compat: bool) -> Column:
    both = a["LastName"].isNotNull() & a["ForeName"].isNotNull()
    name = F.concat(clean_text(a["LastName"]), F.lit(", "), clean_text(a["ForeName"]))
    if compat:
        # reference quirk: the test on the elements is false for leaf elements
        return F.lit(fv.NO_NAME)
    return F.when(both, name).otherwise(F.lit(fv.NO_NAME))


def records(parsed: DataFrame, phrases: Sequence[str] = fv.FORBIDDEN_PHRASES, compat: bool = False) -> DataFrame:
    """The six export fields with the reference's sentinels.
    Corrupt records are left out (see :func:`quarantine`)."""
    m = F.col("parsed.MedlineCitation")
    art = m["Article"]
    authors = art["AuthorList"]["Author"]
    sections = art["Abstract"]["AbstractText"]
    if compat:
        kept = F.transform(F.filter(F.arrays_zip(sections.alias("s"), F.col("_leading_text").alias("t")),
                                    lambda z: z["t"] & z["s"].isNotNull() & (z["s"] != F.lit(""))),
                           lambda z: z["s"])
    else:
        kept = F.filter(sections, lambda s: s.isNotNull() & (ustrip(s) != F.lit("")))
    joined = ustrip(F.array_join(F.transform(kept, ustrip), " "))
    abstract = F.when(sections.isNull() | (F.size(sections) == 0), F.lit(fv.NO_ABSTRACT)) \
        .otherwise(remove_forbidden_phrases(joined, phrases))
    author_str = F.when(authors.isNull() | (F.size(authors) == 0), F.lit(fv.NO_AUTHORS)) \
        .otherwise(F.array_join(F.transform(authors, lambda a: _author(a, compat)), "; "))
    journal = art["Journal"]["Title"]
    year = art["Journal"]["JournalIssue"]["PubDate"]["Year"]
    return (parsed.where(m.isNotNull())
            .select(F.coalesce(m["PMID"], F.lit(fv.UNKNOWN_PMID)).alias("pmid"),
                    F.coalesce(ustrip(art["ArticleTitle"]), F.lit(fv.NO_TITLE)).alias("title"),
                    author_str.alias("authors"),
                    abstract.alias("abstract"),
                    F.when(journal.isNull(), F.lit(fv.NO_JOURNAL)).otherwise(clean_text(journal)).alias("journal"),
                    F.when(year.isNull(), F.lit(fv.NO_DATE)).otherwise(clean_text(year)).alias("pub_date")))


def quarantine(parsed: DataFrame) -> DataFrame:
    """K7: records the parser rejected, kept as data."""
    text = F.col(f"parsed.{CORRUPT}")
    if "raw" in parsed.columns:
        # well-formed but no citation: the parser has nothing to complain about
        text = F.coalesce(text, F.col("raw"))
    return parsed.where(F.col("parsed.MedlineCitation").isNull()).select(text.alias("raw"), F.length(text).alias("raw_chars"))


def read_citations(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """S1 end to end: files → records."""
    return records(parse_raw(read_raw_records(spark, path), compat=compat), compat=compat)


# --- text blocks (K1, S4) ------------------------------------------------------

def render_block(df: DataFrame) -> DataFrame:
    """K1: ``Abstract #id`` and five labelled lines; the writer's line
    separator adds the blank line between blocks."""
    block = F.format_string("Abstract #%s\nTitle: %s\nAuthors: %s\nAbstract: %s\nJournal: %s\nPublication Date: %s\n",
                            *[F.col(c) for c in RECORD_COLUMNS])
    return df.select("pmid", block.alias("block"))


def write_blocks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    render_block(df).select("block").write.mode(mode).text(path)


def read_blocks(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Split files into ``Abstract #`` records and extract the fields.

    The split is on ``\\nAbstract #`` (abstracts may hold blank lines), and the
    first record of a file is kept.  ``compat=True`` reproduces Q-B1: the
    reference drops the first piece of every file, so it loses the first
    record unless the file starts with a newline.
    """
    raw = spark.read.text(path, lineSep="\nAbstract #").where(F.trim(F.col("value")) != F.lit(""))
    if compat:
        # the first piece of a file is the only one still carrying the prefix
        raw = raw.where(~F.col("value").startswith("Abstract #"))
    text = F.when(F.col("value").startswith("Abstract #"), F.col("value")) \
        .otherwise(F.concat(F.lit("Abstract #"), F.col("value")))
    return block_fields(raw.select(text.alias("block")))


#: Labels of a block's fields, each at the start of a line.
BLOCK_LABELS = ["\nTitle: ", "\nAuthors: ", "\nAbstract: ", "\nJournal: ", "\nPublication Date: "]


def block_fields(blocks: DataFrame) -> DataFrame:
    """``pmid, title, authors, abstract, journal, pub_date, block`` of text blocks.

    A field runs to the next label, over as many lines as it has; the abstract
    runs to the last "Journal:" label that a date follows, since it may quote
    one.  Each label is looked for once, from the left or from the right.  Where
    one is missing, every field is the rest of its label's line.
    """
    title, authors, abstract, journal, date = BLOCK_LABELS

    def after(name: str, label: str, start: Column) -> Column:
        """Place behind the next label, 0 without one."""
        at = F.call_function("locate", F.lit(label), F.col(name), start)
        return F.when(at > 0, at + len(label)).otherwise(0)

    def without(name: str, end: str, label: str) -> Column:
        """What stands before the label whose right side is ``end``, null without the label."""
        left = F.length(name) - F.length(end) - len(label)
        return F.when(left >= 0, F.substring(F.col(name), F.lit(1), left))

    steps = (blocks.withColumn("_rest", F.substring(F.col("block"), F.length(F.substring_index("block", "\n", 1)) + 1, F.length("block")))
             .withColumn("_authors", after("_rest", authors, F.lit(1)))
             .withColumn("_abstract", F.when(F.col("_authors") > 0, after("_rest", abstract, F.col("_authors"))).otherwise(0))
             .withColumn("_tail", F.substring(F.col("_rest"), F.col("_abstract"), F.length("_rest")))
             .withColumn("_end", F.substring_index("_tail", date, -1))
             .withColumn("_before", without("_tail", "_end", date))
             .withColumn("_last", F.substring_index("_before", journal, -1))
             .withColumn("_text", without("_before", "_last", journal))
             # a second date label behind the last journal belongs to the date
             .withColumn("_journal", F.substring_index("_last", date, 1)))
    whole = F.col("_rest").startswith(title) & (F.col("_abstract") > 0) & F.col("_text").isNotNull()
    between = lambda start, end: F.substring(F.col("_rest"), start, end - start)
    dated = F.substring(F.concat("_last", F.lit(date), "_end"), F.length("_journal") + len(date) + 1, F.length("_tail"))
    fields = {"title": between(F.lit(len(title) + 1), F.col("_authors") - len(authors)), "authors": between(F.col("_authors"), F.col("_abstract") - len(abstract)),
              "abstract": F.col("_text"), "journal": F.col("_journal"), "pub_date": F.rtrim(dated, F.lit("\n"))}
    line = lambda label: F.regexp_extract("block", r"(?m)^" + label.strip() + r" (.*)$", 1)
    return steps.select(F.regexp_extract("block", r"^Abstract #(.*)", 1).alias("pmid"),
                        *[F.when(whole, found).otherwise(line(label)).alias(name) for label, (name, found) in zip(BLOCK_LABELS, fields.items())], "block")


# --- id lists (S2, F4) and the missing-id report (J2) -----------------------------

def parse_id_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Strip each line, keep digit-only ones."""
    v = F.trim(F.col(col))
    return df.select(v.alias("pmid")).where(v.rlike(r"^[0-9]+$"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_id_lines(spark.read.text(path))


def write_id_list(ids: DataFrame, path: str, key: str = "pmid", mode: str = "overwrite") -> None:
    """K2: one id per line (e.g. the missing-id report)."""
    ids.select(F.col(key).cast("string")).write.mode(mode).text(path)


def missing_ids(requested: DataFrame, received: DataFrame, key: str = "pmid") -> DataFrame:
    """Requested ids with no record."""
    return requested.select(key).distinct().join(received.select(key), key, "left_anti")

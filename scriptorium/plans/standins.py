"""Stand-in inputs derived from the driver tables.

The reference reads citation files and a metadata CSV; the driver supplies
TPC-H-like tables instead.  Every stand-in here is a projection of a driver
table (so its size grows with the table), computed by Spark with built-in
expressions, and is mirrored literally by the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.rules import country_rules

# --- FIXED VALUES: affiliation templates picked by c_custkey % 20 -------------
# They reach every rule tier and every quirk of the country rules.
AFFILIATION_TEMPLATES = [
    "Dept of Chemistry, Rome, Italy",
    "Bucharest, Romania",
    "Lagos, Nigeria",
    "Mogadishu, Somalia",
    "Indiana University",
    "Boston, USA; Paris, France",
    "Cambridge, UK",
    "Duke Clinic",
    "Moscow, RU",
    "Belo Horizonte, BR",
    "Mayo Clinic",
    "Stanford University",
    "Dept of Biology, CA 94143",
    "Dept of Biology, NY.",
    "Dept of Biology, MA;",
    "Institute of Physics",
    "No Affiliation",
    "No Affiliation; No Affiliation",
    "No Affiliation;  No Affiliation",
    None,
]


def pick(templates: list, key: Column) -> Column:
    """templates[key % len] as a column (1-based element_at)."""
    n = len(templates)
    arr = F.array(*[F.lit(t).cast("string") for t in templates])
    return F.element_at(arr, (F.pmod(key, F.lit(n)) + 1).cast("int"))


def affiliations(customer: DataFrame) -> DataFrame:
    """metadata stand-in: ``ID, Affiliations, c_mktsegment`` from customer."""
    return customer.select(
        F.col("c_custkey").alias("ID"),
        pick(AFFILIATION_TEMPLATES, F.col("c_custkey")).alias("Affiliations"),
        "c_mktsegment",
    )


def rule_affiliations(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """``ID, Affiliations``: customer by customer a name with the next rule's pattern inside, every
    other one in capitals, every third one with the customer's nation behind it."""
    pattern = F.concat(F.lit("Unit "), F.col("c_name"), F.lit(" of "), pick([p for p, _ in country_rules()], F.col("c_custkey")), F.lit("-"))
    cased = F.when(F.col("c_custkey") % 2 == 0, F.upper(pattern)).otherwise(pattern)
    met = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.select(F.col("c_custkey").alias("ID"),
                      F.when(F.col("c_custkey") % 3 == 0, F.concat(cased, F.lit("; "), F.col("n_name"))).otherwise(cased).alias("Affiliations"))


# --- publication-date strings derived from orders ------------------------------
# o_orderkey % 8 picks the rendering; 4-6 are values no format accepts.
def publication_dates(orders: DataFrame) -> DataFrame:
    """metadata stand-in: ``ID, Publication_Date`` (strings) from orders."""
    d = F.col("o_orderdate")
    k = F.pmod(F.col("o_orderkey"), F.lit(8))
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(k == 1, F.date_format(d, "yyyy MMM"))
            .when(k == 2, F.date_format(d, "yyyy"))
            .when(k == 3, F.date_format(d, "MM/dd/yyyy"))
            .when(k == 4, F.lit("n.d."))
            .when(k == 5, F.lit(None).cast("string"))
            .when(k == 6, F.concat(F.date_format(d, "yyyy"), F.lit("-02-30")))
            .otherwise(F.date_format(d, "yyyy-MM-dd")))
    return orders.select(F.col("o_orderkey").alias("ID"), text.alias("Publication_Date"))


SQL_PUBLICATION_DATES = """pubs AS (
  SELECT o_orderkey AS ID,
         CASE o_orderkey % 8
           WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
           WHEN 1 THEN strftime(o_orderdate, '%Y %b')
           WHEN 2 THEN strftime(o_orderdate, '%Y')
           WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y')
           WHEN 4 THEN 'n.d.'
           WHEN 5 THEN NULL
           WHEN 6 THEN strftime(o_orderdate, '%Y') || '-02-30'
           ELSE strftime(o_orderdate, '%Y-%m-%d') END AS Publication_Date
  FROM orders)"""
SQL_YEAR = "year(try_strptime({x}, ['%Y-%m-%d', '%Y %b', '%m/%d/%Y', '%Y']))"


# --- citation XML built from documents ---------------------------------------
# --- FIXED VALUES: names, journals and section headings of the stand-in ------
SURNAMES = ["Smith", "O'Brien", "García", "Müller", "Rossi", "Nguyen", "Kowalski",
            "Dubois", "Tanaka", "D'Angelo", "Silva", "Ivanova", "Haddad"]
FORENAMES = ["Ana", "John", "Li", "Marie-Claire", "Ola", "Pedro", "Sofia", "Jean's",
             "Kenji", "Fatima", "Lars"]
JOURNALS = ['Journal of "Protein" Research', "Neuro'Science Letters", "Acta Biochimica",
            "Protein Science", "Cell Reports"]
SECTION_HEADINGS = ["BACKGROUND: ", "<strong>BACKGROUND</strong> ", "Results: ",
                    "[Image: see text] ", "• ", ""]
CORRUPT_EVERY = 50  # doc_id % 50 == 49 → record truncated


def _wrap_first_word(col: Column, tag: str) -> Column:
    return F.regexp_replace(col, r"^(\S+)", f"<{tag}>$1</{tag}>")


def citation_xml(documents: DataFrame) -> DataFrame:
    """One ``<PubmedArticle>`` string per document (``doc_id, raw``).

    Title = first line, sections = the other non-blank lines; doc_id
    arithmetic adds inline tags, section headings, authors (some without a
    fore name), journals with quotes, missing titles/years, and truncates
    every 50th record.
    """
    from scriptorium.functions.text import ustrip, xml_escape

    d = F.col("doc_id")
    lines = F.split(F.col("text"), "\n")
    title = ustrip(F.get(lines, 0))
    title_xml = F.when(title == F.lit(""), F.lit("")).otherwise(F.concat(
        F.lit("<ArticleTitle>"),
        F.when(F.pmod(d, F.lit(3)) == 0, _wrap_first_word(xml_escape(title), "i")).otherwise(xml_escape(title)),
        F.lit("</ArticleTitle>")))
    body = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), ustrip),
                    lambda s: s != F.lit(""))
    body = F.when(F.size(lines) > 1, body).otherwise(F.array().cast("array<string>"))
    heading = pick(SECTION_HEADINGS, d)
    labelled = F.transform(body, lambda s, i: F.when(i == 0, F.concat(heading, s)).otherwise(s))

    def section(s: Column) -> Column:
        esc = xml_escape(s)
        esc = F.when(F.pmod(d, F.lit(4)) == 1, _wrap_first_word(esc, "b")).otherwise(esc)
        return F.concat(F.lit('<AbstractText Label="S">'), esc, F.lit("</AbstractText>"))

    abstract_xml = F.when(F.size(labelled) == 0, F.lit("")).otherwise(
        F.concat(F.lit("<Abstract>"), F.array_join(F.transform(labelled, section), ""), F.lit("</Abstract>")))
    n_auth = F.pmod(d, F.lit(4))

    def author(j: Column) -> Column:
        last = F.element_at(F.array(*[F.lit(s) for s in SURNAMES]), (F.pmod(d + j, F.lit(len(SURNAMES))) + 1).cast("int"))
        fore = F.element_at(F.array(*[F.lit(s) for s in FORENAMES]),
                            (F.pmod(d * 3 + j, F.lit(len(FORENAMES))) + 1).cast("int"))
        fore_xml = F.when(F.pmod(d + j, F.lit(7)) == 0, F.lit("")).otherwise(
            F.concat(F.lit("<ForeName>"), xml_escape(fore), F.lit("</ForeName>")))
        return F.concat(F.lit('<Author ValidYN="Y"><LastName>'), xml_escape(last), F.lit("</LastName>"),
                        fore_xml, F.lit("</Author>"))

    authors_xml = F.when(n_auth == 0, F.lit("")).otherwise(F.concat(
        F.lit("<AuthorList>"),
        F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n_auth - 1), author), ""),
        F.lit("</AuthorList>")))
    year_xml = F.when(F.pmod(d, F.lit(11)) == 5, F.lit("")).otherwise(
        F.concat(F.lit("<Year>"), (F.lit(1990) + F.pmod(d, F.lit(36))).cast("string"), F.lit("</Year>")))
    journal_title = F.when(F.pmod(d, F.lit(10)) == 9, F.lit("")).otherwise(
        F.concat(F.lit("<Title>"), xml_escape(pick(JOURNALS, d)), F.lit("</Title>")))
    xml = F.concat(
        F.lit('<PubmedArticle><MedlineCitation Status="MEDLINE"><PMID Version="1">'), d.cast("string"),
        F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), year_xml,
        F.lit("</PubDate></JournalIssue>"), journal_title, F.lit("</Journal>"),
        title_xml, abstract_xml, authors_xml,
        F.lit("</Article></MedlineCitation></PubmedArticle>"))
    xml = F.when(F.pmod(d, F.lit(CORRUPT_EVERY)) == CORRUPT_EVERY - 1, F.substring(xml, 1, 120)).otherwise(xml)
    return documents.select("doc_id", xml.alias("raw"))


def requested_id_lines(documents: DataFrame) -> DataFrame:
    """pmids.txt stand-in: one line per document id, some padded with
    spaces, some malformed (``<id>a``), plus a header line per 100 ids."""
    d = F.col("doc_id")
    line = (F.when(F.pmod(d, F.lit(13)) == 0, F.concat(F.lit("  "), d.cast("string"), F.lit(" ")))
            .when(F.pmod(d, F.lit(17)) == 0, F.concat(d.cast("string"), F.lit("a")))
            .otherwise(d.cast("string")))
    header = documents.where(F.pmod(d, F.lit(100)) == 0).select(F.lit("PMID list").alias("value"))
    return documents.select(line.alias("value")).unionByName(header)

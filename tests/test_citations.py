"""Citation XML parsing, sentinels, quirk switches, text blocks, id lists."""

from pyspark.sql import functions as F

from scriptorium.sources.citations import (missing_ids, parse_id_lines, parse_raw, quarantine, read_blocks,
                                           read_citations, read_id_list, records, write_blocks, write_id_list)

GOOD = ('<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article>'
        '<Journal><JournalIssue><PubDate><Year> 2021 </Year></PubDate></JournalIssue>'
        "<Title>J. O'Neil \"Chem\"</Title></Journal>"
        "<ArticleTitle>  Tau &amp; <i>keratin</i> </ArticleTitle>"
        '<Abstract><AbstractText Label="B">BACKGROUND: p &lt; 0.05 for H<sub>2</sub>O</AbstractText>'
        "<AbstractText><b>Results</b> were clear.</AbstractText><AbstractText>  </AbstractText></Abstract>"
        "<AuthorList><Author><LastName>O'Brien</LastName><ForeName>Ann</ForeName></Author>"
        "<Author><LastName>Solo</LastName></Author></AuthorList>"
        "</Article></MedlineCitation></PubmedArticle>")
BARE = "<PubmedArticle><MedlineCitation><Article></Article></MedlineCitation></PubmedArticle>"
BROKEN = "<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>cut"


def parse(spark, raws, compat=False):
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    return parse_raw(df, compat=compat)


def test_good_record(spark):
    r = records(parse(spark, [GOOD])).first().asDict()
    assert r == {
        "pmid": "11",
        "title": "Tau & keratin",
        "authors": "OBrien, Ann; No Name",
        "abstract": "p < 0.05 for H2O Results were clear.",
        "journal": "J. ONeil Chem",
        "pub_date": "2021",
    }


def test_missing_fields(spark):
    r = records(parse(spark, [BARE])).first().asDict()
    assert r == {"pmid": "Unknown PMID", "title": "No Title", "authors": "No Authors",
                 "abstract": "No Abstract", "journal": "No Journal", "pub_date": "No Date"}


def test_corrupt_record_is_quarantined(spark):
    parsed = parse(spark, [GOOD, BROKEN])
    assert [r.pmid for r in records(parsed).collect()] == ["11"]
    bad = quarantine(parsed).collect()
    assert len(bad) == 1 and bad[0].raw.startswith("<PubmedArticle>")


def test_compat_quirks(spark):
    r = records(parse(spark, [GOOD], compat=True), compat=True).first()
    assert r.authors == "No Name; No Name"                    # Q-P1
    assert r.abstract == "p < 0.05 for H2O"                    # Q-P2: section starting with <b> skipped


def test_files_blocks_roundtrip(spark, tmp_path):
    src = tmp_path / "xml"
    src.mkdir()
    (src / "a.xml").write_text('<?xml version="1.0"?>\n<PubmedArticleSet>\n' + GOOD + "\n" + BROKEN[:30]
                               + "\n" + GOOD.replace(">11<", ">13<") + "\n</PubmedArticleSet>\n")
    recs = read_citations(spark, str(src))
    assert sorted(r.pmid for r in recs.collect()) == ["11", "13"]
    write_blocks(recs, str(tmp_path / "blocks"))
    back = read_blocks(spark, str(tmp_path / "blocks"))
    assert sorted(r.pmid for r in back.collect()) == ["11", "13"]
    row = back.where(F.col("pmid") == "11").first()
    assert row.title == "Tau & keratin" and row.pub_date == "2021"


def test_id_lines_and_missing(spark):
    lines = spark.createDataFrame([(" 101 ",), ("102a",), ("",), ("103",), ("header",)], "value string")
    ids = parse_id_lines(lines)
    assert sorted(r.pmid for r in ids.collect()) == ["101", "103"]
    got = spark.createDataFrame([("103",)], "pmid string")
    assert [r.pmid for r in missing_ids(ids, got).collect()] == ["101"]


def test_blocks_compat_drops_first_record(spark, tmp_path):
    block = "Abstract #{0}\nTitle: t{0}\nAuthors: a\nAbstract: x\n\ny\nJournal: j\nPublication Date: 2020\n"
    (tmp_path / "plain.txt").write_text(block.format(1) + "\n" + block.format(2) + "\n")
    (tmp_path / "lead.txt").write_text("\n" + block.format(3) + "\n" + block.format(4) + "\n")
    ids = sorted(r.pmid for r in read_blocks(spark, str(tmp_path)).collect())
    assert ids == ["1", "2", "3", "4"]
    ids = sorted(r.pmid for r in read_blocks(spark, str(tmp_path), compat=True).collect())
    assert ids == ["2", "3", "4"]          # Q-B1: only a leading newline saves the first record


def test_missing_id_file_round_trip(spark, tmp_path):
    ids = spark.createDataFrame([("7",), ("42",)], "pmid string")
    write_id_list(ids, str(tmp_path / "missing"))
    assert sorted(r.pmid for r in read_id_list(spark, str(tmp_path / "missing")).collect()) == ["42", "7"]


def test_quotes_kept_in_title_and_abstract_and_other_dates(spark):
    raw = ("<PubmedArticle><MedlineCitation><PMID>5</PMID><Article><Journal><JournalIssue><PubDate>"
           "<MedlineDate>2019 Winter</MedlineDate></PubDate></JournalIssue><Title>\"J\"</Title></Journal>"
           "<ArticleTitle>The \"quoted\" one's title</ArticleTitle>"
           "<Abstract><AbstractText>It's \"here\"</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>")
    r = records(parse(spark, [raw])).first()
    assert r.title == 'The "quoted" one\'s title' and r.abstract == 'It\'s "here"'   # Q-P3
    assert r.journal == "J" and r.pub_date == "No Date"                              # Q-P4

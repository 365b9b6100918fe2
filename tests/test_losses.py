"""No record, text or neighbour is lost on the awkward inputs."""

import os

import numpy as np
from pyspark.sql import functions as F

from scriptorium.functions.dates import pub_year
from scriptorium.functions.text import strip_inline_tags
from scriptorium.operators.embed import embed_increment, read_store
from scriptorium.operators.textops import dedupe_exact
from scriptorium.operators.vectors import knn
from scriptorium.plans.runs import unique_records
from scriptorium.sources import citations as C


def article(pmid, title="T", abstract="A text."):
    return (f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><Journal><ISSN>1</ISSN><JournalIssue><PubDate><Year>2020</Year><Month>Jan</Month></PubDate></JournalIssue>"
            f"<Title>J</Title></Journal><ArticleTitle>{title}</ArticleTitle><Abstract><AbstractText>{abstract}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>")


def test_truncated_and_foreign_records_reach_the_quarantine(spark, tmp_path):
    cut = article(12)[:60]
    text = '<?xml version="1.0"?>\n<PubmedArticleSet>' + article(11) + cut + article(13) + "\n<Error>no such id</Error>" + article(14) + "</PubmedArticleSet>\n"
    (tmp_path / "a.xml").write_text(text)
    (tmp_path / "b.xml").write_text(article(15) + article(16)[:80])
    (tmp_path / "c.xml").write_text("")
    raw = C.parse_raw(C.read_raw_records(spark, str(tmp_path / "*.xml")))
    assert sorted(r.pmid for r in C.records(raw).collect()) == ["11", "13", "14", "15"]
    bad = [r.raw for r in C.quarantine(raw).collect()]
    assert len(bad) == 3 and any(b and "<PMID>12" in b for b in bad) and any(b and "no such id" in b for b in bad)


def test_all_markup_of_title_and_abstract_goes(spark):
    title = 'A <mml:mrow><mml:msup>x2</mml:msup></mml:mrow> <SPAN class="c">B</SPAN><DispFormula/> &lt;kept&gt;'
    df = spark.createDataFrame([(article(1, title, "one <x:y>two</x:y><br/> <i>three</i>"),)], "raw string")
    got = C.records(C.parse_raw(df)).first()
    assert got.title == "A x2 B <kept>" and got.abstract == "one two three" and got.journal == "J" and got.pub_date == "2020"
    long = spark.createDataFrame([(article(1, "t", "<b>word</b> " * 20000),)], "raw string")
    assert "<b>" not in long.select(strip_inline_tags(F.col("raw"))).first()[0]


def test_blocks_keep_fields_of_many_lines(spark, tmp_path):
    rows = [("1", "T", "X; Y", "first line\nsecond line\n\nthird\nJournal: quoted", "J", "2020"), ("PMC2", "t\nu", "No Authors", "No Abstract", "K", "No Date")]
    C.write_blocks(spark.createDataFrame(rows, "pmid string, title string, authors string, abstract string, journal string, pub_date string"), str(tmp_path / "o"))
    got = C.read_blocks(spark, str(tmp_path / "o"))
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(rows)


def test_records_without_abstract_all_stay(spark):
    rows = [(p, "t", "a", x, "j", "d") for p, x in (("9", "No Abstract"), ("10", "No Abstract"), ("21", "same"), ("3", "same"), ("PMC1", "same"), ("x", "No Abstract"))]
    recs = spark.createDataFrame(rows, "pmid string, title string, authors string, abstract string, journal string, pub_date string")
    assert sorted(r.pmid for r in unique_records(recs).collect()) == ["10", "3", "9", "x"]
    nulls = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id long, t string")
    assert sorted(r.id for r in dedupe_exact(nulls, "t", "id").collect()) == [1, 2, 3]


def test_store_takes_string_ids_once(spark, tmp_path):
    docs = spark.createDataFrame([("PMC1", "a b"), ("7.0", "c"), ("PMC1", "a b")], "id string, text string")
    path = os.path.join(str(tmp_path), "store")
    assert embed_increment(spark, docs, "id", "text", path) == 2
    assert embed_increment(spark, docs.union(spark.createDataFrame([("z", "q")], docs.schema)), "id", "text", path) == 1
    assert sorted(r.id for r in read_store(spark, path, "string").collect()) == ["7.0", "PMC1", "z"]


def test_date_forms(spark):
    forms = ["2020-01-02 00:00:00", "2020-01-02T00:00:00", "2020 Jan 15", "2020/01/05", "2020-01", "Jan 2020", "2020-1-5", "2020-01-02", "2020", "01/31/2020", "2020 Jan"]
    df = spark.createDataFrame([(f,) for f in [*forms, "soon", None]], "d string")
    assert [r[0] for r in df.select(pub_year(F.col("d"))).collect()] == [2020] * len(forms) + [None, None]


def test_knn_with_equal_and_far_vectors(spark):
    r = np.random.default_rng(3)
    same = [(int(i), [1.0] * 8) for i in r.permutation(60)] + [(100 + i, r.normal(size=8).tolist()) for i in range(200)]
    base = spark.createDataFrame(same, "id long, vec array<double>")
    query = spark.createDataFrame([(1000, [1.0] * 8)], base.schema)
    assert [x.b_id for x in knn(query, base, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    far = [(i, (1e4 + r.normal(size=16) * 1e-3).tolist()) for i in range(300)]
    q = [(1000 + i, (1e4 + r.normal(size=16) * 1e-3).tolist()) for i in range(40)]
    got = {(x.q_id, x["rank"]): x.b_id for x in knn(spark.createDataFrame(q, base.schema), spark.createDataFrame(far, base.schema), 5).collect()}
    for i, v in q:
        want = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), b) for b, w in far)[:5]
        assert [got[(i, k + 1)] for k in range(5)] == [b for _, b in want]


def test_a_dropped_mention_drops_no_other(spark):
    from scriptorium.operators.chem import mentions
    docs = spark.createDataFrame([(1, "acid blue dye red"), (2, "blue dye red acid blue"), (3, "red"), (4, None)], "id long, text string")
    got = mentions(docs, "id", "text", ["acid blue", "blue dye", "dye red", "red"]).select("id", "pos", "term").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "acid blue"), (1, 3, "dye red"), (2, 1, "blue dye"), (2, 3, "red"), (2, 4, "acid blue"), (3, 1, "red")]
    table = spark.createDataFrame([(t,) for t in ["Acid  blue", "blue dye", " dye red", "red", "red", "", None]], "term string")
    assert sorted(map(tuple, mentions(docs, "id", "text", table).select("id", "pos", "term").collect())) == sorted(map(tuple, got))
    assert mentions(docs, "id", "text", table.limit(0)).count() == 0


def test_lsh_gives_every_query_its_neighbours(spark):
    from scriptorium.operators.vectors import approx_knn
    rng = np.random.default_rng(3)
    vecs = rng.normal(50, 20, (220, 8))
    vecs[0] += 1000   # far from every bucket of the base
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    q = spark.createDataFrame(rows[:20], "id long, vec array<double>")
    b = spark.createDataFrame(rows[20:], "id long, vec array<double>")
    got = approx_knn(q, b, 5).groupBy("q_id").count().collect()
    assert len(got) == 20 and all(r["count"] == 5 for r in got)
    far = sorted(np.argsort(((vecs[20:] - vecs[0]) ** 2).sum(1))[:5] + 20)
    assert sorted(r.b_id for r in approx_knn(q.where("id = 0"), b, 5).collect()) == far


def test_smote_rows_use_all_their_neighbours(spark):
    from scriptorium.operators.vectors import smote
    # 10 rows raised to 70: six draws a row over five neighbours, the class size a multiple of their number
    rows = [(i, "big" if i < 70 else "small", [float(i), float(i * i % 17)]) for i in range(80)]
    syn = smote(spark.createDataFrame(rows, "id long, label string, vec array<double>"), "id", "vec", "label").collect()
    assert len(syn) == 60
    for base in range(70, 80):
        mine = [r for r in syn if r.base_id == base]
        assert len({r.neighbour_id for r in mine}) == 5 and len({r.u for r in mine}) == len(mine)


def test_records_are_parsed_once(spark, sf_dir):
    from scriptorium.plans import catalog
    for name in ("citation_parse", "citation_export", "citation_quarantine", "citation_missing", "author_frequency"):
        df = catalog.queries()[name](spark, sf_dir)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("from_xml(") + plan.lower().count("xmltostructs(") == 1, name


def test_embedding_stream_skips_what_is_stored(spark, tmp_path):
    from scriptorium.streaming.ingest import embed_stream
    landing, store, held, ck = (str(tmp_path / x) for x in ("landing", "store", "held", "ck"))
    embed_increment(spark, spark.createDataFrame([(1, "held text")], "id long, text string"), "id", "text", held)

    def arrive(rows):
        spark.createDataFrame(rows, "id long, text string").write.mode("append").parquet(landing)
        embed_stream(spark, spark.readStream.schema("id long, text string").parquet(landing), "id", "text", store, ck, held=held)

    arrive([(1, "held text"), (2, "two"), (3, "three"), (3, "three")])
    arrive([(2, "two"), (4, "four")])
    arrive([(4, "four"), (5, None)])
    assert sorted(r.id for r in read_store(spark, store).collect()) == [2, 3, 4, 5]

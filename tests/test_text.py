"""P1, P3, P11, U4 and the distributed numbering helpers."""

import random

from pyspark.sql import Window, functions as F

from scriptorium.functions.text import clean_text, remove_forbidden_phrases, topic_tokens, vectorizer_terms
from scriptorium.operators.indexing import consecutive_index, group_row_number
from scriptorium.operators.textops import dedupe_exact


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_clean_text(spark):
    assert one(spark, None, clean_text) == "No Data"
    assert one(spark, "", clean_text) == "No Data"
    assert one(spark, "   ", clean_text) == ""
    assert one(spark, "  O'Neil \"x\"\n", clean_text) == "ONeil x"


def test_forbidden_phrases(spark):
    f = remove_forbidden_phrases
    assert one(spark, "BACKGROUND: Keratin beta", f) == "Keratin beta"
    assert one(spark, "background: x", f) == "x"                      # case-insensitive
    assert one(spark, "Materials and methods: x", f) == "Materials and x"  # Q-P6
    assert one(spark, "<b>RESULTS:</b> y", f) == "y"
    assert one(spark, "<strong>BACKGROUND</strong> z", f) == "z"
    assert one(spark, "a [Image: see text] b", f) == "a b"
    assert one(spark, "• item", f) == "item"
    assert one(spark, "[Figure: see text]", f) == "[Figure: see text]"  # the list keeps the misspelling


def test_topic_tokens(spark):
    text = "The beta-keratin IL-6 of Alzheimer's disease, (plaques) 3.5 and 42 x"
    toks = one(spark, text, lambda c: vectorizer_terms(topic_tokens(c)))
    # inner punctuation drops the token (Q-T1); stop words and 1-char terms go
    assert toks == ["alzheimer", "disease", "plaques", "42"]
    assert one(spark, None, topic_tokens) == []


def test_dedupe_keeps_lowest_id(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "a")], "id long, text string")
    out = {r.id: r.n_copies for r in dedupe_exact(df, "text", "id").collect()}
    assert out == {1: 3, 2: 1}


def test_consecutive_index_matches_row_number(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 10**6)),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "term string").distinct()
    got = consecutive_index(df, ["term"], "i", num_partitions=7)
    want = df.withColumn("j", F.row_number().over(Window.orderBy("term")) - 1)
    assert got.join(want, "term").where(F.col("i") != F.col("j")).count() == 0
    assert got.count() == want.count()


def test_group_row_number_with_hot_group(spark):
    rnd = random.Random(11)
    # one group holds most rows: it must be spread and still numbered right
    rows = [(0 if rnd.random() < 0.7 else rnd.randint(1, 5), i, rnd.randint(0, 50)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, id long, o int")
    got = group_row_number(df, ["g"], ["o", "id"], "rn", num_partitions=9)
    want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    assert got.join(want, ["g", "id"]).where(F.col("rn") != F.col("rn2")).count() == 0
    assert got.count() == 4000


def test_forbidden_phrases_compute_their_text_once(spark):
    from pyspark.sql import functions as F
    joined = F.array_join(F.array("x", F.lit("RESULTS: good")), " ")
    df = spark.createDataFrame([("a [Image: • see text] b",), ("conclusion: <b>Methods:</b> c",), (None,)], "x string")
    out = df.select(remove_forbidden_phrases(joined).alias("y"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_join") == 1
    assert [r.y for r in out.collect()] == ["a b good", "c good", "good"]


def test_rules_on_a_table_in_one_split_use_all_cores(spark, tmp_path):
    from scriptorium.plans.q_geo import country_of_rules_q
    spark.range(40).selectExpr("id c_custkey", "concat('N', id) c_name", "id % 2 c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(2).selectExpr("id n_nationkey", "'Italy' n_name").write.parquet(str(tmp_path / "nation.parquet"))
    got = country_of_rules_q(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan and got.count() == 40

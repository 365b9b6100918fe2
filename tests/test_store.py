"""The embedding store resumed without moving it: bucketed table, and the stream's own state."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import embed
from scriptorium.operators.embed import embed_increment, embed_increment_table, pending, read_store
from scriptorium.streaming.ingest import embed_stream

DOCS = "id long, text string"


@pytest.fixture
def table(spark):
    name = f"store_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_table_takes_each_id_once_and_counts_what_it_adds(spark, table):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(3, "again"), (7, None)], DOCS)
    assert embed_increment_table(spark, docs.where("id < 20"), "id", "text", table, buckets=4) == 20
    assert embed_increment_table(spark, docs, "id", "text", table) == 30
    assert embed_increment_table(spark, docs, "id", "text", table) == 0
    assert sorted(r.id for r in spark.table(table).collect()) == list(range(50))


def test_nothing_of_the_table_moves_to_find_what_is_missing(spark, table):
    docs = spark.range(3000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    embed_increment_table(spark, docs.where("id % 2 = 0"), "id", "text", table, buckets=8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pending(docs, spark.table(table), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = plan[plan.index("LeftAnti"):]
    assert join.count("Exchange") == 1 and "Bucketed: true" in join and join.index("Exchange") < join.index("Scan parquet")
    assert "Exchange" not in join[join.index("Range ("):]   # the one exchange is that of the records


def test_a_failed_run_adds_nothing_and_is_repeated(spark, table):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], DOCS)
    embed_increment_table(spark, docs.where("id < 10"), "id", "text", table, buckets=4)
    broken = lambda text: F.when(F.length(text) > 0, F.raise_error(F.lit("model lost")).cast("array<double>"))
    with pytest.raises(Exception, match="model lost"):
        embed_increment_table(spark, docs, "id", "text", table, embedder=broken)
    assert spark.table(table).count() == 10
    assert embed_increment_table(spark, docs, "id", "text", table) == 20


def test_string_ids_and_a_folder_store(spark, table, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "id string, text string")
    assert embed_increment_table(spark, docs, "id", "text", table, buckets=2) == 2
    assert embed_increment(spark, docs, "id", "text", str(tmp_path / "s")) == 2
    assert embed_increment(spark, docs, "id", "text", str(tmp_path / "s")) == 0


def test_stream_keeps_its_ids_in_state_and_reads_no_store(spark, tmp_path, monkeypatch):
    landing, store, check = (str(tmp_path / x) for x in ("landing", "store", "check"))

    def land(rows):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(landing)

    def run():
        embed_stream(spark, spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(landing), "id", "text", store, check)

    read = []
    monkeypatch.setattr("scriptorium.streaming.ingest.read_store", lambda *a: read.append(a) or embed.read_store(*a))
    land([(1, "a"), (2, "b"), (1, "c")])
    run()
    land([(2, "later"), (3, "d")])
    run()
    assert sorted(r.id for r in read_store(spark, store).collect()) == [1, 2, 3] and not read
    # the checkpoint is lost: everything comes again, what other batches hold is not taken twice
    check = str(tmp_path / "new")
    land([(4, "e")])
    run()
    assert sorted(r.id for r in read_store(spark, store).collect()) == [1, 2, 3, 4] and read
    assert os.path.isdir(check)

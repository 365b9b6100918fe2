"""Registered queries: streaming ingest (each run lands its input in a fresh
folder under the shared checkpoint location, runs the stream to the end of
the available files, and returns the sink table)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from scriptorium.plans.q_citations import _EXPECTED
from scriptorium.plans.q_embed import ORACLE as EMBED_ORACLE
from scriptorium.plans.q_geo import ORACLE as GEO_ORACLE
from scriptorium.plans.standins import citation_xml
from scriptorium.session import read_table
from scriptorium.sources.citations import records
from scriptorium.streaming.ingest import (citation_stream, dedupe_within_watermark, embed_stream,
                                          ingest_citations, running_counts, work_dir, write_complete)

LEAST_FILES = 32        # files landed per test stream, at least
ROWS_PER_FILE = 50_000  # more files where they would hold more rows than this
BATCHES = 4             # micro-batches a stream takes for what was landed


def landing_files(rows: int) -> tuple[int, int]:
    """(files to land, files per micro-batch) for so many rows."""
    files = max(LEAST_FILES, -(-rows // ROWS_PER_FILE))
    return files, -(-files // BATCHES)


def _land_citations(spark, sf_dir):
    base = work_dir(spark, "citations")
    landing = os.path.join(base, "landing")
    docs = read_table(spark, sf_dir, "documents")
    files, per_batch = landing_files(docs.count())
    citation_xml(docs).select("raw").repartition(files).write.text(landing)
    return base, landing, per_batch


def citation_stream_ingest_q(spark, sf_dir):
    base, landing, per_batch = _land_citations(spark, sf_dir)
    table = os.path.join(base, "records")
    ingest_citations(spark, landing, table, os.path.join(base, "quarantine"), os.path.join(base, "_checkpoint"),
                     max_files_per_trigger=per_batch, raw_table=os.path.join(base, "raw"))
    return spark.read.parquet(table).drop("epoch")


def stream_year_counts_q(spark, sf_dir):
    base, landing, per_batch = _land_citations(spark, sf_dir)
    table = os.path.join(base, "year_counts")
    counts = running_counts(records(citation_stream(spark, landing, per_batch)), "pub_date")
    write_complete(counts, table, os.path.join(base, "_checkpoint"))
    return spark.read.parquet(table)


def stream_event_dedupe_q(spark, sf_dir):
    base = work_dir(spark, "events")
    landing = os.path.join(base, "landing")
    events = read_table(spark, sf_dir, "events")
    # arrivals are chronological: each append covers the next quarter of the
    # time range (cut points from quantiles), rows without a time come first.
    # Every third event is delivered twice at once and every fifth once more
    # with the next quarter; the stream runs to the end after each append and
    # goes on from its checkpoint
    secs = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(secs.alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.001)
    quarter = F.lit(0)
    for cut in cuts:
        quarter = quarter + F.when(secs >= F.lit(int(cut)), 1).otherwise(0)
    table = os.path.join(base, "counts")
    for n in range(len(cuts) + 1):
        now = events.where(quarter == n)
        twice = now.where(F.pmod("event_id", F.lit(3)) == 0)
        again = events.where((quarter == n - 1) & (F.pmod("event_id", F.lit(5)) == 0))
        now.unionByName(twice).unionByName(again).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(events.schema).parquet(landing)
        counts = running_counts(dedupe_within_watermark(stream, ["event_id"], "ts", "1 hour"), "event_type")
        write_complete(counts, table, os.path.join(base, "_checkpoint"))
    return spark.read.parquet(table)


def stream_embed_q(spark, sf_dir):
    base = work_dir(spark, "embed")
    landing = os.path.join(base, "landing")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    files, per_batch = landing_files(docs.count())
    docs.repartition(files).write.parquet(landing)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", per_batch).parquet(landing)
    store = os.path.join(base, "store")
    embed_stream(spark, stream, "doc_id", "text", store, os.path.join(base, "_checkpoint"))
    return spark.read.parquet(store).select(
        F.col("id").alias("doc_id"), F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def stream_country_counts_q(spark, sf_dir):
    """Running country counts over metadata CSV files as they land."""
    from pyspark.sql import types as T

    from scriptorium.operators.geo import country_of, keep_affiliation
    from scriptorium.plans.standins import affiliations
    from scriptorium.sources.tables import read_csv_stream, write_csv

    base = work_dir(spark, "countries")
    landing = os.path.join(base, "landing")
    meta = affiliations(read_table(spark, sf_dir, "customer")).select("ID", "Affiliations")
    files, per_batch = landing_files(meta.count())
    write_csv(meta.repartition(files), landing)
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("Affiliations", T.StringType())])
    stream = read_csv_stream(spark, landing, schema, per_batch)
    # countries are the stream's keys, so state and result table stay within
    # the rule list's countries however many affiliation strings arrive
    kept = stream.where(keep_affiliation(F.col("Affiliations")))
    countries = kept.select(country_of(F.col("Affiliations")).alias("Country")).where(F.col("Country").isNotNull())
    table = os.path.join(base, "counts")
    write_complete(running_counts(countries, "Country"), table, os.path.join(base, "_checkpoint"))
    return spark.read.parquet(table).select("Country", F.col("n").alias("Count"))


ORACLE = {
    "citation_stream_ingest": f"WITH {_EXPECTED} SELECT * FROM expected",
    "stream_year_counts": f"WITH {_EXPECTED} SELECT pub_date, count(*) AS n FROM expected GROUP BY pub_date",
    "stream_event_dedupe": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "stream_embed": EMBED_ORACLE["hash_embedding"],
    "stream_country_counts": GEO_ORACLE["country_frequency"],
}

QUERIES = {
    "citation_stream_ingest": citation_stream_ingest_q,
    "stream_year_counts": stream_year_counts_q,
    "stream_event_dedupe": stream_event_dedupe_q,
    "stream_embed": stream_embed_q,
    "stream_country_counts": stream_country_counts_q,
}

"""Incremental ingest with Structured Streaming.

The reference fetches ids in batches of 50 with three attempts each and
resumes embedding by counting stored rows.  Here files landing in a folder
are the unit of arrival; the streaming checkpoint is the retry/resume
mechanism (a restarted query continues after the last committed batch), and
every micro-batch writes its own folder, so a replayed batch replaces its
earlier output instead of adding rows twice.

All paths are folders under the shared checkpoint location of the session
(``spark.checkpoint.dir``), never a machine-local temporary folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scriptorium.operators.embed import hash_embedding, pending, read_store
from scriptorium.session import checkpoint_dir
from scriptorium.sources.citations import RECORD_TAG, parse_raw, quarantine, raw_records_from_chunks, records


def work_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder for one run under the shared checkpoint location."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{kind}-{uuid.uuid4().hex}")


def citation_stream(spark: SparkSession, landing: str, max_files_per_trigger: int = 1) -> DataFrame:
    """T1 source: raw citation files → parsed rows (``parsed`` struct)."""
    lines = (spark.readStream.option("lineSep", f"</{RECORD_TAG}>")
             .option("maxFilesPerTrigger", max_files_per_trigger).text(landing))
    return parse_raw(raw_records_from_chunks(lines, "value"))


def write_epoch(df: DataFrame, table: str, epoch: int) -> None:
    """Write one micro-batch into ``table/epoch=<id>``, replacing that folder.

    A batch replayed after a failure (same id, same files) rewrites its own
    folder instead of appending twice; the cost does not grow with the table.
    """
    df.write.mode("overwrite").parquet(os.path.join(table, f"epoch={epoch}"))


def ingest_citations(spark: SparkSession, landing: str, table: str, bad_table: str, checkpoint: str,
                     max_files_per_trigger: int = 1, raw_table: str | None = None) -> None:
    """Land parsed records (and quarantined ones) batch by batch; with
    ``raw_table`` also keep each batch's raw records (K3)."""
    def write(batch: DataFrame, epoch: int) -> None:
        # several sinks read the same parsed batch: parse it once
        batch.persist()
        try:
            write_epoch(records(batch), table, epoch)
            write_epoch(quarantine(batch), bad_table, epoch)
            if raw_table is not None:
                write_epoch(batch.select("raw"), raw_table, epoch)
        finally:
            batch.unpersist()

    q = (citation_stream(spark, landing, max_files_per_trigger).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """A running count per key (state: one row per key)."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def write_complete(agg: DataFrame, table: str, checkpoint: str) -> None:
    """Run a streaming aggregation to the end of the available input; each
    batch rewrites the (bounded) result table."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def dedupe_within_watermark(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """U4 on a stream: drop repeats of ``keys`` arriving within ``delay`` of
    the first copy; state older than the watermark is dropped."""
    ts = F.col(event_time).cast(T.TimestampType())  # watermarks need timestamp, not timestamp_ntz
    return stream.withColumn(event_time, ts).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def embed_stream(spark: SparkSession, source: DataFrame, id_col: str, text_col: str, store: str,
                 checkpoint: str, embedder=hash_embedding, held: str | None = None) -> None:
    """Embed arriving records into the keyed store, one folder per
    micro-batch (replays overwrite their own folder).

    Ids that the stream has brought before are kept in its state (in RocksDB
    with this library's session), so a batch costs what it holds, however large
    the store has grown; repeats are dropped there.  Stores of others are read by
    each batch, ids only (J8): the earlier one at ``held``, and what lies at
    ``store`` already when a checkpoint is new.  Batch form: ``embed_increment``."""
    id_type = "string" if dict(source.dtypes)[id_col] == "string" else "bigint"
    others = [] if held is None else [held]
    if not path_exists(spark, os.path.join(checkpoint, "commits")) and path_exists(spark, store):
        others.append(store)

    def write(batch: DataFrame, epoch: int) -> None:
        todo = batch
        for path in others:
            done = read_store(batch.sparkSession, path, id_type)
            if "epoch" in done.columns and path == store:
                done = done.where(F.col("epoch") != epoch)  # a replay does not skip its own rows
            todo = pending(todo, done, id_col)
        out = todo.select(
            F.col(id_col).cast(id_type).alias("id"), embedder(F.col(text_col)).cast("array<double>").alias("embedding"))
        write_epoch(out, store, epoch)

    q = (source.dropDuplicates([id_col]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def path_exists(spark: SparkSession, path: str) -> bool:
    """In whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

"""Distributed consecutive numbering (W6, A7 vocabulary index).

``row_number()`` over a global order moves every row into one task.  Here the
rows are range-partitioned and sorted, numbered inside each partition, and the
per-partition row counts (one small row per partition, a proven bound) are
turned into offsets with a tiny window and broadcast back.  The numbered rows
are checkpointed once, so the counts and the numbering see the same partitions
(range bounds come from sampling, which is not repeatable across two
evaluations).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from scriptorium.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id puts the partition id above bit 33


def consecutive_index(df: DataFrame, order_cols: list[str], out: str = "idx",
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order_cols`` order."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid") - F.shiftleft(part, _LOCAL_BITS)
    ranged = materialize(ranged.withColumn("_part", part).withColumn("_local", local))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_part")
            .withColumn(out, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local"))
            .drop("_mid", "_part", "_local", "_off"))


def group_row_number(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "rn",
                     num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` (1-based)
    without sending a whole group to one task.

    Rows are range-partitioned on (group, order), so a group that holds a
    third of the data is spread over many partitions.  Inside a partition a
    group's rows are contiguous; per (partition, group) the first local
    position and the row count are aggregated (at most partitions × groups
    rows), turned into per-group offsets by a window over that small table,
    and joined back.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(group_cols) + list(order_cols)
    ranged = (df.repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid") - F.shiftleft(part, _LOCAL_BITS)
    ranged = materialize(ranged.withColumn("_part", part).withColumn("_local", local))
    pieces = ranged.groupBy("_part", *group_cols).agg(F.min("_local").alias("_first"),
                                                       F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (ranged.join(offsets.select("_part", *group_cols, "_first", "_off"), ["_part", *group_cols])
            .withColumn(out, F.col("_off") + F.col("_local") - F.col("_first") + 1)
            .drop("_mid", "_part", "_local", "_first", "_off"))

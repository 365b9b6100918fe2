"""Session construction and table access."""

from __future__ import annotations

import contextlib
import gc
import os

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # state of streams on local disk, not on the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "scriptorium",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    On a cluster ``master`` stays None so spark-submit decides; tests and the
    bench pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Folders used where the setting is absent, by application; the setting itself
#: is static and cannot be changed in a running session.
_FALLBACKS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A fallback is only applied when the setting is absent (tests, local
    runs): the given folder, else ``_checkpoints`` under the session's
    warehouse folder.  On a cluster the configured shared folder always wins,
    and without one the call fails.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or _FALLBACKS.get(sc.applicationId)
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = fallback or os.path.join(
            spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), "_checkpoints")
        _FALLBACKS[sc.applicationId] = current
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    Used where one intermediate result feeds two branches that must see the
    very same rows (sampled range bounds, row order inside partitions), and
    where a lost executor must not force a recomputation from the sources.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Within it, shuffle files go when the job that wrote them ends: for loops whose rounds
    are materialized.  Spark computes a lost one again if something still needs it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def give_up_unused(spark: SparkSession) -> None:
    """Checkpoint files of results that nothing refers to any more go now, not when the driver's
    JVM happens to collect its garbage; over the rounds of a loop they would add up."""
    for _ in range(2):   # some are found to be unused once others are gone
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def widen(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan that arrives in too few splits over the cluster.

    Inputs made of a single large row group arrive as one partition; heavy
    per-row work (tokenizing, parsing, distances) would then run in one task.
    Large inputs already come in many splits and are left alone, so no
    shuffle is added at scale.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df

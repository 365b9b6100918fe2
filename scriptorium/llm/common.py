"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizer files lie; every operator that needs one takes the path as a parameter.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

#: White space of the word rules: blank and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_file(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def tokenizer_pattern() -> str:
    """The pre-split pattern that belongs to the byte-level vocabulary."""
    parent = os.path.dirname(os.path.realpath(TOKENIZERS))
    if parent not in sys.path:
        sys.path.append(parent)
    import public_tokenizers
    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster's shared checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), "_checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return freed memory of this process to the system.

    A Python worker outlives its stage; what the allocators keep for later
    would count beside the memory of the stages that follow.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc only
    if trim:
        trim(0)


def batchwise(f: Callable[[pa.Array], pa.Array]) -> Callable:
    """``f`` of one array as a function over the batches of a task, which holds one batch at a time and gives its memory back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = f(batch)
            del batch
            yield out
            del out
            give_back()

    return run


def word_list(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def bound(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a lambda variable.

    Inside a higher-order function an outer expression would be evaluated for
    every element; a variable is read.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 32) -> DataFrame:
    """Join ``rows`` to a table with one row a key, each key's rows dealt to ``salts`` tasks.

    ``keyed`` is repeated ``salts`` times, so a key that holds a third of all
    rows is no single task, whatever adaptive execution does.  Null keys match.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = keyed.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in keyed.columns if c not in keys],
                         F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt2"))
    on = F.col("_salt") == F.col("_salt2")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, on, how).drop("_salt", "_salt2", *[f"_{k}" for k in keys])

"""Stated queries against all rows of integer vectors, in blocks.

Rows and queries are dealt to blocks of a bounded size, each block is packed
into one row, and a task meets one block of queries with one block of rows (a
cell).  Blocks are dealt by the rows' places in the input, so that neither a
repeated row nor a frequent label makes a large block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed

SCALE = 256   # a component x counts as floor(SCALE * x)
LONG = 1 << 63


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component (after scaling)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def whole_numbers(vectors: pa.ChunkedArray) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold it exactly; shorter vectors end in zeros."""
    vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest of three types."""
    most = np.abs(values).max(initial=0)
    return values.astype(np.int16) if most < 1 << 15 else values.astype(np.int32) if most < 1 << 31 else values


def comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a`` and ``b`` padded to one width, in the narrowest type whose inner products are exact.

    Floats are exact while no sum of products passes their digits; beyond that
    plain Python integers take over.
    """
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = width * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return a.astype(kind), b.astype(kind)
    return tuple(np.array([int(v) for v in x.ravel()], object).reshape(x.shape) for x in (a, b))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of ``comparable`` vectors; beyond the range of a long they count as its end."""
    scores = rows @ query
    if scores.dtype == object:
        scores = np.array([max(-LONG, min(LONG - 1, s)) for s in scores], object)
    return scores


class Vectors:
    """A packed block: ids (0 where ``known`` is false), vectors as rows, and further arrays by name."""

    SCHEMA = "block int, ids binary, known binary, width int, kind string, vectors binary"

    def __init__(self, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray):
        self.ids, self.known, self.vectors = ids, known, vectors

    @classmethod
    def of(cls, rows: pa.Table) -> Vectors:
        ids = rows["id"].combine_chunks()
        return cls(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), whole_numbers(rows["vector"]))

    @classmethod
    def unpacked(cls, row: dict) -> Vectors:
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, row["width"]) if row["width"] else np.zeros((len(row["known"]), 0))
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), vectors)

    def packed(self, block: int, **more) -> pa.Table:
        vectors = narrow(self.vectors)
        row = {"block": block, "ids": self.ids.tobytes(), "known": self.known.tobytes(), "width": vectors.shape[1], "kind": vectors.dtype.str,
               "vectors": vectors.tobytes(), **more}
        return pa.table({name: pa.array([value], pa.binary() if isinstance(value, bytes) else pa.int32() if isinstance(value, int) else None)
                         for name, value in row.items()})


def dealt(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``rows`` with their ``block``, each of about ``size`` rows, and the number of blocks."""
    n_blocks = max(1, -(-rows.count() // size))
    place = F.xxhash64(F.monotonically_increasing_id())
    return rows.withColumn("block", F.pmod(place, F.lit(n_blocks)).cast("int")), n_blocks


def packed(rows: DataFrame, size: int, pack, schema: str) -> tuple[DataFrame, int]:
    """Blocks as ``pack`` makes them (one row each), written once."""
    rows, n_blocks = dealt(rows, size)
    return checkpointed(rows.groupBy("block").applyInArrow(pack, schema)), n_blocks


def home_cells(queries: DataFrame, rows: DataFrame, n_query_blocks: int, n_row_blocks: int):
    """Each block of queries with one block of rows."""
    own = F.filter(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)), lambda q: q % n_row_blocks == F.col("block"))
    return queries.groupBy("block").cogroup(rows.withColumn("_of", F.explode(own)).groupBy("_of"))


def all_cells(queries: DataFrame, rows: DataFrame, n_query_blocks: int, n_row_blocks: int):
    """Each block of queries with each block of rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_q", F.col("block")).withColumn("_r", every(n_row_blocks))
    r = rows.withColumn("_r", F.col("block")).withColumn("_q", every(n_query_blocks))
    return q.groupBy("_q", "_r").cogroup(r.groupBy("_q", "_r"))


def first_row(cell: pa.Table) -> dict | None:
    return cell.to_pylist()[0] if len(cell) else None

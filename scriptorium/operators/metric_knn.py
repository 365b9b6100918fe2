"""Exact Euclidean k-NN that skips what the triangle inequality rules out.

Pivots (spread over a bounded sample of base rows) part the space: every base row belongs
to its nearest pivot, the rows of a pivot lie in rings by their distance to
it, and a ring with many rows is dealt to blocks of about ``block_rows``.  A
row of a ring is at least ``max(d - r_max, r_min - d)`` away from a query
whose distance to the pivot is ``d``, and at least as far as the plane halfway
between the query's nearest pivot and the ring's.

Round one finds each query a bound of its k-th distance: from the counts and
outer radii alone, then by searching one block near it.  Round two sends a
query only to the rings that can hold a row within that bound.  Queries are
grouped by their nearest pivot in an order that keeps near pivots together, and
blocks are shipped in chunks of neighbouring ones, so a block is copied to the
groups that need it and to no others, and a group's queries once to each chunk.
Groups and chunks grow with the tables up to a bound of bytes, whatever
the blocks: a row travels as often as the other side has groups or chunks.
Where nothing can be ruled out (evenly spread vectors of many dimensions) this
is the grid of :func:`scriptorium.operators.vectors.knn`; it is never more cells
than that.

What is held whole is bounded: at most ``MAX_PIVOTS`` pivots of together
``PIVOT_BYTES``, and per pivot its radii, counts and at most ``MAX_RINGS``
ring edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from scriptorium.operators.vectors import _cell_kernel, has_string_ids, shipped_rows
from scriptorium.session import materialize

MAX_PIVOTS, PIVOT_BYTES, MAX_RINGS = 4096, 16 << 20, 64
SAMPLE = 4     # rows sampled for each pivot
DISTANCES = 1 << 20   # distances to pivots that a task computes at once
SLACK = 1e-6   # of the lengths involved: distances to pivots are rounded, those to rows are not


class Pivots:
    """Pivots in an order that keeps near ones together, around their mean."""

    def __init__(self, vectors: np.ndarray):
        self.centre = vectors.mean(0)
        left = vectors - self.centre
        chain, rest = [], np.arange(len(left))
        at = left[0]
        while len(rest):   # nearest of those left, step by step
            nearest = int(((left[rest] - at) ** 2).sum(1).argmin())
            chain.append(rest[nearest])
            at, rest = left[rest[nearest]], np.delete(rest, nearest)
        self.points = left[chain]
        self.lengths = np.sqrt((self.points ** 2).sum(1))

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all pivots, and how far they may be off."""
        v = vectors - self.centre
        own = (v * v).sum(1)
        squares = own[:, None] + (self.lengths ** 2)[None, :] - 2 * v @ self.points.T
        return np.sqrt(np.maximum(squares, 0)), SLACK * (np.sqrt(own)[:, None] + self.lengths[None, :])


    def least(self, d: np.ndarray) -> np.ndarray:
        """Least distance of a pivot's rows by the plane that parts it from the nearest pivot."""
        first = d.argmin(1)
        between = np.sqrt(np.maximum(self.lengths[first, None] ** 2 + self.lengths ** 2 - 2 * self.points[first] @ self.points.T, 0))
        ahead = d ** 2 - d.min(1)[:, None] ** 2
        return np.divide(ahead, 2 * between, out=np.zeros_like(d), where=between > SLACK * (self.lengths[first, None] + self.lengths))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _slices(batches: Iterator[pd.DataFrame], pivots: Pivots) -> Iterator[pd.DataFrame]:
    """Few enough rows at a time that their distances to all pivots stay within ``DISTANCES``."""
    step = max(1, DISTANCES // len(pivots.points))
    for rows in batches:
        for start in range(0, len(rows), step):
            yield rows.iloc[start:start + step]


def choose_pivots(base: DataFrame, n_base: int, block_rows: int, seed: int = 17) -> Pivots:
    """One pivot for each ``block_rows`` rows within the bounds.

    The sample is drawn by a hash of the id; pivots are rows of it, each drawn
    in proportion to its squared distance to those before it.
    """
    width = base.agg(F.max(F.size("vec"))).first()[0] or 1
    wanted = min(MAX_PIVOTS, PIVOT_BYTES // (8 * width) or 1, -(-n_base // block_rows))
    rows = base.select("vec", F.xxhash64("id", F.lit(seed)).alias("_o")).orderBy("_o").limit(SAMPLE * wanted).select("vec").collect()
    rows = np.array([r["vec"] for r in rows], np.float64)
    rng = np.random.default_rng(seed)
    chosen = [0]
    away = ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < wanted and away.sum() > 0:
        chosen.append(int(rng.choice(len(rows), p=away / away.sum())))
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return Pivots(rows[chosen])


def assigned(base: DataFrame, pivots: Pivots) -> DataFrame:
    """``base`` with its nearest pivot and the distance to it."""
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _slices(batches, pivots):
            d, _ = pivots.distances(_stacked(rows["vec"]))
            best = d.argmin(1)
            yield rows.assign(pivot=best.astype(np.int32), away=d[np.arange(len(d)), best])
    schema = T.StructType([*base.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("away", T.DoubleType())])
    return base.mapInPandas(near, schema)


def rings(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``ring`` and ``part``, and the table of rings: pivot, ring, n, r_min, r_max, parts.

    Edges are approximate quantiles of a pivot's distances, so rings are about
    even; rows at one distance share a ring, whose parts are dealt by hash.
    """
    shares = [i / MAX_RINGS for i in range(1, MAX_RINGS)]
    edges = rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("away", shares, 1000).alias("_e"))
    # every s-th edge leaves about block_rows rows a ring
    step = F.greatest(F.lit(1), F.floor(F.lit(block_rows * MAX_RINGS) / F.col("_n"))).cast("int")
    edges = edges.select("pivot", F.filter("_e", lambda e, i: (i + 1) % step == 0).alias("_e"))
    ring = F.size(F.filter("_e", lambda e: e < F.col("away"))).alias("ring")
    # one row a pivot, bounded by MAX_PIVOTS
    ringed = rows.join(F.broadcast(edges), "pivot").select(*rows.columns, ring)
    table = materialize(ringed.groupBy("pivot", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("r_min"), F.max("away").alias("r_max"))
        .withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int")))
    # pivots times rings: bounded as well
    dealt = ringed.join(F.broadcast(table.select("pivot", "ring", "parts")), ["pivot", "ring"])
    place = F.xxhash64("id", F.monotonically_increasing_id())
    return dealt.withColumn("part", F.pmod(place, F.col("parts")).cast("int")).drop("parts"), table


class Bounds:
    """Per pivot: number of rows, inner and outer radius, and of its rings of k rows or more the outer radii."""

    def __init__(self, table: DataFrame, n_pivots: int, k: int):
        of = table.groupBy("pivot").agg(F.sum("n").alias("n"), F.min("r_min").alias("low"), F.max("r_max").alias("high"),
                                        F.min(F.when(F.col("n") >= k, F.col("r_max"))).alias("full"),
                                        F.min_by("ring", F.when(F.col("n") >= k, F.col("r_max"))).alias("home")).collect()  # a row a pivot
        self.low, self.high, self.full = np.full(n_pivots, np.inf), np.full(n_pivots, -np.inf), np.full(n_pivots, np.inf)
        self.home, self.n = np.full(n_pivots, -1, np.int32), np.zeros(n_pivots, np.int64)
        for r in of:
            p = r["pivot"]
            self.low[p], self.high[p], self.n[p] = r["low"], r["high"], r["n"]
            if r["full"] is not None:
                self.full[p], self.home[p] = r["full"], r["home"]


def _near_queries(queries: DataFrame, pivots: Pivots, bounds: Bounds) -> DataFrame:
    """Queries with their nearest pivot, a pivot and ring to search first, and a bound of the k-th distance."""
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _slices(batches, pivots):
            d, off = pivots.distances(_stacked(rows["vec"]))
            reach = d + off + bounds.full[None, :]   # k rows lie within
            first, every = reach.argmin(1), np.arange(len(d))
            yield rows.assign(pivot=d.argmin(1).astype(np.int32), home_pivot=first.astype(np.int32), home_ring=bounds.home[first], bound=reach[every, first])
    more = [("pivot", T.IntegerType()), ("home_pivot", T.IntegerType()), ("home_ring", T.IntegerType()), ("bound", T.DoubleType())]
    return queries.mapInPandas(near, T.StructType([*queries.schema.fields, *[T.StructField(*m) for m in more]]))


def _in_groups(queries: DataFrame, n_pivots: int, block_rows: int) -> DataFrame:
    """Queries with their ``group``: pivots in their order share a group, a large one has several."""
    counts = {r["pivot"]: r["n"] for r in queries.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    table, group, filled = [], 0, 0
    for p in range(n_pivots):
        n = counts.get(p, 0)
        if filled and filled + n > block_rows:
            group, filled = group + 1, 0
        parts = max(1, -(-n // block_rows))
        table.append((p, group, parts))
        group, filled = (group + parts, 0) if parts > 1 else (group, filled + n)
    of = queries.sparkSession.createDataFrame(table, "pivot int, _from int, _parts int")
    return (queries.join(F.broadcast(of), "pivot")
            .withColumn("group", (F.col("_from") + F.pmod(F.xxhash64("id"), F.col("_parts"))).cast("int")).drop("_from", "_parts"))


def _round_one(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Queries with the k-th distance in the first part of the ring that they search first."""
    def task(key, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(q) and len(b) >= k:
            near = _cell_kernel(k, False, [])(key, q, b)
            kth = near.groupby("q_id")["dist"].max()
            found = q["id"].map(kth).to_numpy(np.float64)
            q = q.assign(bound=np.fmin(q["bound"], found))
        return q[columns]
    columns = queries.columns
    seats = queries.select(F.col("home_pivot").alias("_p"), F.col("home_ring").alias("_r"), F.col("group").alias("_g")).distinct()
    base = blocks.where(F.col("part") == 0).join(seats, (F.col("pivot") == F.col("_p")) & (F.col("ring") == F.col("_r"))).drop("pivot", "ring")
    return (queries.groupBy("home_pivot", "home_ring", "group").cogroup(base.groupBy("_p", "_r", "_g")).applyInPandas(task, queries.schema))


def surviving(queries: DataFrame, table: DataFrame, pivots: Pivots, bounds: Bounds) -> DataFrame:
    """Groups of queries times the blocks of rings that can hold a row within the bound of one of them."""
    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _slices(batches, pivots):
            d, off = pivots.distances(_stacked(rows["vec"]))
            bound = rows["bound"].to_numpy()[:, None]
            least = np.maximum(np.maximum(d - bounds.high, bounds.low - d), pivots.least(d)) - 2 * off
            group = rows["group"].to_numpy()
            meets, within = least <= bound, bound + 2 * off
            nearest, furthest = np.where(meets, d - within, np.inf), np.where(meets, d + within, -np.inf)
            for g in np.unique(group):
                own = group == g
                p = np.flatnonzero(meets[own].any(0))
                yield pd.DataFrame({"group": np.full(len(p), g, np.int32), "pivot": p.astype(np.int32),
                                    "from": nearest[own].min(0)[p], "to": furthest[own].max(0)[p]})
    # a group's queries side by side, so that few rows tell what it needs
    asked = queries.select("vec", "bound", "group").repartition("group").sortWithinPartitions("group")
    near = (asked.mapInPandas(reach, "group int, pivot int, from double, to double")
            .groupBy("group", "pivot").agg(F.min("from").alias("from"), F.max("to").alias("to")))
    of = table.select(F.col("pivot").alias("_p"), "ring", "r_min", "r_max", "n", "parts")
    return near.join(of, (F.col("pivot") == F.col("_p")) & (F.col("from") <= F.col("r_max")) & (F.col("r_min") <= F.col("to"))).select(
        "group", "pivot", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _in_chunks(seats: DataFrame, table: DataFrame, bounds: Bounds, rows: int) -> DataFrame:
    """Seats with their ``chunk``: blocks one after the other, about ``rows`` rows a chunk."""
    before = np.cumsum(bounds.n) - bounds.n
    start = table.sparkSession.createDataFrame([(p, int(n)) for p, n in enumerate(before)], "pivot int, _start long")   # a row a pivot
    earlier = Window.partitionBy("pivot").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    at = (table.join(F.broadcast(start), "pivot").select(
        "pivot", "ring", (F.col("_start") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("_at"), (F.col("n") / F.col("parts")).alias("_each")))
    # pivots times rings
    met = seats.join(F.broadcast(at), ["pivot", "ring"])
    return met.withColumn("chunk", F.floor((F.col("_at") + F.col("part") * F.col("_each")) / rows).cast("int")).drop("_at", "_each")


def _plan(queries: DataFrame, base: DataFrame, k: int, n_base: int, block_rows: int, wide: bool):
    """Blocks, their rings, queries in groups (of about a block, or ``wide`` ones), the seats, and the rows of a chunk."""
    pivots = choose_pivots(base, n_base, block_rows)
    blocks, table = rings(materialize(assigned(base, pivots)), block_rows)
    bounds = Bounds(table, len(pivots.points), k)
    queries = materialize(_near_queries(queries, pivots, bounds))
    rows = shipped_rows(n_base, queries.count(), block_rows, len(pivots.centre)) if wide else block_rows
    queries = materialize(_round_one(_in_groups(queries, len(pivots.points), rows), blocks, k))
    seats = surviving(queries, table, pivots, bounds)
    return blocks, table, queries, _in_chunks(seats, table, bounds, rows)


BLOCK = ["pivot", "ring", "part"]


def pruned_cells(queries: DataFrame, base: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "vec", block_rows: int = 2048) -> tuple[int, int]:
    """Blocks that groups of ``block_rows`` queries search, and those of all blocks with all groups."""
    q, b = (df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")) for df in (queries, base))
    _, table, asked, seats = _plan(q, b, k, b.count(), block_rows, False)
    n_blocks = table.agg(F.sum("parts")).first()[0]
    return seats.count(), n_blocks * asked.select("group").distinct().count()


def pruned_knn(queries: DataFrame, base: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "vec",
               extra_cols: list[str] | None = None, block_rows: int = 2048, n_base: int | None = None) -> DataFrame:
    """Exact Euclidean k nearest base rows of every query row; ties go to the smaller base id.

    Ids are unique and not null, vectors of one width without nulls, as in
    :func:`scriptorium.operators.vectors.knn`, whose columns it returns:
    ``q_id, b_id, dist, b_<extra>..., rank``.  An empty base gives no rows.
    """
    extra = list(extra_cols or [])
    q = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    b = base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *extra)
    id_type = lambda df: T.StringType() if has_string_ids(df, id_col) else T.LongType()
    types = {f.name: f.dataType for f in base.schema.fields}
    schema = T.StructType([T.StructField("q_id", id_type(queries)), T.StructField("b_id", id_type(base)), T.StructField("dist", T.DoubleType())]
                          + [T.StructField(f"b_{c}", types[c]) for c in extra])
    n_base = b.count() if n_base is None else n_base
    if not n_base:
        return queries.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    blocks, _, asked, seats = _plan(q, b, k, n_base, block_rows, True)
    kernel = _cell_kernel(k, False, extra)

    def task(key, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = kernel(key, q, b)
        if not len(found):
            return found
        bound = found["q_id"].map(q.set_index("id")["bound"])
        return found[found["dist"].to_numpy() <= bound.to_numpy() * (1 + 1e-12)]

    seats = materialize(seats)   # numbers only: groups times blocks at most
    of = seats.select(*[F.col(c).alias(f"_{c}") for c in BLOCK], F.col("group").alias("_g"), F.col("chunk").alias("_c"))
    copies = blocks.join(of, (F.col("pivot") == F.col("_pivot")) & (F.col("ring") == F.col("_ring")) & (F.col("part") == F.col("_part")))
    sent = asked.select("id", "vec", "bound", "group").join(seats.select("group", "chunk").distinct(), "group")
    cells = (sent.groupBy("group", "chunk").cogroup(copies.select("id", "vec", *extra, "_g", "_c").groupBy("_g", "_c"))
             .applyInPandas(task, schema))
    order = Window.partitionBy("q_id").orderBy("dist", "b_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

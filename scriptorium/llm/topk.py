"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists.

Rows lie in blocks.  A block keeps, for every dimension, its rows in the order
of their components.  A query reads all lists from the end that its sign
favours, in steps; rows met for the first time are scored whole.  No unread
row can score more than the query's inner product with the lists' next
components, so reading stops when that bound lies below the k-th score.

The k-th score that a query finds in one block is a floor for all others: a
first round searches one block a query, the second all blocks with these
floors, and there lists are read only as far as the floor demands (not at all
where a block cannot hold anything).  A block then returns only rows that
reach the floor, so little is left to rank.

Cases: vectors that are null or hold null or non-finite components take no
part; shorter vectors end in zeros, empty ones score 0; a query's own rows are
all rows of its id; other repeated rows all take part, and a query that
occurs twice gets its rows twice; a null id asks nothing, as a candidate it
comes after all ids of its score; components of any size are scored exactly,
scores beyond a long count as the end of its range; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import grid
from scriptorium.llm.grid import Vectors

ROWS = 2048       # rows of a block, about
QUERIES = 1024    # queries of a block, about
GROWTH = 1.5      # steps in which lists are read

LISTS = Vectors.SCHEMA + ", lists binary"
ASKED = Vectors.SCHEMA + ", floors binary"
FOUND = "block int, place int, query_id long, vec_id long, score long"


def _pack_lists(rows: pa.Table) -> pa.Table:
    v = Vectors.of(rows)
    lists = np.ascontiguousarray(np.argsort(-v.vectors, axis=0, kind="stable").T.astype(np.int32))
    return v.packed(rows["block"][0].as_py(), lists=lists.tobytes())


def _pack_queries(rows: pa.Table) -> pa.Table:
    v = Vectors.of(rows)
    return v.packed(rows["block"][0].as_py(), floors=np.full(len(v.ids), -np.inf).tobytes())


def kth_best(scores: np.ndarray, k: int):
    at = len(scores) - k
    return (np.sort(scores) if scores.dtype == object else np.partition(scores, at))[at]


def _depths(n: int) -> np.ndarray:
    """Depths at which the bound is looked at, from 0 to n."""
    out = [0]
    while out[-1] < n:
        out.append(min(n, max(out[-1] + 8, int(out[-1] * GROWTH))))
    return np.array(out)


def bounds(queries: np.ndarray, rows: np.ndarray, lists: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Most that a row can score which no list has shown above each depth (below n), by query."""
    q, v = queries.astype(np.float64), rows.astype(np.float64)
    n, dims = len(v), np.arange(v.shape[1])
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    at = depths[depths < n]
    high, low = v[lists[:, at].T, dims], v[lists[:, n - 1 - at].T, dims]
    # sums of doubles: a little above the truth, never below it
    return (up @ high.T + down @ low.T) + 1e-9 * (up @ np.abs(high).T - down @ np.abs(low).T)


def threshold_search(query: np.ndarray, rows: np.ndarray, lists: np.ndarray, depths: np.ndarray, bound: np.ndarray,
                     floor: float, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block, among them all of its ``k`` best with a score of ``floor`` or more, and their scores.

    ``bound`` holds the query's bounds at ``depths``; ``allowed`` marks rows that may be returned.
    """
    n = len(rows)
    upward, downward = lists[query > 0], lists[query < 0]
    seen = np.zeros(n, bool)
    places, scores = [np.zeros(0, np.int64)], [np.zeros(0, rows.dtype)]
    kth = floor
    for i, start in enumerate(depths[:-1]):
        if bound[i] < kth or seen.all():
            break
        met = np.zeros(n, bool)
        met[upward[:, start:depths[i + 1]]] = True
        met[downward[:, n - depths[i + 1]:n - start]] = True
        if not len(upward) and not len(downward):
            met[:] = True   # a query of zeros: every row scores 0
        new = np.flatnonzero(met & ~seen)
        seen |= met
        new = new[allowed[new]]
        if len(new):
            places.append(new)
            scores.append(grid.products(rows[new], query))
            so_far = np.concatenate(scores)
            if len(so_far) >= k:
                kth = max(floor, kth_best(so_far, k))
    return np.concatenate(places), np.concatenate(scores)


def _best(places: np.ndarray, scores: np.ndarray, rows: Vectors, floor: float, k: int) -> list[tuple[int, int]]:
    """(place, score) of the best ``k``: higher scores first, then smaller ids, null ids last."""
    keep = scores >= floor
    places, scores = places[keep], scores[keep]
    if len(scores) > k:
        kth = kth_best(scores, k)
        places, scores = places[scores >= kth], scores[scores >= kth]
    order = sorted(range(len(places)), key=lambda i: (-scores[i], not rows.known[places[i]], rows.ids[places[i]]))
    return [(int(places[i]), scores[i]) for i in order[:k]]


def _cell(q: dict, r: dict, k: int):
    """Per query of a cell: its place, and the best rows of the block."""
    queries, rows = Vectors.unpacked(q), Vectors.unpacked(r)
    lists = np.frombuffer(r["lists"], np.int32).reshape(-1, len(rows.ids))
    asked, given = grid.comparable(queries.vectors, rows.vectors)
    if given.shape[1] > len(lists):   # longer queries: the rows' zeros there are in any order
        lists = np.vstack([lists, np.tile(np.arange(len(rows.ids), dtype=np.int32), (given.shape[1] - len(lists), 1))])
    depths = _depths(len(given))
    bound = bounds(asked, given, lists, depths)
    floors = np.frombuffer(q["floors"])
    for i, query in enumerate(asked):
        allowed = (rows.ids != queries.ids[i]) | ~rows.known
        found = threshold_search(query, given, lists, depths, bound[i], floors[i], k, allowed)
        yield i, _best(*found, rows, floors[i], k), queries, rows


def _home_task(k: int):
    def task(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, r = grid.first_row(queries), grid.first_row(rows)
        floors = np.frombuffer(q["floors"]).copy()
        if r:
            for i, best, _, _ in _cell(q, r, k):
                if len(best) == k:
                    # as a double, never above the score itself
                    floors[i] = np.nextafter(float(best[-1][1]), -np.inf)
        q["floors"] = floors.tobytes()
        return pa.Table.from_pylist([q], queries.schema)
    return task


def _search_task(k: int):
    schema = pa.schema([("block", pa.int32()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def task(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, r = grid.first_row(queries), grid.first_row(rows)
        out = []
        if q and r:
            for i, best, asked, given in _cell(q, r, k):
                out += [{"block": q["block"], "place": i, "query_id": int(asked.ids[i]), "vec_id": int(given.ids[p]) if given.known[p] else None,
                         "score": int(s)} for p, s in best]
        return pa.Table.from_pylist(out, schema)
    return task


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of highest inner product for every query, other than rows of the query's id.

    Both tables have ``id`` (long) and ``vector`` (array of float or double).
    Returns query_id, rank (from 1), vec_id, score.
    """
    fit = lambda df: df.select(F.col("id").cast("long").alias("id"), "vector").where(grid.usable(F.col("vector")))
    asked, n_q = grid.packed(fit(queries).where("id IS NOT NULL"), QUERIES, _pack_queries, ASKED)
    given, n_r = grid.packed(fit(rows), ROWS, _pack_lists, LISTS)
    asked = grid.home_cells(asked, given, n_q, n_r).applyInArrow(_home_task(k), ASKED)
    found = grid.all_cells(asked, given, n_q, n_r).applyInArrow(_search_task(k), FOUND)
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: every 50th vector against all others, five each."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(rows.where(F.col("id") % 50 == 0), rows, 5)


def scored_sql(table: str) -> str:
    """Usable rows of ``table`` with components as whole numbers (doubles, which hold them exactly)."""
    return f"""SELECT *, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM {table}
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def oracle() -> str:
    return f"""WITH rows AS ({scored_sql('embeddings')}),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
        FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
    SELECT query_id, r::int AS rank, vec_id, score FROM ranked WHERE r <= 5"""

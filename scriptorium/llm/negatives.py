"""Hard-negative mining with rotated one-bit codes and deterministic intervals.

Every vector is turned by a seeded random rotation and keeps one bit a
dimension (the signs), the alignment with its code vector (signs over the root
of the dimensions) and its length.  An anchor is turned too and laid out in
bit planes, so its inner product with a code vector comes from popcounts.  A
row's component along its code vector is known by the alignment, and what
stands at right angles to it is bounded by Cauchy-Schwarz: the rest of the
anchor times the rest of the row.  So each pair has an interval that surely
holds its score.  Rows whose interval cannot matter are dropped, the rest are
scored in whole numbers; results are exact, whatever the codes do.

Two searches run over cells of a block of anchors and a block of rows: first
the positives (rows of the anchor's label), then, within each positive's
window of scores, the negatives (rows of other labels).  Before each, one
block an anchor is searched to find a floor for all others, as little is
returned from a cell that does not reach it.

Cases: rows with a null label or a vector that is null or holds a null or
non-finite component take no part; shorter vectors end in zeros; equal scores
go to the smaller id, null ids last; a null id is no anchor; rows of the
anchor's id are not other rows; repeated rows take part each for itself, so a
positive that occurs twice has its negatives twice; an anchor without positives
or a window without rows gives nothing; scores beyond a long count as the end
of its range; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import grid
from scriptorium.llm.grid import Vectors
from scriptorium.llm.topk import kth_best, scored_sql

ROWS = 2048       # rows of a block, about
ANCHORS = 1024    # anchors of a block, about
SEED = 20240917   # of the rotation
PLANES = 6        # bits of a turned anchor's component
SLACK = 1e-9      # of the product of lengths, for rounding

CODED = Vectors.SCHEMA + ", labels binary, codes binary, aligned binary, lengths binary"
ASKED = Vectors.SCHEMA + ", labels binary, floors binary"
POSITIVE = "block int, place int, anchor_id long, id long, score long"
WINDOWS = ASKED + ", p_count binary, p_ids binary, p_known binary, p_scores binary"
NEGATIVE = "block int, place int, p int, anchor_id long, positive_id long, id long, positive_score long, score long"


@lru_cache(maxsize=2)
def rotation(width: int) -> np.ndarray:
    turned, upper = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))
    return turned * np.sign(np.diag(upper))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the turned vectors in words of 64, alignments with the code vectors, lengths."""
    vectors = vectors.astype(np.float64)
    turned = vectors @ rotation(vectors.shape[1])
    return bit_words(turned >= 0), np.abs(turned).sum(1) / np.sqrt(max(1, turned.shape[1])), np.linalg.norm(vectors, axis=1)


def bit_words(bits: np.ndarray) -> np.ndarray:
    raw = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)


class Planes:
    """A turned anchor as whole steps in bit planes: low + step * (sum of 2^j * plane j)."""

    def __init__(self, anchor: np.ndarray):
        turned = anchor.astype(np.float64) @ rotation(len(anchor))
        self.low = turned.min(initial=0)
        self.step = (turned.max(initial=0) - self.low) / (2 ** PLANES - 1) or 1.0
        steps = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.planes = [bit_words((steps >> j & 1).astype(bool)[None])[0] for j in range(PLANES)]
        laid = self.low + self.step * steps
        self.total, self.square, self.off, self.length = laid.sum(), laid @ laid, np.linalg.norm(turned - laid), np.linalg.norm(turned)
        self.width = max(1, len(anchor))

    def intervals(self, codes: np.ndarray, aligned: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores with the rows of these codes."""
        count = lambda words: np.bitwise_count(words).sum(1, dtype=np.int64)
        up = self.low * count(codes) + self.step * sum((1 << j) * count(codes & plane) for j, plane in enumerate(self.planes))
        along = (2 * up - self.total) / np.sqrt(self.width)   # laid-out anchor times code vector
        rest = np.sqrt(np.maximum(self.square - along ** 2, 0)) * np.sqrt(np.maximum(lengths ** 2 - aligned ** 2, 0))
        half = rest + self.off * lengths + SLACK * self.length * lengths
        return aligned * along - half, aligned * along + half


class Coded:
    """A packed block of rows in the order of their labels, with codes."""

    def __init__(self, row: dict):
        self.rows = Vectors.unpacked(row)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.codes = np.frombuffer(row["codes"], np.uint64).reshape(len(self.labels), -1)
        self.aligned, self.lengths = np.frombuffer(row["aligned"]), np.frombuffer(row["lengths"])

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def _pack_rows(width: int):
    def task(rows: pa.Table) -> pa.Table:
        v, labels = _padded(rows, width)
        order = np.argsort(labels, kind="stable")
        v = Vectors(v.ids[order], v.known[order], v.vectors[order])
        codes, aligned, lengths = encode(v.vectors)
        return v.packed(rows["block"][0].as_py(), labels=labels[order].tobytes(), codes=codes.tobytes(), aligned=aligned.tobytes(), lengths=lengths.tobytes())
    return task


def _pack_anchors(width: int):
    def task(rows: pa.Table) -> pa.Table:
        v, labels = _padded(rows, width)
        return v.packed(rows["block"][0].as_py(), labels=labels.tobytes(), floors=np.full(len(v.ids), -np.inf).tobytes())
    return task


def _padded(rows: pa.Table, width: int) -> tuple[Vectors, np.ndarray]:
    v = Vectors.of(rows)
    v.vectors = np.pad(v.vectors, ((0, 0), (0, width - v.vectors.shape[1])))
    return v, rows["label"].to_numpy().astype(np.int64)


def _first(places: np.ndarray, scores: np.ndarray, rows: Vectors, k: int) -> list[tuple[int, int]]:
    """(place, score) of the first ``k``: higher scores first, then smaller ids, null ids last."""
    if len(scores) > k:
        near = scores >= kth_best(scores, k)
        places, scores = places[near], scores[near]
    order = sorted(range(len(places)), key=lambda i: (-scores[i], not rows.known[places[i]], rows.ids[places[i]]))
    return [(int(places[i]), int(scores[i])) for i in order[:k]]


def _below(score: int) -> float:
    """A double under a whole score."""
    return float(np.nextafter(float(score), -np.inf))


# --- positives ---------------------------------------------------------------------------

def positives_in(anchor: np.ndarray, anchor_id: int, label: int, floor: float, block: Coded, given: np.ndarray, exact: np.ndarray, k: int):
    """The first ``k`` other rows of a label in a block that reach ``floor``; the count of rows scored."""
    own = block.of_label(label)
    places = np.arange(own.start, own.stop)
    places = places[(block.rows.ids[own] != anchor_id) | ~block.rows.known[own]]
    lower, upper = Planes(anchor).intervals(block.codes[places], block.aligned[places], block.lengths[places])
    if len(lower) > k:
        floor = max(floor, np.nextafter(kth_best(lower, k), -np.inf))
    left = places[~(upper < floor)]
    return _first(left, grid.products(given[left], exact), block.rows, k), len(left)


def _positive_cell(q: dict, r: dict, k: int):
    anchors, block = Vectors.unpacked(q), Coded(r)
    labels, floors = np.frombuffer(q["labels"], np.int64), np.frombuffer(q["floors"])
    asked, given = grid.comparable(anchors.vectors, block.rows.vectors)
    for i in range(len(asked)):
        first, _ = positives_in(anchors.vectors[i], anchors.ids[i], int(labels[i]), floors[i], block, given, asked[i], k)
        yield i, int(anchors.ids[i]), [(p, s) for p, s in first if s >= floors[i]], block.rows


def _positive_floors(k: int):
    def task(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        q, r = grid.first_row(anchors), grid.first_row(rows)
        floors = np.frombuffer(q["floors"]).copy()
        if r:
            for i, _, first, _ in _positive_cell(q, r, k):
                if len(first) == k:
                    floors[i] = _below(first[-1][1])
        return pa.Table.from_pylist([q | {"floors": floors.tobytes()}], anchors.schema)
    return task


def _positive_search(k: int):
    schema = pa.schema([("block", pa.int32()), ("place", pa.int32()), ("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def task(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        q, r = grid.first_row(anchors), grid.first_row(rows)
        out = []
        if q and r:
            for i, anchor_id, first, given in _positive_cell(q, r, k):
                out += [{"block": q["block"], "place": i, "anchor_id": anchor_id, "id": int(given.ids[p]) if given.known[p] else None, "score": s} for p, s in first]
        return pa.Table.from_pylist(out, schema)
    return task


# --- negatives ---------------------------------------------------------------------------

def _windows(k: int):
    """Anchors' blocks with their positives, ``k`` places an anchor."""
    def task(anchors: pa.Table, positives: pa.Table) -> pa.Table:
        q = grid.first_row(anchors)
        n = len(q["known"])
        count, ids, known, scores = np.zeros(n, np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool), np.zeros((n, k), np.int64)
        for p in positives.to_pylist():
            at = p["place"], p["rank"] - 1
            count[p["place"]] += 1
            ids[at], known[at], scores[at] = p["id"] or 0, p["id"] is not None, p["score"]
        more = {"p_count": count, "p_ids": ids, "p_known": known, "p_scores": scores, "floors": np.full((n, k), -np.inf)}
        return pa.Table.from_pylist([{name: q[name] for name in anchors.column_names if name in q} | {name: a.tobytes() for name, a in more.items()}],
                                    _schema(anchors.schema, more))
    return task


def _schema(base: pa.Schema, more) -> pa.Schema:
    return pa.schema([*base, *[(name, pa.binary()) for name in more if name not in base.names]])


def window_of(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive_score) // 100), (high * positive_score) // 100


def negatives_in(anchor: np.ndarray, label: int, windows: list[tuple[float, int]], block: Coded, given: np.ndarray, exact: np.ndarray, k: int):
    """For each window (floor and highest score) the first ``k`` rows of other labels in it; the count of rows scored."""
    own = block.of_label(label)
    places = np.concatenate([np.arange(own.start), np.arange(own.stop, len(block.labels))])
    lower, upper = Planes(anchor).intervals(block.codes[places], block.aligned[places], block.lengths[places])
    may = np.zeros(len(places), bool)
    for floor, high in windows:
        inside = lower[(lower >= floor) & (upper <= high)]   # surely in the window
        if len(inside) > k:
            floor = max(floor, np.nextafter(kth_best(inside, k), -np.inf))
        may |= ~(upper < floor) & ~(lower > high)
    left = places[may]
    scores = grid.products(given[left], exact)
    found = []
    for floor, high in windows:
        inside = (scores >= floor) & (scores <= high)
        found.append(_first(left[inside], scores[inside], block.rows, k))
    return found, len(left)


def _negative_cell(q: dict, r: dict, k: int, n_pos: int, low: int, high: int):
    anchors, block = Vectors.unpacked(q), Coded(r)
    labels, count = np.frombuffer(q["labels"], np.int64), np.frombuffer(q["p_count"], np.int64)
    scores, floors = np.frombuffer(q["p_scores"], np.int64).reshape(-1, n_pos), np.frombuffer(q["floors"]).reshape(-1, n_pos)
    asked, given = grid.comparable(anchors.vectors, block.rows.vectors)
    for i in range(len(asked)):
        ends = [window_of(int(s), low, high) for s in scores[i, :count[i]]]
        windows = [(max(least, floors[i, p]), most) for p, (least, most) in enumerate(ends)]
        if any(floor <= most for floor, most in windows):
            found, _ = negatives_in(anchors.vectors[i], int(labels[i]), windows, block, given, asked[i], k)
            for p, first in enumerate(found):
                yield i, p, first, block.rows


def _negative_floors(*form):
    def task(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        q, r = grid.first_row(anchors), grid.first_row(rows)
        floors = np.frombuffer(q["floors"]).reshape(-1, form[1]).copy()
        if r:
            for i, p, first, _ in _negative_cell(q, r, *form):
                if len(first) == form[0]:
                    floors[i, p] = _below(first[-1][1])
        return pa.Table.from_pylist([q | {"floors": floors.tobytes()}], anchors.schema)
    return task


def _negative_search(*form):
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in NEGATIVE.split(", ")])

    def task(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        q, r = grid.first_row(anchors), grid.first_row(rows)
        out = []
        if q and r:
            ids, of = np.frombuffer(q["ids"], np.int64), (-1, form[1])
            p_ids, p_known, p_scores = (np.frombuffer(q[c], t).reshape(of) for c, t in (("p_ids", np.int64), ("p_known", bool), ("p_scores", np.int64)))
            for i, p, first, given in _negative_cell(q, r, *form):
                one = {"block": q["block"], "place": i, "p": p, "anchor_id": int(ids[i]), "positive_id": int(p_ids[i, p]) if p_known[i, p] else None,
                       "positive_score": int(p_scores[i, p])}
                out += [one | {"id": int(given.ids[at]) if given.known[at] else None, "score": s} for at, s in first]
        return pa.Table.from_pylist(out, schema)
    return task


# --- over Spark ----------------------------------------------------------------------------

def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(anchors: DataFrame, rows: DataFrame, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    """Hard negatives of each anchor and positive.

    Both tables have ``id`` (long), ``label`` (long) and ``vector`` (array of float
    or double).  An anchor's positives are its first ``n_positives`` other rows
    of its label by inner product; a positive's negatives are the first
    ``n_negatives`` rows of other labels that score from ``low`` to ``high`` per
    cent of it.  Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    fit = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector").where(
        F.col("label").isNotNull() & grid.usable(F.col("vector")))
    anchors, rows = fit(anchors).where("id IS NOT NULL"), fit(rows)
    width = rows.select("vector").union(anchors.select("vector")).agg(F.max(F.size("vector"))).first()[0] or 0
    asked, n_q = grid.packed(anchors, ANCHORS, _pack_anchors(width), ASKED)
    coded, n_r = grid.packed(rows, ROWS, _pack_rows(width), CODED)
    ready = grid.home_cells(asked, coded, n_q, n_r).applyInArrow(_positive_floors(n_positives), ASKED)
    positives = grid.all_cells(ready, coded, n_q, n_r).applyInArrow(_positive_search(n_positives), POSITIVE)
    positives = _ranked(positives, ["block", "place"], n_positives).withColumn("of", F.col("block"))
    asked = asked.groupBy("block").cogroup(positives.groupBy("of")).applyInArrow(_windows(n_positives), WINDOWS)
    form = (n_negatives, n_positives, low, high)
    ready = grid.home_cells(asked, coded, n_q, n_r).applyInArrow(_negative_floors(*form), WINDOWS)
    found = grid.all_cells(ready, coded, n_q, n_r).applyInArrow(_negative_search(*form), NEGATIVE)
    return _ranked(found, ["block", "place", "p"], n_negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: every 50th vector an anchor, five positives, three negatives from 50 to 95 per cent."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows.where(F.col("id") % 50 == 0), rows, 5, 3, 50, 95)


def oracle() -> str:
    return f"""WITH rows AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
        FROM ({scored_sql('embeddings')}) WHERE label IS NOT NULL),
    scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::bigint AS score
        FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    ranked AS (SELECT anchor_id, positive_id, positive_score, vec_id, score,
            row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
        FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
    SELECT anchor_id, positive_id, r::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM ranked WHERE r <= 3"""

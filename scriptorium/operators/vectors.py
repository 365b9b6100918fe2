"""Embedding operators: exact and approximate k-NN, stratified split,
distance-weighted vote, SMOTE (J6, J7, W2, W3, W4, M5, M6, M7).

Exact k-NN is a *blocked* nearest-neighbour join.  Within each group (all
rows, or one class for SMOTE) the base side is hashed into ``nb`` blocks and
the query side into ``nq`` blocks, with ``nb``/``nq`` derived from the
group's size so a block holds about ``block_rows`` rows, in large groups up to ``SHIPPED_ROWS``.  Every query block
meets every base block of its group in one cogroup cell; the cell computes
distances with NumPy and emits only its local top-k per query.  A final
window per query keeps the global top-k.  Memory per task is bounded by the
block size, a large group is split into many cells, and no pair list is
ever materialized.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from scriptorium.functions import fixed_values as fv
from scriptorium.operators.indexing import group_row_number
from scriptorium.session import materialize

ORDER_MUL, ORDER_MOD = 7919, 10007  # arithmetic shuffle key shared with the oracle


def has_string_ids(df: DataFrame, id_col: str) -> bool:
    return isinstance(df.schema[id_col].dataType, T.StringType)


def order_key(df: DataFrame, id_col: str):
    """Seeded-by-arithmetic order used for splits and sample choice; string ids
    go in the order of a hash."""
    number = F.xxhash64(id_col) if has_string_ids(df, id_col) else F.col(id_col) * F.lit(ORDER_MUL)
    return F.pmod(number, F.lit(ORDER_MOD))


# --- exact blocked k-NN --------------------------------------------------------

#: Rows of a block at most, bytes of its vectors at most, and cells from which blocks grow with the tables.
SHIPPED_ROWS, SHIPPED_BYTES, ENOUGH_CELLS = 8192, 8 << 20, 64


def shipped_rows(n_base: int, n_queries: int, block_rows: int, width: int) -> int:
    """Rows of a block: ``block_rows`` while cells are few, more where that still leaves enough cells.

    A row is copied once for each block of the other side, so blocks of one size
    would let the copies grow with the square of the rows at once."""
    most = max(block_rows, min(SHIPPED_ROWS, SHIPPED_BYTES // (8 * max(1, width))))
    return min(most, max(block_rows, int((n_base * n_queries / ENOUGH_CELLS) ** 0.5)))


def _cell_kernel(k: int, exclude_self: bool, extra: list[str]):
    def kernel(key, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = ["q_id", "b_id", "dist"] + [f"b_{c}" for c in extra]
        if len(q) == 0 or len(b) == 0:
            return pd.DataFrame({c: [] for c in cols})
        Q = np.stack(q["vec"].to_numpy()).astype(np.float64)
        B = np.stack(b["vec"].to_numpy()).astype(np.float64)
        qid, bid = q["id"].to_numpy(), b["id"].to_numpy()
        # ids as places among the cell's base ids, which order numbers and strings alike
        names, place = np.unique(bid, return_inverse=True)
        own = np.minimum(np.searchsorted(names, qid), len(names) - 1)
        own = np.where(names[own] == qid, own, -1)
        # centred, so that vectors far from the origin lose no digits
        centre = B.mean(0)
        Qm, Bm = Q - centre, B - centre
        bn, qn = (Bm * Bm).sum(1), (Qm * Qm).sum(1)
        need = min(len(B), k + (1 if exclude_self else 0))
        out, s, step = [], 0, max(1, min(1024, (1 << 21) // len(B)))
        while s < len(Q):
            Qc, ids, me = Q[s:s + step], qid[s:s + step], own[s:s + step]
            # expansion only to choose candidates; exact distances recomputed below
            approx = qn[s:s + step, None] + bn[None, :] - 2.0 * Qm[s:s + step] @ Bm.T
            # every row within the rounding error of the k-th one is a candidate
            error = 8 * (B.shape[1] + 4) * np.finfo(np.float64).eps * (qn[s:s + step] + bn.max())
            kth = np.partition(approx, need - 1, axis=1)[:, need - 1]
            m = int((approx <= (kth + 2 * error)[:, None]).sum(1).max())
            if len(Qc) > 1 and len(Qc) * m * B.shape[1] > 1 << 22:
                step = max(1, (1 << 22) // (m * B.shape[1]))  # many equal distances: fewer queries at a time
                Qc, ids, me, approx = Qc[:step], ids[:step], me[:step], approx[:step]
            s += len(Qc)
            if exclude_self:
                approx[me[:, None] == place[None, :]] = np.inf
            cand = np.argpartition(approx, m - 1, axis=1)[:, :m] if m < len(B) else \
                np.broadcast_to(np.arange(len(B)), (len(Qc), len(B)))
            diff = Qc[:, None, :] - B[cand]
            exact = np.sqrt((diff * diff).sum(2))
            if exclude_self:
                exact[me[:, None] == place[cand]] = np.inf
            order = np.lexsort((place[cand], exact), axis=1)[:, :k]
            rows = np.arange(len(Qc))[:, None]
            sel, d = cand[rows, order], exact[rows, order]
            keep = np.isfinite(d)
            qi = np.broadcast_to(ids[:, None], d.shape)[keep]
            part = {"q_id": qi, "b_id": bid[sel][keep], "dist": d[keep]}
            for c in extra:
                part[f"b_{c}"] = b[c].to_numpy()[sel][keep]
            out.append(pd.DataFrame(part))
        return pd.concat(out, ignore_index=True)
    return kernel


def knn(queries: DataFrame, base: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "vec",
        group_col: str | None = None, extra_cols: list[str] | None = None,
        exclude_self: bool = False, block_rows: int = 2048,
        sizes: tuple[int, int] | None = None, ranked: bool = True, few_groups: bool = False) -> DataFrame:
    """Exact Euclidean k nearest base rows of every query row (J6; J7 with
    ``group_col``).  Ties are broken by the smaller base id.

    Returns ``q_id, b_id, dist, b_<extra>..., rank`` with ``rank`` 1..k.
    ``sizes`` = (base rows, query rows) when the caller already knows them.
    ``ranked=False`` returns the per-cell candidates (up to k per query and
    cell) without the final ranking, for callers that merge them first.
    ``few_groups=True`` says that the groups are classes, whose table of sizes
    is small enough to be broadcast; a class with most rows is then no hot join key.

    Cost per group with B from ``block_rows`` to ``SHIPPED_ROWS``: rows shuffled ≈
    n_b·⌈n_q/B⌉ + n_q·⌈n_b/B⌉, cells = ⌈n_q/B⌉·⌈n_b/B⌉, each holding at most
    ~B query and ~B base vectors (distances computed 1024 queries at a time).
    Raising B trades memory per cell for less replication.  Beyond a few
    blocks :func:`exact_knn` leaves out cells that cannot hold a neighbour.
    """
    extra = list(extra_cols or [])
    g = group_col or "_g"
    q = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"),
                       (F.col(group_col) if group_col else F.lit(0)).alias(g))
    b = base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"),
                    (F.col(group_col) if group_col else F.lit(0)).alias(g), *extra)
    some = b.select(F.size("vec")).first()   # vectors are of one width
    width = some[0] if some else 1
    if group_col is None:
        # one group: the block counts are two scalars (no join on a constant)
        n_b, n_q = sizes if sizes is not None else (b.count(), q.count())
        rows = shipped_rows(n_b, n_q, block_rows, width)
        nb = max(1, -(-n_b // rows))
        nq = max(1, -(-n_q // rows))
        b_blk, q_blk = F.lit(nb), F.lit(nq)
        b_sized, q_sized = b, q
    else:
        # one row per group with its block counts, equi-joined on the group
        sizes = (b.groupBy(g).agg(F.count(F.lit(1)).alias("_nb_rows"))
                 .join(q.groupBy(g).agg(F.count(F.lit(1)).alias("_nq_rows")), g))
        most = shipped_rows(1 << 40, 1 << 40, block_rows, width)
        even = F.sqrt(F.col("_nb_rows").cast("double") * F.col("_nq_rows") / ENOUGH_CELLS)   # as in shipped_rows
        rows = F.least(F.lit(most), F.greatest(F.lit(block_rows), F.floor(even)))
        sizes = sizes.select(g, F.ceil(F.col("_nb_rows") / rows).cast("int").alias("_nb"),
                             F.ceil(F.col("_nq_rows") / rows).cast("int").alias("_nq"))
        if few_groups:
            sizes = F.broadcast(sizes)
        b_sized, q_sized = b.join(sizes, g), q.join(sizes, g)
        b_blk, q_blk = F.col("_nb"), F.col("_nq")
    b_rep = (b_sized
             .withColumn("_bb", F.pmod(F.xxhash64("id"), b_blk).cast("int"))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), q_blk - 1)))
             .drop("_nb", "_nq"))
    q_rep = (q_sized
             .withColumn("_qb", F.pmod(F.xxhash64("id"), q_blk).cast("int"))
             .withColumn("_bb", F.explode(F.sequence(F.lit(0), b_blk - 1)))
             .drop("_nb", "_nq"))
    b_type = {f.name: f.dataType for f in base.schema.fields}
    id_type = lambda df: T.StringType() if has_string_ids(df, id_col) else T.LongType()
    schema = T.StructType([T.StructField("q_id", id_type(queries)), T.StructField("b_id", id_type(base)),
                           T.StructField("dist", T.DoubleType())]
                          + [T.StructField(f"b_{c}", b_type[c]) for c in extra])
    cells = (q_rep.groupBy(g, "_qb", "_bb")
             .cogroup(b_rep.groupBy(g, "_qb", "_bb"))
             .applyInPandas(_cell_kernel(k, exclude_self, extra), schema))
    if not ranked:
        return cells
    w = Window.partitionBy("q_id").orderBy("dist", "b_id")
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Up to this many cells the plain grid costs less than looking for bounds.
FEW_CELLS = 4


def exact_knn(queries: DataFrame, base: DataFrame, k: int, *, id_col: str, vec_col: str, sizes: tuple[int, int],
              extra_cols: list[str] | None = None, block_rows: int = 2048) -> DataFrame:
    """Exact neighbours by the grid while it has few cells, beyond that pruned by pivots; the rows are the same."""
    from scriptorium.operators.metric_knn import pruned_knn
    n_base, n_queries = sizes
    if -(-n_base // block_rows) * -(-n_queries // block_rows) <= FEW_CELLS:
        return knn(queries, base, k, id_col=id_col, vec_col=vec_col, extra_cols=extra_cols, block_rows=block_rows, sizes=sizes)
    return pruned_knn(queries, base, k, id_col=id_col, vec_col=vec_col, extra_cols=extra_cols, block_rows=block_rows, n_base=n_base)


def approx_knn(queries: DataFrame, base: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "vec",
               bucket_length: float = 0.7, num_tables: int = 6,
               seed: int = fv.SEED, block_rows: int = 2048) -> DataFrame:
    """Approximate neighbours with random-projection LSH: the k nearest base
    rows among those sharing a hash bucket with the query in at least one of
    ``num_tables`` tables.  A query that shares buckets with fewer than k base
    rows gets its neighbours from the exact search, so every query has
    min(k, base rows) of them.

    MLlib's ``BucketedRandomProjectionLSH`` supplies the hash functions; the
    candidate search is this module's blocked k-NN with the (table, bucket)
    as the group, so every cell emits only its local top-k (no list of all
    pairs in a bucket) and a bucket holding a large share of the rows is
    split into blocks like any large group.  Matches found in several tables
    are merged per (query, base) pair before the final top-k.

    ``bucket_length`` is in units of the base's spread, the root of the summed
    variances, so it suits vectors of any scale and offset.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def prep(df):
        return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                         array_to_vector(F.col(vec_col)).alias("features"))

    stats = prep(base).agg(Summarizer.variance(F.col("features")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    spread = float(np.sqrt(stats["v"].toArray().sum())) if stats["n"] > 1 else 0.0
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length * (spread or 1.0),
                                      numHashTables=num_tables, seed=seed)
    model = lsh.fit(prep(base))  # draws the random projections only

    def bucketed(df):
        h = model.transform(prep(df)).select("id", "vec", F.posexplode("hashes").alias("_t", "_h"))
        bucket = F.concat_ws(":", F.col("_t").cast("string"),
                             vector_to_array(F.col("_h"))[0].cast("long").cast("string"))
        return h.select("id", "vec", bucket.alias("_bucket"))

    cand = knn(bucketed(queries), bucketed(base), k, id_col="id", vec_col="vec", group_col="_bucket",
               block_rows=block_rows, ranked=False)
    best = cand.groupBy("q_id", "b_id").agg(F.min("dist").alias("dist"))
    w = Window.partitionBy("q_id").orderBy("dist", "b_id")
    top = materialize(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    # ranks are consecutive: a query with enough neighbours has one of rank k
    full = top.where(F.col("rank") == k).select("q_id")
    short = prep(queries).select("id", "vec").join(full, F.col("id") == F.col("q_id"), "left_anti")
    n_short = short.count()
    if not n_short:
        return top
    rest = exact_knn(short, prep(base).select("id", "vec"), k, id_col="id", vec_col="vec", block_rows=block_rows, sizes=(stats["n"], n_short))
    return top.join(full, "q_id", "left_semi").unionByName(rest.select("q_id", "b_id", "dist", "rank"))


# --- split, vote --------------------------------------------------------------

def stratified_split(df: DataFrame, label_col: str, id_col: str, test_share: float = fv.TEST_SHARE) -> DataFrame:
    """Per class, the first ceil(share × n_class) rows in the
    arithmetic order go to test.  Adds boolean ``is_test``."""
    frac = Fraction(test_share).limit_denominator(10000)
    df = materialize(df)   # written once, not shuffled: only keys travel to be numbered
    keyed = df.select(label_col, order_key(df, id_col).alias("_o"), F.col(id_col).alias("_id"))
    ranked = group_row_number(keyed, [label_col], ["_o", "_id"], "_rn")
    counts = ranked.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.floor((F.col("_n") * frac.numerator + frac.denominator - 1) / frac.denominator)
    # the last test row of each class tells all others' side
    last = ranked.join(per_class(counts), label_col).where(F.col("_rn") == n_test).select(
        label_col, F.struct("_o", "_id").alias("_last"))
    own = F.struct(order_key(df, id_col).alias("_o"), F.col(id_col).alias("_id"))
    return df.join(per_class(last), label_col).withColumn("is_test", own <= F.col("_last")).drop("_last")


MAX_BROADCAST_CLASSES = 100_000


def per_class(table: DataFrame) -> DataFrame:
    """A table with one row a class: broadcast while the classes are few, so that a class with most rows is no hot join key."""
    table = materialize(table)
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_CLASSES else table


def weighted_vote(neigh: DataFrame, label_col: str = "b_label") -> DataFrame:
    """Distance weights 1/d; if a neighbour is at distance 0, those at 0
    weigh 1 and the rest 0.  Highest total wins, ties → smallest label."""
    has_zero = F.min("dist").over(Window.partitionBy("q_id")) == 0
    w = F.when(has_zero, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("dist"))
    scores = (neigh.withColumn("_w", w).groupBy("q_id", label_col).agg(F.sum("_w").alias("_s")))
    return scores.groupBy("q_id").agg(
        F.min_by(F.col(label_col), F.struct(-F.col("_s"), F.col(label_col))).alias("prediction"))


def classify(split: DataFrame, id_col: str, vec_col: str, label_col: str, k_max: int = fv.MAX_NEIGHBOURS,
             block_rows: int = 2048, method: str = "exact", **lsh) -> tuple[DataFrame, int, int]:
    """M7: k-NN over the split (train = base, test = queries).  Returns
    (``id, label, prediction``, k, n_train) with k = min(k_max, n_train).

    ``method="exact"`` is the exact search, pruned by pivots beyond a few
    blocks (work grows with the cells that survive, at worst with
    test × train); ``method="lsh"`` uses random-projection LSH, whose work
    grows with the pairs sharing hash buckets — the choice for very large sets.
    """
    train = split.where(~F.col("is_test"))
    test = split.where(F.col("is_test"))
    sizes = {r["is_test"]: r["n"] for r in split.groupBy("is_test").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_train, n_test = sizes.get(False, 0), sizes.get(True, 0)
    if n_train == 0:
        raise ValueError("nothing left to train on")
    k = min(k_max, n_train)
    if method == "exact":
        neigh = exact_knn(test, train, k, id_col=id_col, vec_col=vec_col, extra_cols=[label_col], block_rows=block_rows,
                          sizes=(n_train, n_test))
    elif method == "lsh":
        neigh = (approx_knn(test, train, k, id_col=id_col, vec_col=vec_col, **lsh)
                 .join(train.select(F.col(id_col).alias("b_id"), F.col(label_col).alias(f"b_{label_col}")), "b_id"))
    else:
        raise ValueError(f"unknown method {method!r}")
    pred = weighted_vote(neigh, f"b_{label_col}")
    out = test.select(F.col(id_col), F.col(label_col)).join(pred.withColumnRenamed("q_id", id_col), id_col, "left")
    return out, k, n_train


# --- SMOTE ---------------------------------------------------------------------

# u = (rn * U_ROW + t * U_DRAW + c * CLASS_MUL + U_ADD) mod U_MOD / U_MOD: the modulus is
# prime and neither factor a multiple of it, so u moves with every draw of a row
U_ROW, U_DRAW, U_ADD, U_MOD = 742938285, 950706376, 13, 2147483647
GEN_CHUNK = 100_000  # synthetic points generated per task-sized chunk
CLASS_MUL = 104729
NEIGHBOUR_MUL, NEIGHBOUR_CLASS_MUL = 31, 17


def smote(df: DataFrame, id_col: str, vec_col: str, label_col: str, k_max: int = fv.MAX_NEIGHBOURS,
          block_rows: int = 2048) -> DataFrame:
    """M5: raise every class to the majority count with synthetic points.

    Class c (its position among the sorted labels) with n_c rows needs
    ``n_max - n_c`` points.  Point j is draw ``t = j div n_c`` of the
    base row ranked ``rn = j mod n_c + 1`` (arithmetic order).  It takes the row's
    neighbour number ``(31 rn + 17 c + t) mod k_c + 1`` among the k_c =
    min(5, n_c - 1) nearest same-class rows, so that successive draws of a row
    go round all its neighbours whatever the class size, and a ``u`` in [0, 1)
    that moves with row and draw (``U_ROW``, ``U_DRAW``):
    x = base + u (neighbour - base).  Neighbours are searched only inside
    minority classes.  Synthetic ids are negative and consecutive per class, or
    ``synthetic-1`` and so on where ids are strings.
    Returns the synthetic rows: ``id, label, vec, base_id, neighbour_id, u``.

    Plan: every base row first gets its neighbours' ids and vectors (joins
    on unique ids only), then its own points are generated from it in
    chunks spread over tasks.  A two-row class that needs a billion points
    therefore creates no hot join key and no oversized task.
    """
    # the input is read by several jobs below (class counts, neighbour search,
    # ranking, vector look-ups): compute it once
    df = materialize(df.select(id_col, label_col, vec_col))
    # class number for the arithmetic: position of the label among all labels
    # (labels may be strings such as decades); one row per class
    counts = (df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
              .withColumn("_cidx", F.row_number().over(Window.orderBy(label_col)) - 1))
    per_class = counts.select(label_col, "n_c").collect()   # one row per class
    n_max = max(r["n_c"] for r in per_class)
    bad = [r[label_col] for r in per_class if r["n_c"] < 2 and r["n_c"] < n_max]
    if bad:
        raise ValueError(f"class {bad[0]!r} has a single row: no neighbour to interpolate")
    small = counts.where((F.col("n_c") < n_max))
    plan = (small.withColumn("need", F.lit(n_max) - F.col("n_c"))
            .withColumn("k_c", F.least(F.lit(k_max), F.col("n_c") - 1))
            .withColumn("id_off", F.coalesce(F.sum("need").over(
                Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    plan = F.broadcast(plan)   # one row per class, as collected above
    minority = df.join(plan.select(label_col), label_col)
    neigh = knn(minority, minority, k_max, id_col=id_col, vec_col=vec_col, group_col=label_col,
                exclude_self=True, block_rows=block_rows, few_groups=True)
    # per base row: its k nearest same-class neighbours with their vectors
    nn_vec = neigh.join(minority.select(F.col(id_col).alias("b_id"), F.col(vec_col).alias("_nv")), "b_id")
    nn_list = nn_vec.groupBy(F.col("q_id").alias("base_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "b_id", "_nv"))).alias("_nn"))
    ranked = group_row_number(minority.withColumn("_o", order_key(minority, id_col)), [label_col], ["_o", id_col], "_rn")
    base = (ranked.select(label_col, "_rn", F.col(id_col).alias("base_id"), F.col(vec_col).alias("_bv"))
            .join(plan, label_col)
            .where(F.col("_rn") <= F.col("need"))
            .join(nn_list, "base_id")
            # points j = (rn - 1) + t * n_c for t = 0 .. n_pts - 1
            .withColumn("_n_pts", F.floor((F.col("need") - F.col("_rn")) / F.col("n_c")) + 1))
    chunk = F.col("_chunk")
    chunks = (base.withColumn("_chunk", F.explode(F.sequence(
                F.lit(0).cast("long"), F.ceil(F.col("_n_pts") / F.lit(GEN_CHUNK)).cast("long") - 1)))
              .repartition("base_id", "_chunk"))
    t = F.explode(F.sequence(chunk * GEN_CHUNK, F.least(F.col("_n_pts"), (chunk + 1) * GEN_CHUNK) - 1))
    j = F.col("_j")
    c = F.col("_cidx").cast("long")
    pts = (chunks.withColumn("_t", t)
           .withColumn("_j", F.col("_rn") - 1 + F.col("_t") * F.col("n_c"))
           .withColumn("_m", (F.pmod(F.col("_rn") * NEIGHBOUR_MUL + c * NEIGHBOUR_CLASS_MUL + F.col("_t"), F.col("k_c")) + 1).cast("int"))
           .withColumn("u", F.pmod(F.pmod("_rn", F.lit(U_MOD)) * U_ROW + F.pmod("_t", F.lit(U_MOD)) * U_DRAW
                                   + c * CLASS_MUL + U_ADD, F.lit(U_MOD)) / F.lit(float(U_MOD)))
           .withColumn("_pick", F.element_at(F.col("_nn"), F.col("_m"))))
    u = F.col("u")
    vec = F.zip_with(F.col("_bv"), F.col("_pick._nv"),
                     lambda a, b: a.cast("double") + u * (b.cast("double") - a.cast("double")))
    number = F.col("id_off") + j + 1
    new_id = F.concat(F.lit("synthetic-"), number.cast("string")) if has_string_ids(df, id_col) else -number
    return pts.select(new_id.alias(id_col), F.col(label_col), vec.alias(vec_col),
                      "base_id", F.col("_pick.b_id").alias("neighbour_id"), "u")


def smote_classify(df: DataFrame, id_col: str, vec_col: str, label_col: str,
                   oversample_mode: str = "before_split", test_share: float = fv.TEST_SHARE,
                   method: str = "exact", **kw) -> tuple[DataFrame, int, int]:
    """Q-K2: SMOTE + split + k-NN.  ``before_split`` is the reference order
    (synthetic neighbours of test rows can leak into training);
    ``train_only`` splits first and oversamples the training rows only;
    ``none`` does without SMOTE.  ``method`` is :func:`classify`'s."""
    if oversample_mode == "before_split":
        split = stratified_split(oversample(df, id_col, vec_col, label_col, **kw), label_col, id_col, test_share)
    elif oversample_mode == "none":
        split = stratified_split(df, label_col, id_col, test_share)
    elif oversample_mode == "train_only":
        split = stratified_split(df, label_col, id_col, test_share)
        train = split.where(~F.col("is_test")).drop("is_test")
        test = split.where(F.col("is_test")).select(
            id_col, label_col, F.col(vec_col).cast("array<double>").alias(vec_col), "is_test")
        split = (oversample(train, id_col, vec_col, label_col, **kw).withColumn("is_test", F.lit(False))
                 .unionByName(test))
    else:
        raise ValueError(f"unknown oversample mode {oversample_mode!r}")
    return classify(split, id_col, vec_col, label_col, method=method)


def oversample(df: DataFrame, id_col: str, vec_col: str, label_col: str, **kw) -> DataFrame:
    """Original rows (vectors as double) ∪ synthetic rows."""
    syn = smote(df, id_col, vec_col, label_col, **kw)
    orig = df.select(id_col, label_col, F.col(vec_col).cast("array<double>").alias(vec_col))
    return orig.unionByName(syn.select(id_col, label_col, vec_col))


# --- 2-D map (M10) ----------------------------------------------------------------

def project_2d(df: DataFrame, id_col: str, vec_col: str, keep: list[str] | None = None) -> DataFrame:
    """Principal-component projection to two dimensions (MLlib PCA on
    the distributed covariance; only the d×d matrix reaches the driver)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    keep = list(keep or [])
    feats = df.select(id_col, *keep, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(feats)
    xy = vector_to_array(F.col("xy"))
    return model.transform(feats).select(id_col, *keep, xy[0].alias("x"), xy[1].alias("y"))

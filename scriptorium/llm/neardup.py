"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words in a row (a shorter text is one shingle).  A shingle
weighs its count in the text times a smoothed inverse document frequency; the
frequencies are counted over all documents in a table of hashed buckets, whose
size is fixed and which is the only thing broadcast.

1. Texts with the same words are one node of the graph from here on.
2. Each node draws ``BANDS * ROWS`` samples: for a shingle of weight w with
   gamma(2, 1) numbers r, c (by quantile) and a uniform b, t = floor(ln(w) / r + b) and
   ln a = ln c - r (t + 1 - b); the least a is the sample.  ``ROWS`` samples make
   a band; equal bands make a bucket.
3. Each bucket's least node, its centre, is compared with the other nodes: one
   pair a member.  What is then not linked to the centre's component is compared
   with all other nodes of the bucket, since a centre alone would lose links.
   This goes by blocks of at most ``BLOCK`` nodes, each pair of blocks in one
   task with an inverted index of shingles; two nodes are compared in the first
   band they share only, not at all if they are in one component already or their
   total weights exclude the similarity, and the task returns links that join
   components, never pairs.  Texts are fetched for nodes with a pair left only.  Similarity is
   weighted Jaccard similarity of the whole texts throughout.
4. Classes are the connected components of the verified links, by least labels
   and pointer jumps; labels and links stay distributed.

The idf is damped to [1, 1 + ``IDF_RANGE``]: in a large group of near copies the
common shingles are frequent and those that differ are not, so a strong idf
would count little but the differences.

Plan: two passes over the texts (frequencies; samples), and one that fetches the
texts of nodes that have a candidate.  Hot groups: equal texts collapse in
partial aggregation, buckets are aggregated before they are joined, and joins
whose one side is a hot bucket or centre are plain equi-joins of rows of fixed
width, which adaptive execution splits.

Cases: null counts as an empty text; texts without words form one class; texts
are read whole at any length; equal rows and equal ids with other texts each
have a row in the result; a class all of whose ids are null has a null class id;
an empty table gives an empty table; only the named columns are read, so extra
columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import common

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
BLOCK = 256
IDF_BITS, IDF_RANGE = 18, 0.25
#: Bytes of text that are hashed at once, and shingles that are sampled at once.
CHUNK, LOT = 1 << 16, 1 << 12

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_PLACES = mix(np.arange(101, 101 + WORDS, dtype=np.uint64) * _M1) | np.uint64(1)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as long as was needed."""

    base = 0x9E3779B97F4A7C15 | 1
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            def table(b: int) -> np.ndarray:
                out = np.full(n, np.uint64(b), np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)
            cls.up, cls.down = table(cls.base), table(pow(cls.base, -1, 1 << 64))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of every word of a UTF-8 text."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    Powers.need(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * Powers.up[:len(raw)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * Powers.down[starts] + (ends - starts).astype(np.uint64) * _M1)


def shingles(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Hashes of ``width`` words in a row; one hash for a shorter text with words."""
    n = min(width, len(words))
    if n == 0:
        return words
    out = np.full(len(words) - n + 1, np.uint64(n))
    for j in range(n):
        out += words[j:len(words) - n + 1 + j] * _PLACES[j]
    return mix(out)


def texts_shingles(texts: pa.Array):
    """Shingle hashes of each text, hashed many texts at a time."""
    some, size = [], 0

    def done():
        data = b"\n".join(some)
        starts, words = word_hashes(data)
        ends = np.cumsum([len(b) + 1 for b in some])
        cut = np.searchsorted(starts, np.concatenate([[0], ends]))
        return [shingles(words[a:b]) for a, b in zip(cut[:-1], cut[1:])]

    for t in texts:
        b = (t.as_py() or "").encode()
        if some and size + len(b) > CHUNK:
            yield from done()
            some, size = [], 0
        some.append(b)
        size += len(b)
    if some:
        yield from done()


def node_key(text: str | None) -> str:
    """What texts with the same words have in common."""
    return hashlib.md5(b" ".join((text or "").encode().split())).hexdigest()


def bucket_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(bucket, df): in how many documents a bucket of shingles occurs; bucket -1 counts documents."""

    def count(batches):
        total, docs = np.zeros(1 << IDF_BITS, np.int64), 0
        for b in batches:
            for s in texts_shingles(b.column(0)):
                total[np.unique(s & np.uint64(len(total) - 1)).astype(np.int64)] += 1
                docs += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some]), pa.int32()), pa.array(np.concatenate([[docs], total[some]]), pa.int64())], ["bucket", "df"])

    per_task = df.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, df bigint")
    return per_task.groupBy("bucket").agg(F.sum("df").alias("df"))


def idf_table(counts: pd.DataFrame) -> np.ndarray:
    """Damped weights by bucket, from 1 (in every document) upwards."""
    total = np.zeros(1 << IDF_BITS)
    inner = counts[counts.bucket >= 0]
    total[inner.bucket.to_numpy()] = inner.df
    docs = float(counts.df[counts.bucket < 0].sum())
    return (1 + IDF_RANGE * np.log((1 + docs) / (1 + np.minimum(total, docs))) / np.log(2 + docs)).astype(np.float32)


def weighted(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, with their TF-IDF weights."""
    distinct, counts = np.unique(hashes, return_counts=True)
    return distinct, counts.astype(np.float32) * idf[(distinct & np.uint64(len(idf) - 1)).astype(np.int64)]


_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _M1)


def gamma_quantiles(bits: int) -> np.ndarray:
    """Quantiles of gamma(2, 1) at the middles of 2**bits equal parts, from its distribution function."""
    x = np.concatenate([np.geomspace(1e-6, 1e-2, 1 << 14), np.linspace(1e-2, 40, 1 << 19)[1:]])
    return np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), -np.expm1(-x) - x * np.exp(-x), x)


_R = gamma_quantiles(16).astype(np.float32)
_LN_C = np.log(gamma_quantiles(16)).astype(np.float32)
_LOW = np.uint64(0xFFFF)


def samples(distinct: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The least ln a of each draw as 32-bit patterns; zeros for no shingles."""
    if not len(distinct):
        return np.zeros(len(_SEEDS), np.uint64)
    best = np.full(len(_SEEDS), np.inf, np.float32)
    for at in range(0, len(distinct), LOT):
        x = mix(distinct[at:at + LOT, None] ^ _SEEDS)
        r = _R[(x & _LOW).astype(np.int64)]
        b = (x >> np.uint64(33)).astype(np.int32).astype(np.float32) * np.float32(2.0 ** -31)
        t = np.floor(np.log(weights[at:at + LOT])[:, None] / r + b)
        b -= t
        b -= np.float32(1)
        b *= r
        b += _LN_C[((x >> np.uint64(16)) & _LOW).astype(np.int64)]
        np.minimum(best, b.min(0), out=best)
    return best.view(np.uint32).astype(np.uint64)


def bands(distinct: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One hash a band."""
    s = samples(distinct, weights).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * _M1 + s[:, j])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of shingles."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common_ = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return common_ / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - common_)


def signed(df: DataFrame, id_col: str, text_col: str, idf) -> DataFrame:
    """(doc_id, key, total, bands): node, total weight and bands of every document."""

    @F.arrow_udf("struct<key:string,total:double,bands:array<bigint>>")
    @common.batchwise
    def sign(texts: pa.Array) -> pa.Array:
        table, keys, totals, out = idf.value, [], [], []
        for t, s in zip(texts, texts_shingles(texts)):
            distinct, w = weighted(s, table)
            keys.append(node_key(t.as_py()))
            totals.append(float(w.sum(dtype=np.float64)))
            out.append(bands(distinct, w) if len(distinct) else np.zeros(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in out])])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64()))
        return pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(totals, pa.float64()), lists], ["key", "total", "bands"])

    return df.select(F.col(id_col).alias("doc_id"), sign(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def texts_of(nodes: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text) of nodes given as (key, doc_id)."""

    @F.arrow_udf("string")
    @common.batchwise
    def key_of(texts: pa.Array) -> pa.Array:
        return pa.array([node_key(t.as_py()) for t in texts], pa.string())

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    met = docs.join(nodes.select("key", F.col("doc_id").alias("rep")), F.col("doc_id").eqNullSafe(F.col("rep")))
    return met.select("key", "text", key_of("text").alias("own")).where("key = own").select("key", "text")


def similar_pairs(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The (a, b) of ``pairs`` that are similar enough."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        table, last, out = idf.value, (None, None), []
        for x, y in zip(left, right):
            x = x.as_py()
            if last[0] != x:
                last = (x, weighted(next(texts_shingles([pa.scalar(x)])), table))
            out.append(similarity(last[1], weighted(next(texts_shingles([y])), table)) >= SIMILARITY)
        return pa.array(out, pa.bool_())

    a, b = texts.select(F.col("key").alias("a"), F.col("text").alias("x")), texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(b, "b").join(a, "a").where(similar("x", "y")).select("a", "b").distinct()


class Postings:
    """Shingles of several texts by shingle, to compare one text with all of them."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        sizes = [len(s) for s, _ in sets]
        all_, doc = np.concatenate([s for s, _ in sets]), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(all_, kind="stable")
        self.words, first = np.unique(all_[order], return_index=True)
        self.at = np.concatenate([first, [len(all_)]])
        self.doc, self.weight = doc[order], np.concatenate([w for _, w in sets])[order]
        self.totals = np.array([w.sum(dtype=np.float64) for _, w in sets])

    def similarities(self, one: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        place = np.searchsorted(self.words, one[0])
        hit = np.flatnonzero(self.words[np.minimum(place, len(self.words) - 1)] == one[0])
        place = place[hit]
        n = self.at[place + 1] - self.at[place]
        flat = np.repeat(self.at[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.doc[flat], np.minimum(np.repeat(one[1][hit], n), self.weight[flat]).astype(np.float64), len(self.totals))
        return shared / (self.totals + one[1].sum(dtype=np.float64) - shared)


def open_pairs(block: pd.DataFrame) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Places of chunk j, and for each place of chunk i with a pair to compare a mask over them.

    Labels, total weights and earlier bands decide, so no text is needed.
    """
    i, j, band = (block[c].iloc[0] for c in ("i", "j", "band"))
    totals, chunk, label = block["total"].to_numpy(), block["chunk"].to_numpy(), block["label"].to_numpy()
    right, out = np.flatnonzero(chunk == j), []
    if not len(right):
        return right, out
    before = np.stack([np.asarray(b)[:band] for b in block["bands"]]) if band else np.zeros((len(block), 0), np.int64)
    for a in np.flatnonzero(chunk == i):
        test = label[right] != label[a]
        test &= np.minimum(totals[right], totals[a]) >= SIMILARITY * np.maximum(totals[right], totals[a]) - 1e-3
        if i == j:
            test &= right > a
        if band:
            test &= ~(before[right] == before[a]).any(1)
        if test.any():
            out.append((a, test))
    return right, out


def block_links(block: pd.DataFrame, table: np.ndarray) -> list[tuple[str, str]]:
    """Links that join components, between the nodes of seats i and j of one bucket.

    ``block`` has key, label, total, bands, chunk, i, j, band and text of each node.  Only
    texts with a pair to compare are hashed.
    """
    block = block.sort_values("key").reset_index(drop=True)
    right, pairs = open_pairs(block)
    if not pairs:
        return []
    met = np.logical_or.reduce([test for _, test in pairs])
    right, pairs = right[met], [(a, test[met]) for a, test in pairs]
    used = np.union1d(right, [a for a, _ in pairs])
    sets = dict(zip(used, (weighted(s, table) for s in texts_shingles(pa.array(block["text"].iloc[used], pa.string())))))
    keys, label = block["key"].to_numpy(), block["label"].to_numpy().copy()
    index, out = Postings([sets[k] for k in right]), []
    for a, test in pairs:
        test = test & (label[right] != label[a])
        if not test.any():
            continue
        for b in right[test & (index.similarities(sets[a]) >= SIMILARITY)]:
            if label[b] != label[a]:
                out.append((keys[a], keys[b]))
                label[label == label[b]] = label[a]
    return out


def rest_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links inside buckets that the comparison with the centres did not make one component."""
    lead_label = labels.select(F.col("key").alias("lead"), F.col("label").alias("lead_label"))
    seated = members.join(labels, "key", "left").join(lead_label, "lead", "left").select(
        "band", "h", "key", "lead", F.coalesce("label", "key").alias("label"), F.coalesce("lead_label", "lead").alias("lead_label"))
    off = F.col("label") != F.col("lead_label")
    # the centre itself was compared with all others, so a bucket needs two more nodes to hold a pair
    seated = seated.where("key != lead")
    sizes = seated.groupBy("band", "h").agg(F.count_if(off).alias("off"), F.count_if(~off).alias("on")).where("off > 0 and off + on > 1")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    placed = seated.join(sizes.select("band", "h", blocks("off").alias("n_off"), blocks("on").alias("n_on")), ["band", "h"])
    spread = F.xxhash64("key")
    chunk = F.when(off, F.pmod(spread, "n_off")).otherwise(F.col("n_off") + F.pmod(spread, "n_on")).cast("int")
    others = F.sequence(F.lit(0), F.when(off, F.col("n_off") + F.col("n_on")).otherwise(F.col("n_off")) - 1)
    seats = placed.select("band", "h", "key", "label", chunk.alias("chunk"), F.explode(others).alias("other")).select(
        "*", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    full = seats.join(nodes.select("key", "total", "bands"), "key")

    def with_pair(block: pd.DataFrame) -> pd.DataFrame:
        right, pairs = open_pairs(block)
        keep = np.zeros(len(block), bool)
        for a, test in pairs:
            keep[a] = True
            keep[right[test]] = True
        return block[keep]

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(block, idf.value), columns=["a", "b"])

    # texts go only to seats that still have a pair
    still = full.groupBy("band", "h", "i", "j").applyInPandas(with_pair, full.schema)
    return still.join(texts, "key").groupBy("band", "h", "i", "j").applyInPandas(compare, "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the least key of every linked node's component."""
    links = common.checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.checkpointed(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("label")))
    while True:
        near = links.join(labels, links.b == labels.key).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.key == near.a).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("key").alias("label"), F.col("label").alias("above"))
        new = common.checkpointed(lower.join(up, "label").select("key", F.least("label", "above").alias("label"), (F.least("label", "above") != F.col("old")).alias("moved")))
        labels = new.select("key", "label")
        if not new.where("moved").limit(1).count():
            return labels


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, class_id (least id of the class), class_size, key, label."""
    spark = df.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(bucket_counts(df, text_col).toPandas()))
    docs = common.checkpointed(signed(df, id_col, text_col, idf))
    nodes = common.checkpointed(docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.max("total").alias("total"), F.first("bands").alias("bands")))
    seats = nodes.select("key", F.posexplode("bands").alias("band", "h"))
    buckets = seats.groupBy("band", "h").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "h", "lead")
    members = common.checkpointed(seats.join(buckets, ["band", "h"]))
    star = members.where(F.col("key") != F.col("lead")).select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    seen = members.select("key").distinct().join(nodes.select("key", "doc_id"), "key")
    texts = common.checkpointed(texts_of(seen, df, id_col, text_col))
    links = common.checkpointed(similar_pairs(star, texts, idf))
    more = common.checkpointed(rest_links(members, components(links), nodes, texts, idf))
    labels = components(links.union(more))
    by_node = nodes.join(labels, "key", "left").select("key", "doc_id", "n", F.coalesce("label", "key").alias("label"))
    by_class = by_node.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = by_node.select("key", "label").join(by_class, "label")
    return docs.select("doc_id", "key").join(of_node, "key").select("doc_id", "class_id", "class_size", "key", "label")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return classes(df, id_col, text_col).select("doc_id", "class_id", "class_size")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their class: one each, with the least id (nulls last)."""
    found = classes(df, id_col, text_col)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f"))
    chosen = first.select(F.col("f.doc_id").alias("_rep"), F.col("f.key").alias("_key"))

    @F.arrow_udf("string")
    @common.batchwise
    def key_of(texts: pa.Array) -> pa.Array:
        return pa.array([node_key(t.as_py()) for t in texts], pa.string())

    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), key_of(F.col(text_col)).alias("_own"))
    met = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_rep")) & (F.col("_own") == F.col("_key")))
    # equal rows of one id and one text: one of them stays
    one = met.withColumn("_n", F.row_number().over(Window.partitionBy("_rep", "_key").orderBy("_own"))).where("_n = 1")
    return one.select("_row.*")

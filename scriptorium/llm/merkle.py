"""Merkle manifest of a dataset by a tree of SHA-256 midstates.

Every row is a leaf, the leaves of a source form a tree of runs of three in
the order of their ids, and the subroots form one more tree in the order of
their sources.  A child's digest enters its parent as 64 characters of hex,
which is exactly one block of SHA-256, so the state of the hash before each
child slot is eight words that can be copied, kept and resumed.  Parents keep
these states; folding a replaced leaf resumes the state before its slot and
feeds the replacement and the siblings to its right only.

Trees are cut into blocks of ``WIDTH ** LEVELS`` consecutive nodes.  A task
takes some blocks, climbs them and passes one node a block to the next round,
so a source with a third of all rows is many blocks like any other, and the
number of rounds is the logarithm of the rows to the base 2187.  On the way
down every block gets the path above it (one record a level: run length, slot,
state, siblings), and the leaves' blocks fold all their leaves at once.

Cases: a null value enters its leaf as ``-``; a null source is a source of its
own, before all others; null ids come before all others and are never tampered
with; repeated rows are leaves of their own, rows of one id go in the order of
their leaves; empty and long texts are hashed whole; an empty table has no
rows and no root; other columns of the table are not looked at.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed

WIDTH = 3                  # children of a parent
LEVELS = 7                 # levels that one round climbs
BLOCK = WIDTH ** LEVELS    # nodes of a block
GROUP_NODES = 8192         # nodes that a task takes at once, about

#: Words of a path record: run length, slot, state before the slot, two siblings from left to right.
RECORD = 2 + 8 + 8 * (WIDTH - 1)


# --- SHA-256 over arrays ------------------------------------------------------------

def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid ** 3 <= n else (low, mid - 1)
    return low


#: First 32 bits behind the point of the roots of the first primes, as the standard has it.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUNDS = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
#: Four characters of hex as a big-endian word, by 16 bits.
HEX4 = np.frombuffer(b"".join(b"%04x" % i for i in range(1 << 16)), ">u4").astype(np.uint32)


def _turn(x, n: int):
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _schedule(words: list) -> list:
    w = list(words)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    return w


def _feed(state: np.ndarray, schedule: list) -> np.ndarray:
    """``state`` (8 rows of words) after one more block."""
    a, b, c, d, e, f, g, h = state
    for k, w in zip(ROUNDS, schedule, strict=True):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w + k)
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def feed_hex(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """``state`` after the 64 characters of hex of ``digest``; both are 8 rows of words."""
    words = [HEX4[half] for word in digest for half in (word >> np.uint32(16), word & np.uint32(0xFFFF))]
    return _feed(state, _schedule(words))


def _ending(n_blocks: int) -> list:
    block = np.zeros((16, 1), np.uint32)
    block[0], block[15] = 1 << 31, n_blocks * 512
    return _schedule(list(block))


#: The last block of a message of so many whole blocks.
ENDINGS = {k: _ending(k) for k in range(1, WIDTH + 1)}


def close(state: np.ndarray, n_children: np.ndarray) -> np.ndarray:
    """Digests of the messages that ``state`` has taken in."""
    out = state.copy()
    for k, ending in ENDINGS.items():
        of = n_children == k
        if of.any():
            out[:, of] = _feed(state[:, of], ending)
    return out


# --- trees in a task ------------------------------------------------------------------

class Level:
    """Nodes of some blocks and the parents of their runs.

    ``states[j]`` are the parents' states before child slot j.  A block that
    has come to its top has runs without a parent (``size`` 0).
    """

    def __init__(self, digest: np.ndarray, place: np.ndarray, active: np.ndarray):
        begin = ~active | (place % WIDTH == 0)
        self.first = np.flatnonzero(begin)
        self.parent = np.cumsum(begin) - 1
        self.slot = np.where(active, place % WIDTH, 0)
        self.size = np.where(active[self.first], np.bincount(self.parent, minlength=len(self.first)), 0)
        self.digest = digest
        state = np.repeat(START[:, None], len(self.first), 1)
        self.states = []
        for j in range(WIDTH):
            self.states.append(state.copy())
            has = self.size > j
            if has.any():
                state[:, has] = feed_hex(state[:, has], digest[:, self.first[has] + j])
        self.above = np.where(self.size > 0, close(state, self.size), digest[:, self.first])

    def records(self, nodes: np.ndarray) -> np.ndarray:
        """Path records (RECORD rows of words) of ``nodes``; run length 0 where a node has no parent."""
        up, slot = self.parent[nodes], self.slot[nodes]
        out = np.zeros((RECORD, len(nodes)), np.uint32)
        out[0], out[1] = self.size[up], slot
        out[2:10] = np.stack(self.states)[slot, :, up].T
        for j in range(WIDTH - 1):
            child = j + (slot <= j)   # the j-th of the others
            has = child < out[0]
            out[10 + 8 * j:18 + 8 * j, has] = self.digest[:, self.first[up[has]] + child[has]]
        return out


def climb(digest: np.ndarray, block: np.ndarray, place: np.ndarray, n_levels: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Levels of blocks from the leaves up, and the top digests in the order of the blocks.

    ``block`` numbers the blocks from 0 in the order of the nodes, ``place`` is the
    node's position in its block, ``n_levels`` how far each block is to be climbed.
    """
    levels = []
    for depth in range(int(n_levels.max(initial=0))):
        level = Level(digest, place, n_levels[block] > depth)
        levels.append(level)
        digest, block, place = level.above, block[level.first], place[level.first] // WIDTH
    return levels, digest


def fold(digest: np.ndarray, records: np.ndarray) -> np.ndarray:
    """Parents' digests with ``digest`` in the place of the child that ``records`` belong to."""
    size, slot = records[0], records[1]
    state = feed_hex(records[2:10], digest)
    for j in range(WIDTH - 1):   # siblings to the right of the slot
        right = (slot <= j) & (j + 1 < size)
        if right.any():
            state[:, right] = feed_hex(state[:, right], records[10 + 8 * j:18 + 8 * j, right])
    return np.where(size > 0, close(state, size), digest)


# --- Arrow tables to arrays and back -----------------------------------------------------

def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, 8).T.astype(np.uint32)


def _bytes(words: np.ndarray) -> list[bytes]:
    raw = words.T.astype(">u4").tobytes()
    return [raw[i:i + 32] for i in range(0, len(raw), 32)]


def _levels_of(n: np.ndarray) -> np.ndarray:
    """Least number of levels that leave one of n nodes, as far as one round goes."""
    return np.searchsorted(WIDTH ** np.arange(LEVELS), n)


class _Blocks:
    """The blocks of a task: nodes in the order of tree, block and place, and their levels."""

    def __init__(self, nodes: pa.Table):
        self.nodes = nodes = nodes.sort_by([("tree", "ascending"), ("pos", "ascending")])
        pos = nodes["pos"].to_numpy()
        tree = nodes["tree"].combine_chunks().dictionary_encode().indices.to_numpy()
        at = pos // BLOCK
        new = np.ones(len(pos), bool)
        new[1:] = (tree[1:] != tree[:-1]) | (at[1:] != at[:-1])
        self.first = np.flatnonzero(new)
        self.block = np.cumsum(new) - 1
        self.place = pos - at * BLOCK
        self.n = nodes["n"].to_numpy()[self.first]
        self.at = at[self.first]
        self.levels, self.top = climb(_words(nodes["digest"]), self.block, self.place, _levels_of(self.n))

    def walk(self, paths: list[bytes]):
        """Records of every node level by level: through its block, then on the path above it."""
        at = np.arange(len(self.block))
        for level in self.levels:
            yield level.records(at)
            at = level.parent[at]
        lengths = np.array([len(p) // (4 * RECORD) for p in paths])
        for depth in range(int(lengths.max(initial=0))):
            step = np.zeros((RECORD, len(paths)), np.uint32)
            for i in np.flatnonzero(lengths > depth):
                step[:, i] = np.frombuffer(paths[i], np.uint32, RECORD, 4 * RECORD * depth)
            yield step[:, self.block]


NODE = "tree string, pos long, n long, digest binary"
PATH = "tree string, pos long, path binary, subroot binary"


def _climb_task(nodes: pa.Table) -> pa.Table:
    b = _Blocks(nodes)
    return pa.table({"tree": b.nodes["tree"].take(pa.array(b.first)), "pos": b.at,
                     "n": (b.n + BLOCK - 1) // BLOCK, "digest": pa.array(_bytes(b.top), pa.binary())})


def _path_task(nodes: pa.Table, above: pa.Table) -> pa.Table:
    b = _Blocks(nodes)
    above = above.sort_by([("tree", "ascending"), ("pos", "ascending")])
    steps = [r for r in b.walk(above["path"].to_pylist())]
    paths = [b"" for _ in b.block]
    if steps:
        every = np.ascontiguousarray(np.stack(steps).transpose(2, 0, 1))
        paths = [row[row[:, 0] > 0].tobytes() for row in every]
    return pa.table({"tree": b.nodes["tree"], "pos": b.nodes["pos"], "path": pa.array(paths, pa.binary()),
                     "subroot": above["subroot"].take(pa.array(b.block))})


PROOF = "doc_id {id}, leaf binary, subroot binary, proof_sha256 string, folded binary"


def _fold_task(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Digests of the siblings on each leaf's way up, and the root from its replacement."""
    b = _Blocks(leaves)
    above = above.sort_by([("tree", "ascending"), ("pos", "ascending")])
    now = _words(b.nodes["other"])
    others, there = [], []
    for r in b.walk(above["path"].to_pylist()):
        now = fold(now, r)
        others.append(r[10:].T.reshape(-1, WIDTH - 1, 8))
        there.append(np.arange(1, WIDTH) < r[0][:, None])
    proofs = [hashlib.sha256(b"").hexdigest()] * len(b.block)
    if others:
        others = np.concatenate(others, 1).astype(">u4")
        there = np.concatenate(there, 1)
        proofs = [hashlib.sha256(o[t].tobytes().hex().encode()).hexdigest() for o, t in zip(others, there, strict=True)]
    return pa.table({"doc_id": b.nodes["doc_id"], "leaf": b.nodes["digest"], "subroot": above["subroot"].take(pa.array(b.block)),
                     "proof_sha256": pa.array(proofs, pa.string()), "folded": pa.array(_bytes(now), pa.binary())})


# --- rounds over Spark --------------------------------------------------------------------

def part(value: Column) -> Column:
    """A value as it enters a leaf: byte count, colon and value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[part(v) for v in values]), 256))


def ordered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0) and ``n`` (all) of each row in its ``tree``; no tree passes through one task.

    Rows are dealt by ranges of (tree, order), numbered in their partition, and
    shifted by the counts of the tree's earlier partitions.  Equal rows are told
    apart by their place in the input, so that they are spread as well.
    """
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    pieces = dealt.groupBy("tree", "_part").agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_c"))
    of = Window.partitionBy("tree")
    before = F.sum("_c").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_shift"), F.sum("_c").over(of).alias("n"))
    return dealt.join(pieces, ["tree", "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _groups(rows: DataFrame, block: Column, n_groups: int):
    """Rows grouped for tasks; a block is never torn apart."""
    return rows.withColumn("_group", F.pmod(F.xxhash64("tree", block), F.lit(n_groups))).groupBy("_group")


class Tree:
    """Rounds of nodes (``NODE`` columns, others stay in the first round) until each tree has one."""

    def __init__(self, nodes: DataFrame):
        self.rounds, self.n_groups = [], []
        while True:
            nodes = checkpointed(nodes)
            size = nodes.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).first()
            self.rounds.append(nodes)
            self.n_groups.append(size["rows"] // GROUP_NODES + 1)
            if (size["n"] or 0) <= 1:
                break
            nodes = self.grouped(len(self.rounds) - 1).applyInArrow(_climb_task, NODE)
        self.tops = self.rounds[-1].select("tree", "digest")

    def grouped(self, round_: int):
        return _groups(self.rounds[round_], F.floor(F.col("pos") / BLOCK), self.n_groups[round_])

    def down(self, above: DataFrame, last, schema: str) -> DataFrame:
        """Paths from those of the tops (``PATH`` columns) down to the first round, which ``last`` takes."""
        for i in range(len(self.rounds) - 1, -1, -1):
            task, out = (_path_task, PATH) if i else (last, schema)
            if i == len(self.rounds) - 1 and i:
                continue   # the last round's nodes are the tops themselves
            above = self.grouped(i).cogroup(_groups(above, F.col("pos"), self.n_groups[i])).applyInArrow(task, out)
        return above


def manifest(leaves: DataFrame) -> DataFrame:
    """Proof and folded root of every leaf.

    ``leaves`` has ``tree`` (string), ``doc_id``, ``digest`` (binary) and ``other``
    (binary: the leaf to fold in its place).  Returns doc_id, leaf, subroot,
    proof_sha256, folded, and root.
    """
    id_type = leaves.schema["doc_id"].dataType.simpleString()
    trees = Tree(ordered(checkpointed(leaves), ["doc_id", "digest"]))
    subroots = trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    whole = Tree(ordered(subroots, ["source"]))
    root = whole.tops.first()
    # a name of its own for the column: tops of one round are the very nodes they are grouped with
    top = whole.tops.select(F.concat("tree", F.lit("")).alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("path"), F.lit(b"").alias("subroot"))
    paths = whole.down(top, _path_task, PATH)
    # the path of a subroot belongs to the top of its source
    above = paths.join(whole.rounds[0].select("pos", "source", "digest"), "pos").select(
        F.concat("source", F.lit("")).alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
    done = trees.down(above, _fold_task, PROOF.format(id=id_type))
    return done.withColumn("root", F.lit(bytes(root["digest"]) if root else None).cast("binary"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: every row of ``docs`` proved against the root, half of them after tampering."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    without = leaf(*fields[:4], F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), "doc_id", leaf(*fields).alias("digest"),
                         F.when(tampered, without).alias("other"))
    found = manifest(leaves.withColumn("other", F.coalesce("other", "digest")))
    as_text = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", as_text("leaf").alias("leaf"), as_text("subroot").alias("subroot"), as_text("root").alias("root"), "proof_sha256",
                        as_text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def oracle() -> str:
    """The contract in SQL: trees, ways up and folds level by level."""
    def entered(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    head = " || ".join(entered(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
            lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::bigint) ELSE v >> 1 END))"""

    def climbed(name: str, base: str) -> str:
        return f"""{name} AS ({base}
        UNION ALL SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 3, n)"""

    def folded(name: str, base: str, nodes: str) -> str:
        return f"""{name} AS ({base}
        UNION ALL SELECT f.row_id, f.tree, f.lvl + 1, f.pos // 3, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.cur ELSE s.h END, '' ORDER BY s.pos)),
            f.proof || coalesce(string_agg(CASE WHEN s.pos <> f.pos THEN s.h END, '' ORDER BY s.pos), '')
        FROM {name} f JOIN {nodes} s ON s.tree = f.tree AND s.lvl = f.lvl AND s.pos // 3 = f.pos // 3 AND s.n > 1
        GROUP BY f.row_id, f.tree, f.lvl, f.pos, f.proof)"""

    return f"""WITH RECURSIVE hashed AS (
        SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({head} || {entered('text')}) AS leaf,
            CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN sha256({head} || {entered("replace(text, chr(10), '')")}) END AS other
        FROM documents),
    leaves AS (SELECT *, coalesce(other, leaf) AS start, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row_id,
            row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
    {climbed('nodes', 'SELECT tree, 0::bigint AS lvl, pos, n, leaf AS h FROM leaves')},
    subroots AS (SELECT tree AS source, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
    {climbed('tops', "SELECT '' AS tree, 0::bigint AS lvl, pos, n, h FROM subroots")},
    {folded('lower_way', "SELECT row_id, tree, 0::bigint AS lvl, pos, start AS cur, '' AS proof FROM leaves", 'nodes')},
    lower_end AS (SELECT row_id, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM lower_way GROUP BY row_id),
    {folded('upper_way', "SELECT e.row_id, '' AS tree, 0::bigint AS lvl, s.pos, e.cur, e.proof FROM lower_end e JOIN leaves USING (row_id) JOIN subroots s ON s.source = leaves.tree", 'tops')},
    upper_end AS (SELECT row_id, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM upper_way GROUP BY row_id)
    SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = t.h AS verified
    FROM leaves l JOIN upper_end e USING (row_id) JOIN subroots s ON s.source = l.tree, (SELECT h FROM tops WHERE n = 1) t"""

"""Merkle manifest against plain hashing, with awkward rows and trees of several rounds."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

from scriptorium.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, pos long, n long, path string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i:i + 3]) for i in range(0, len(last), 3)])
    return levels


def way(levels, at, digest):
    """Siblings of a node on its way up, and the top with ``digest`` in its place."""
    siblings = []
    for nodes in levels[:-1]:
        run = nodes[at // 3 * 3:at // 3 * 3 + 3]
        siblings += [h for j, h in enumerate(run) if j != at % 3]
        run[at % 3] = digest
        digest, at = H(*run), at // 3
    return siblings, digest


def brute(rows):
    by = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), leaf_of(r, r[1].replace("\n", "") if tampered else r[1]), r[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for at, (_, _, leaf, other, doc_id) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            below, subroot = way(trees[s], at, other)
            above, root = way(top, i, subroot)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], H(*below, *above), root, root == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows):
    got = merkle.report(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(rows)
    return got


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), "t", "d", 1, 2, "p")


def test_constants_are_those_of_the_standard():
    data = np.random.default_rng(5).integers(0, 1 << 32, (8, 7), dtype=np.uint64).astype(np.uint32)
    state = merkle.feed_hex(np.repeat(merkle.START[:, None], 7, 1), data)
    state = merkle.feed_hex(state, data[:, ::-1])
    for i, words in enumerate(merkle.close(state, np.full(7, 2)).T):
        hexes = [data[:, j].astype(">u4").tobytes().hex() for j in (i, 6 - i)]
        assert words.astype(">u4").tobytes().hex() == H(*hexes)


def test_awkward_rows_equal_plain_hashing(spark):
    texts = [None, "", "\n", "a\nb\n\n", "é😀\n", "x" * 300_000 + "\n" + "y" * 300_000, "plain"]
    rows = [row(i, t, s, l) for i, (t, s, l) in enumerate(
        (t, s, l) for t in texts for s in (None, "", "ü", "z", "=") for l in ("en", None))]
    rows += [row(None, "no id\n"), row(None, None, None, None), row(-5, "minus\n"), row(2 ** 62, "large\n", "lone")]
    rows += [row(7, "again\n")] * 4 + [row(7, "other\n")] * 2
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 10])
def test_small_trees(spark, n):
    check(spark, [row(i, f"t{i}\n") for i in range(n)])


def test_trees_of_several_rounds(spark):
    n = merkle.BLOCK + 500   # two rounds for the hot source
    rows = [row(i, f"t{i}\n", "hot" if i % 3 else f"s{i % 70}") for i in range(2 * n)]
    check(spark, rows)


def test_many_sources_are_a_tree_of_several_rounds(spark):
    check(spark, [row(i, "x\n", f"s{i}") for i in range(merkle.BLOCK + 30)])


def test_empty_table(spark):
    assert merkle.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_parents_keep_states_that_resume():
    """A fold takes the kept state before the slot: nothing to the left of it is hashed again."""
    digests = np.random.default_rng(2).integers(0, 1 << 32, (8, 3), dtype=np.uint64).astype(np.uint32)
    level = merkle.Level(digests, np.arange(3), np.ones(3, bool))
    records = level.records(np.array([2]))
    left = merkle.feed_hex(merkle.feed_hex(merkle.START[:, None], digests[:, :1]), digests[:, 1:2])
    assert (records[2:10] == left).all() and (merkle.fold(digests[:, 2:], records) == level.above).all()

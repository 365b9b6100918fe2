"""Topic models (M1–M4, W1, A4, A17): batch variational Bayes over tables.

Documents are packed, in the partitions they arrive in, into blocks of at most about
``BLOCK_TOKENS`` tokens, one row each: the block's terms, and per document its terms'
places and counts.  Texts are cut at white space in numpy; what a piece's term is,
the token expressions say once for each distinct piece of a block.  Terms are
numbered, and the topics' weights are a table with one row a range of numbers.  In
a pass, or each of its few rounds over parts of the blocks, a range sends each block the weights of the terms it asks for, as one
row of packed numbers; the block iterates its documents in numpy and sends expected
counts back the same way, which the range sums to the next weights.  Neither
the vocabulary nor the terms × topics table is ever in one place; the driver
holds one total a topic.  What a pass left on disk is given up before the next.

Settings are the reference's: symmetric priors 1/k, every pass over all
documents, at most 100 updates a document until the mean change falls below
0.001.  The weights start from a hash of term, topic and seed, and a document's
result depends on itself and the weights only, so topics do not depend on
partitions or block sizes beyond the rounding of sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import fixed_values as fv
from scriptorium.functions.text import topic_tokens, vectorizer_terms
from scriptorium.operators.indexing import consecutive_index
from scriptorium.session import give_up_unused, materialize, short_lived_shuffles, widen

BLOCK_TOKENS = 2_500_000
SLICE_BYTES = 2 << 20    # of texts cut into pieces at a time
SLICE_TERMS = 200_000    # terms of documents updated between two sums
RANGE_TERMS = 1_000_000  # terms that blocks ask of a range of the weights, about
ROUND_TERMS, ROUNDS = 8_000_000, 4   # terms that blocks ask for in one round of a pass, about; rounds at most
SIDE_BY_SIDE = 32768   # places of terms that a task updates at a time: what the processor's cache holds
DOC_UPDATES, DOC_CHANGE = 100, 1e-3   # updates of a document's topics at most; stop below this mean change


# --- special functions, over Spark columns and arrays alike ----------------------

def digamma(x, log):
    """Of x > 0, by six steps up and the asymptotic series."""
    y = x + 6
    z = 1 / (y * y)
    steps = 1 / x + 1 / (x + 1) + 1 / (x + 2) + 1 / (x + 3) + 1 / (x + 4) + 1 / (x + 5)
    return log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - steps


def log_gamma(x, log):
    """Of x > 0, likewise."""
    y = x + 6
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    steps = log(x) + log(x + 1) + log(x + 2) + log(x + 3) + log(x + 4) + log(x + 5)
    return (y - 0.5) * log(y) - y + float(np.log(2 * np.pi) / 2) + series - steps


# --- documents in blocks ------------------------------------------------------------

PIECES = "block long, ids array<{id}>, sizes binary, codes binary, pieces array<string>"
PACKED = "block long, n_docs int, n_terms int, lengths binary, slot binary, n binary, ids array<{id}>, terms array<string>, counts array<long>"


@dataclass
class TopicFit:
    k: int
    weights: DataFrame   # term, l0 .. of every topic
    totals: list[float]  # of the weights, by topic
    shares: DataFrame    # id, shares: of every document under the last weights
    bounds: list[float] = field(default_factory=list)   # of the likelihood before each pass, where asked for


def prepare_corpus(docs: DataFrame, id_col: str, text_col: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of documents: ``ids``, and of each document the codes of its pieces; ``terms`` has a code's counted token or null."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # to count the partitions of a plan that shuffles would run it; those shuffles spread it already
    if "Adaptive" not in docs._jdf.queryExecution().executedPlan().nodeName():
        docs = widen(docs)
    cut = docs.mapInArrow(_cut_blocks(block_tokens), PIECES.format(id=docs.schema["id"].dataType.simpleString()))
    term = F.transform("pieces", lambda piece: F.get(vectorizer_terms(topic_tokens(piece)), F.lit(0)))
    return cut.select("block", "ids", "sizes", "codes", term.alias("terms"))


def _kind(byte: int) -> int:
    """0: ASCII punctuation and the like; 1: white space; 2: letters, digits and all beyond ASCII."""
    return 1 if byte in b"\t\n\x0b\f\r " else 2 if byte >= 128 or chr(byte).isalnum() else 0


_KINDS, _LOWER = bytes(map(_kind, range(256))), bytes(range(256)).lower()


def cut_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many pieces each text has, and all of them: what is between white space (``\\s`` of the token expressions),
    without ASCII punctuation at its ends (a token loses it anyway; beyond ASCII nothing is cut here), A to Z made small."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = bytes(memoryview(texts.buffers()[2] or b"")[ends[0]:ends[-1]])
    ends, kinds = (ends - ends[0]).astype(np.int64), np.frombuffer(raw.translate(_KINDS), np.uint8)
    space = np.flatnonzero(kinds == 1)
    start = np.sort(np.concatenate([ends[:-1], space + 1]), kind="stable")
    stop = np.sort(np.concatenate([space, ends[1:]]), kind="stable")
    _move_to_letters(kinds == 2, start, stop)
    some = start < stop
    kept = np.append(0, np.cumsum(some))[np.append(0, np.cumsum(np.diff(np.searchsorted(space, ends)) + 1))]
    start, stop = start[some], stop[some]
    step = np.zeros(len(raw) + 1, np.int8)
    step[start] += 1
    step[stop] -= 1
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    offsets = np.append(0, np.cumsum(stop - start)).astype(np.int32)
    return np.diff(kept), pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))


def _move_to_letters(letter: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
    """Leaves other bytes at both ends of pieces behind; a few steps for most, a search for the rest."""
    for at, last, step in ((start, stop, 1), (stop, start, -1)):
        moving = np.flatnonzero(start < stop)
        for _ in range(4):
            moving = moving[~letter[at[moving] - (step < 0)]]
            at[moving] += step
            moving = moving[at[moving] != last[moving]]
        moving = moving[~letter[at[moving] - (step < 0)]]
        if len(moving):
            letters = np.flatnonzero(letter)
            if step > 0:
                found = np.append(letters, len(letter))[np.searchsorted(letters, at[moving])]
                at[moving] = np.minimum(found, last[moving])
            else:
                found = np.append(letters, -1)[np.searchsorted(letters, at[moving]) - 1] + 1
                at[moving] = np.maximum(found, last[moving])


def _slices(batch: pa.RecordBatch):
    """Of about SLICE_BYTES of texts each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _cut_blocks(block_tokens: int):
    def task(batches):
        task_no, n_blocks, room, held = TaskContext.get().partitionId(), 0, block_tokens, []

        def block() -> pa.RecordBatch:
            nonlocal n_blocks, room, held
            coded = pa.chunked_array([p for _, _, p in held]).unify_dictionaries()
            pieces, ids = coded.chunk(0).dictionary, pa.concat_arrays([i for i, _, _ in held])
            row = {"block": pa.array([(task_no << 32) + n_blocks], pa.int64()),
                   "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                   "sizes": _squeezed(np.concatenate([s for _, s, _ in held])), "codes": _squeezed(np.concatenate([c.indices.to_numpy() for c in coded.chunks])),
                   "pieces": pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)}
            n_blocks, room, held = n_blocks + 1, block_tokens, []
            return pa.RecordBatch.from_pydict(row)

        for part in (x for batch in batches for x in _slices(batch)):
            sizes, pieces = cut_pieces(part["text"])
            upto, start = np.append(0, np.cumsum(sizes)), 0
            while start < len(sizes):
                taken = np.cumsum(sizes[start:] + 1)
                fit = int(np.searchsorted(taken, room, "right")) or (0 if held else 1)   # one too long is a block of its own
                if fit:
                    stop = start + fit
                    held.append((part["id"].slice(start, fit), sizes[start:stop], pieces.slice(upto[start], upto[stop] - upto[start]).dictionary_encode()))
                    room -= int(taken[fit - 1])
                    start = stop
                if start < len(sizes):
                    yield block()
        if held:
            yield block()
    return task


def _squeezed(numbers: np.ndarray) -> pa.Array:
    """One binary value: numbers in the fewest bytes that hold them, compressed."""
    most = int(numbers.max(initial=0))
    kind = next(t for t in (np.uint8, np.uint16, np.int32, np.int64) if most <= np.iinfo(t).max)
    raw = numbers.astype(kind).tobytes()
    return pa.array([np.array([np.dtype(kind).itemsize, len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)], pa.binary())


def _spread(value: bytes) -> np.ndarray:
    width, size = np.frombuffer(value, np.int64, 2)
    kind = {1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.int64}[int(width)]
    return np.frombuffer(pa.decompress(memoryview(value)[16:], int(size), "zstd"), kind)


def _pack(batches):
    for batch in batches:
        for i in range(len(batch)):
            yield _packed(batch.slice(i, 1))


def _packed(row: pa.RecordBatch) -> pa.RecordBatch:
    coded = row["terms"].flatten().dictionary_encode()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(names) + 1, np.int64)
    place[order], place[-1] = np.arange(len(names)), -1
    slot = place[pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False)][_spread(row["codes"][0].as_py())]
    sizes = _spread(row["sizes"][0].as_py())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    keys, n = np.unique((doc * len(names) + slot)[slot >= 0], return_counts=True)
    doc, slot = np.divmod(keys, max(1, len(names)))
    listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_pydict({
        "block": row["block"], "n_docs": pa.array([len(sizes)], pa.int32()), "n_terms": pa.array([len(names)], pa.int32()),
        "lengths": _squeezed(np.bincount(doc, minlength=len(sizes))), "slot": _squeezed(slot), "n": _squeezed(n), "ids": row["ids"],
        "terms": listed(names.take(pa.array(order))), "counts": listed(pa.array(np.bincount(slot, n, len(names)).astype(np.int64)))})


def _n_tasks(spark) -> int:
    """Few bytes are much work here, so the number of tasks is stated and not left to their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def pack_documents(corpus: DataFrame) -> DataFrame:
    """Blocks of documents with their terms counted, written once."""
    return materialize(corpus.mapInArrow(_pack, PACKED.format(id=corpus.schema["ids"].dataType.elementType.simpleString())))


def vocabulary(blocks: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """M1: ``term, n`` of every term, like the reference's vectorizer; with
    ``vocab_size`` only that many of the most frequent ones (ties by term)."""
    terms = (blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
             .groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n")))
    return terms if vocab_size is None else terms.orderBy(F.desc("n"), "term").limit(vocab_size)


# --- one pass ---------------------------------------------------------------------------

def update_documents(doc: np.ndarray, n: np.ndarray, beta: np.ndarray, n_docs: int, updates: int, change: float):
    """Topic weights of documents and what they were left with; a row a topic throughout.

    ``doc``, ``n`` and ``beta`` (exp of the expected log weights) are by
    document and term, in the order of the documents.  Returns the weights (gamma)
    and, by document and term, exp(expected log share) of the document times beta, and its sum.
    """
    k = len(beta)
    alpha = 1.0 / k
    gamma = np.repeat(alpha + np.bincount(doc, n, n_docs)[None, :] / k, k, 0)
    lengths = np.bincount(doc, minlength=n_docs)
    firsts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    # documents of like length side by side, a few at a time (shorter ones filled up with a term of no count)
    padded, counts = np.concatenate([beta, np.ones((k, 1))], 1), np.append(n, 0.0)
    upto = 0
    while upto < len(order):
        fits = np.arange(1, min(len(order) - upto, SIDE_BY_SIDE) + 1) * lengths[order[upto:upto + SIDE_BY_SIDE]] <= SIDE_BY_SIDE
        own = order[upto:upto + max(1, int(fits.sum()))]
        upto += len(own)
        line = np.arange(lengths[own[-1]])
        place = np.where(line < lengths[own, None], firsts[own, None] + line, len(n))
        _settle(gamma, own, counts[place], np.ascontiguousarray(padded[:, place].swapaxes(0, 1)), updates, change)
    share = _shares(gamma)
    parts = np.stack([np.take(share[j], doc) * beta[j] for j in range(k)])
    return gamma, parts, parts.sum(0)


def _settle(gamma: np.ndarray, own: np.ndarray, count: np.ndarray, weight: np.ndarray, updates: int, change: float) -> None:
    """Updates gamma of documents ``own``; ``count`` is by document and term's place, ``weight`` by document, topic and place."""
    alpha = 1.0 / len(gamma)
    now, moving = np.ascontiguousarray(gamma[:, own].T), np.ones(len(own), bool)
    for _ in range(updates):
        share = exp_digamma(now)   # a document's total cancels out
        ratio = count / (np.matmul(share[:, None, :], weight)[:, 0] + 1e-100)
        new = alpha + share * np.matmul(weight, ratio[:, :, None])[:, :, 0]
        still = np.abs(new - now).mean(1) >= change
        now = np.where(moving[:, None], new, now)
        moving &= still
        if not moving.any():
            break
        if moving.mean() < 0.9:   # leave the settled ones behind, not at every update
            gamma[:, own] = now.T
            own, now, count, weight = own[moving], now[moving], count[moving], weight[moving]
            moving = np.ones(len(own), bool)
    gamma[:, own] = now.T


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)), the six steps put together in pairs."""
    y = x + 6
    z = 1 / (y * y)
    s = x * (x + 5)
    steps = (2 * x + 5) * ((3 * s + 20) * s + 24) / (s * (s + 4) * (s + 6))
    return y * np.exp(-0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - steps)


def _shares(gamma: np.ndarray) -> np.ndarray:
    return np.exp(digamma(gamma, np.log) - digamma(gamma.sum(0), np.log))


def _each_slice(block: dict, messages: pa.Table, k: int, updates: int, change: float):
    """Documents slice by slice: their first and last place, place and count of their terms that have weights, and what they were updated to."""
    lengths, slot, n = (_spread(block[c]) for c in ("lengths", "slot", "n"))
    beta = np.full((block["n_terms"], k), np.nan)
    beta[_joined(messages["slot"], np.int32)] = _joined(messages["w"], np.float64).reshape(-1, k)
    upto, start = np.append(0, np.cumsum(lengths, dtype=np.int64)), 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + SLICE_TERMS, "right")) - 1)
        doc = np.repeat(np.arange(stop - start), lengths[start:stop])
        own, count = slot[upto[start]:upto[stop]], n[upto[start]:upto[stop]].astype(np.float64)
        weight = beta[own]
        known = ~np.isnan(weight[:, 0])
        if not known.all():
            doc, own, count, weight = doc[known], own[known], count[known], weight[known]
        yield own, count, *update_documents(doc, count, np.ascontiguousarray(weight.T), stop - start, updates, change)
        start = stop


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _cells(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each run of ``sizes`` rows."""
    offsets = np.append(0, np.cumsum(sizes)) * (rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1))
    kind, offsets = (pa.binary(), offsets.astype(np.int32)) if offsets[-1] < 1 << 31 else (pa.large_binary(), offsets)
    values = pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])
    return values if kind == pa.binary() else pa.chunked_array([values.slice(i, 1).cast(pa.binary()) for i in range(len(values))])


COUNTED = "range int, at binary, s binary"


def _pass_task(k: int, updates: int, change: float):
    """Expected counts for each range of terms, and the documents' part of the bound for range -1."""
    def task(packed: pa.Table, messages: pa.Table) -> pa.Table:
        block = packed.to_pylist()[0]
        alpha, bound, stats = 1.0 / k, 0.0, np.zeros((k, block["n_terms"]))
        for own, n, gamma, parts, norm in _each_slice(block, messages, k, updates, change):
            parts *= n / (norm + 1e-100)
            for j in range(k):
                stats[j] += np.bincount(own, parts[j], block["n_terms"])
            left = np.log(_shares(gamma))
            bound += (n * np.log(norm + 1e-100)).sum() + ((alpha - gamma) * left + log_gamma(gamma, np.log) - log_gamma(alpha, np.log)).sum() \
                + (log_gamma(k * alpha, np.log) - log_gamma(gamma.sum(0), np.log)).sum()
        slot = _joined(messages["slot"], np.int32)
        sizes = np.array([len(x) // 4 for x in messages["slot"].to_pylist()], np.int64)
        back = pa.table({"range": messages["range"], "at": messages["at"], "s": _cells(stats.T[slot], sizes)})
        return pa.concat_tables([back, pa.table({"range": pa.array([-1], pa.int32()), "at": pa.array([b""], pa.binary()),
                                                 "s": pa.array([np.float64(bound).tobytes()], pa.binary())})])
    return task


def _shares_task(k: int, updates: int, change: float):
    def task(packed: pa.Table, messages: pa.Table) -> pa.Table:
        block = packed.drop_columns("ids").to_pylist()[0]
        gamma = np.concatenate([x[2] for x in _each_slice(block, messages, k, updates, change)], 1)
        shares = np.ascontiguousarray((gamma / gamma.sum(0)).T).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(shares) + 1, k, dtype=np.int32)), pa.array(shares))
        return pa.table({"id": packed["ids"].combine_chunks().flatten(), "shares": lists})
    return task


def expected_logs(weights: DataFrame, totals: list[float]) -> DataFrame:
    """``id, e0 ..``: expected logarithms of the terms' probabilities."""
    logs = [(digamma(F.col(f"l{j}"), F.log) - t).alias(f"e{j}") for j, t in enumerate(_log_totals(totals))]
    return weights.select("id", *logs)


def _log_totals(totals: list[float]) -> list[float]:
    return [float(digamma(np.float64(t), np.log)) if t else 0.0 for t in totals]   # 0: no term at all


# --- weights by range of the terms' numbers ------------------------------------------------

def _weights_schema(k: int) -> str:
    return "range int, w binary, " + ", ".join(f"t{j} double" for j in range(k))


def _weights_row(number: int, weights: np.ndarray) -> pa.Table:
    """A range's weights, a row a term, and their sums."""
    return pa.table({"range": pa.array([number], pa.int32()), "w": pa.array([weights.tobytes()], pa.binary())}
                    | {f"t{j}": [float(t)] for j, t in enumerate(weights.sum(0))})


def _first_weights(terms: DataFrame, k: int, seed: int, width: int) -> DataFrame:
    def task(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        return _weights_row(rows["range"][0].as_py(), np.stack([rows[f"l{j}"].to_numpy() for j in range(k)], 1))

    start = terms.select("id", F.expr(f"cast(id div {width} as int)").alias("range"), *[start_weight(F.col("term"), j, seed).alias(f"l{j}") for j in range(k)])
    return materialize(start.groupBy("range").applyInArrow(task, _weights_schema(k)))


def _once_a_term(counts: DataFrame, k: int) -> DataFrame:
    """Counts of a round, added up: a row a range."""
    def task(rows: pa.Table) -> pa.Table:
        at, s = _joined(rows["at"], np.int32), _joined(rows["s"], np.float64)
        if rows["range"][0].as_py() < 0:
            own, s = at, np.array([s.sum()])
        else:
            own, s = np.unique(at).astype(np.int32), s.reshape(-1, k)
            s = np.stack([np.bincount(at, s[:, j])[own] for j in range(k)], 1)
        return pa.table({"range": rows["range"][:1], "at": pa.array([own.tobytes()], pa.binary()), "s": pa.array([s.tobytes()], pa.binary())})
    return materialize(counts.groupBy("range").applyInArrow(task, COUNTED))


def _summed(counts: DataFrame, k: int) -> DataFrame:
    """The next weights: every term of a range was asked for, so each has counts."""
    def task(rows: pa.Table) -> pa.Table:
        number = rows["range"][0].as_py()
        if number < 0:
            bound = np.array([_joined(rows["s"], np.float64).sum()] + [0.0] * (k - 1))
            return _weights_row(number, bound[None, :])
        at = _joined(rows["at"], np.int32)
        s = _joined(rows["s"], np.float64).reshape(-1, k)
        return _weights_row(number, 1.0 / k + np.stack([np.bincount(at, s[:, j]) for j in range(k)], 1))
    return materialize(counts.groupBy("range").applyInArrow(task, _weights_schema(k)))


def _by_term(weights: DataFrame, k: int, width: int) -> DataFrame:
    """``id, l0 ..``: a row a term."""
    def task(batches):
        for batch in batches:
            for number, packed in zip(batch["range"].to_pylist(), batch["w"].to_pylist()):
                rows = np.frombuffer(packed, np.float64).reshape(-1, k)
                yield pa.RecordBatch.from_pydict({"id": number * width + np.arange(len(rows))} | {f"l{j}": np.ascontiguousarray(rows[:, j]) for j in range(k)})
    return weights.select("range", "w").mapInArrow(task, "id long, " + ", ".join(f"l{j} double" for j in range(k)))


class _Passes:
    """What does not change from pass to pass: blocks by block, and by range of terms which of them each block asks for.

    Both stay in the partitions that a pass needs, so a pass moves weights and counts only; of
    many blocks in a few rounds, each with a part of the blocks, as what moves lies on disk meanwhile.
    """

    def __init__(self, blocks: DataFrame, terms: DataFrame, k: int, width: int, n_ranges: int, rounds: int):
        def task(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("id")
            number, at = np.divmod(rows["id"].to_numpy(), width)
            first = np.flatnonzero(np.diff(number, prepend=-1))
            sizes = np.diff(np.append(first, len(number)))
            return pa.table({"range": pa.array(number[first].astype(np.int32)), "of": pa.array(np.repeat(rows["of"].to_numpy()[:1], len(first))),
                             "at": _cells(at.astype(np.int32), sizes), "slot": _cells(rows["slot"].to_numpy(), sizes)})

        self.k, self.rounds = k, rounds
        asked = blocks.select(F.col("block").alias("of"), F.posexplode("terms").alias("slot", "term")).join(terms, "term").select("of", "slot", "id")
        asked = asked.groupBy("of").applyInArrow(task, "range int, of long, at binary, slot binary")
        self.asked = materialize(asked.repartition(n_ranges, "range"))
        give_up_unused(blocks.sparkSession)
        self.blocks = materialize(blocks.drop("terms", "counts").repartition(_n_tasks(blocks.sparkSession), "block"))

    def cells(self, weights: DataFrame, totals: list[float], part: int, ids: bool = False):
        """Blocks of a round with the weights of their own terms."""
        k, of_total = self.k, np.array(_log_totals(totals))

        def task(asked: pa.Table, weights: pa.Table) -> pa.Table:
            sent = np.exp(digamma(np.frombuffer(weights["w"][0].as_py(), np.float64).reshape(-1, k), np.log) - of_total)
            sizes = np.array([len(x) // 4 for x in asked["at"].to_pylist()], np.int64)
            return asked.append_column("w", _cells(sent[_joined(asked["at"], np.int32)], sizes))

        def own(table: DataFrame, block: str) -> DataFrame:
            return table if self.rounds == 1 else table.where(F.pmod(F.xxhash64(block), F.lit(self.rounds)) == part)

        sent = own(self.asked, "of").groupBy("range").cogroup(weights.select("range", "w").groupBy("range"))
        sent = sent.applyInArrow(task, "range int, of long, at binary, slot binary, w binary")
        return own(self.blocks if ids else self.blocks.drop("ids"), "block").groupBy("block").cogroup(sent.groupBy("of"))


def start_weight(term: Column, topic: int, seed: int) -> Column:
    """From 0.5 to 1.5, by a digest of seed, topic and term."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{topic}:"), term))
    return 0.5 + F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0 ** 32


def _totals(weights: DataFrame, k: int) -> list[float]:
    return [float(t or 0) for t in weights.agg(*[F.sum(f"t{j}") for j in range(k)]).first()]


def _terms_bound(weights: DataFrame, totals: list[float], k: int) -> float:
    """The weights' part of the bound."""
    eta = 1.0 / k
    own = [(eta - F.col(f"l{j}")) * F.col(f"e{j}") + log_gamma(F.col(f"l{j}"), F.log) - float(log_gamma(np.float64(eta), np.log)) for j in range(k)]
    both = weights.join(expected_logs(weights, totals), "id")
    n, value = both.agg(F.count(F.lit(1)), F.sum(sum(own))).first()
    return value + sum(float(log_gamma(np.float64(n * eta), np.log) - log_gamma(np.float64(t), np.log)) for t in totals)


def fit_topics(docs: DataFrame, id_col: str, text_col: str, k: int = fv.N_TOPICS, max_iter: int = 10,
               seed: int = fv.SEED, vocab_size: int | None = None, block_tokens: int = BLOCK_TOKENS,
               doc_updates: int = DOC_UPDATES, doc_change: float = DOC_CHANGE, track_bound: bool = False) -> TopicFit:
    """M1 + M2.  Repeated ids are documents of their own, null and empty texts
    documents without terms; without any term there are no weights and shares are even."""
    spark = docs.sparkSession
    with short_lived_shuffles(spark):
        blocks = pack_documents(prepare_corpus(docs, id_col, text_col, block_tokens))
        # numbers stand for terms while weights and counts move
        terms = consecutive_index(vocabulary(blocks, vocab_size).select("term"), ["term"], out="id")
        terms = materialize(terms.select("id", "term"))
        give_up_unused(spark)
        asked = blocks.agg(F.sum(F.size("terms"))).first()[0] or 0
        n_ranges = max(asked // RANGE_TERMS, spark.sparkContext.defaultParallelism)
        width = terms.count() // n_ranges + 1
        weights, bounds = _first_weights(terms, k, seed, width), []
        totals = _totals(weights, k)
        rounds = range(min(ROUNDS, asked // ROUND_TERMS + 1))
        passes, id_type = _Passes(blocks, terms, k, width, n_ranges, len(rounds)), corpus_id_type(blocks)
        del blocks
        for _ in range(max_iter if totals[0] else 0):
            give_up_unused(spark)
            counts = [passes.cells(weights, totals, i).applyInArrow(_pass_task(k, doc_updates, doc_change), COUNTED) for i in rounds]
            summed = _summed(counts[0] if len(rounds) == 1 else reduce(DataFrame.unionAll, [_once_a_term(c, k) for c in counts]), k)
            if track_bound:
                bounds.append(_terms_bound(_by_term(weights, k, width), totals, k) + summed.where("range = -1").first()["t0"])
            weights = summed.where("range >= 0")
            totals = _totals(weights, k)
            del counts, summed
        give_up_unused(spark)
        shares = reduce(DataFrame.unionAll, [materialize(passes.cells(weights, totals, i, ids=True).applyInArrow(
            _shares_task(k, doc_updates, doc_change), f"id {id_type}, shares array<double>")) for i in rounds])
        named = _by_term(weights, k, width).join(terms, "id").select("term", *[f"l{j}" for j in range(k)])
        del passes, weights, terms
        give_up_unused(spark)
        return TopicFit(k, named, totals, shares, bounds)


def corpus_id_type(blocks: DataFrame) -> str:
    return blocks.schema["ids"].dataType.elementType.simpleString()


def topic_shares(fit: TopicFit) -> DataFrame:
    """M3: ``id, shares`` (array<double>).  A document without terms gets the uniform mixture 1/k."""
    return fit.shares


def top_words(fit: TopicFit, n: int = fv.TOP_WORDS) -> DataFrame:
    """Per topic, the ``n`` strongest terms ordered weakest → strongest.

    Each task keeps its ``n`` strongest a topic before any row moves."""
    by_topic = F.posexplode(F.array(*[F.col(f"l{j}") for j in range(fit.k)])).alias("topic", "weight")
    strongest = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    top = (fit.weights.select("term", by_topic).withColumn("rank", F.row_number().over(strongest) - 1).where(F.col("rank") < n))
    return folded_words(top)


def named_words(top: DataFrame, terms: DataFrame) -> DataFrame:
    """``topic, Top_Words`` from the few (topic, rank, idx), rank 0 the
    strongest, and the vocabulary table (idx, term)."""
    return folded_words(terms.join(F.broadcast(top), "idx"))


def folded_words(named: DataFrame) -> DataFrame:
    return named.groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("rank"), F.col("term")))),
                                 lambda x: x["term"]), ", ").alias("Top_Words"))


def topic_table(fit: TopicFit, n_words: int = fv.TOP_WORDS) -> DataFrame:
    """M4 = A4 ⋈ W1 ⋈ P15: ``Topic, Frequency, Top_Words``."""
    return labelled_topics(mean_shares(topic_shares(fit)), top_words(fit, n_words))


def mean_shares(shares: DataFrame) -> DataFrame:
    """A4: ``topic, Frequency``, the mean share of each topic."""
    return (shares.select(F.posexplode("shares").alias("topic", "share"))
            .groupBy("topic").agg(F.avg("share").alias("Frequency")))


def labelled_topics(freq: DataFrame, words: DataFrame) -> DataFrame:
    """M4: ``Topic, Frequency, Top_Words`` with topics counted from one."""
    return (freq.join(words, "topic")
            .select(F.format_string("Topic %d", F.col("topic") + 1).alias("Topic"), "Frequency", "Top_Words")
            .orderBy("Topic"))


def topics_by_period(fit: TopicFit, periods: DataFrame, period_col: str) -> DataFrame:
    """Mean topic share per period (``periods``: id, period)."""
    return shares_by_period(topic_shares(fit), periods, period_col)


def shares_by_period(shares: DataFrame, periods: DataFrame, period_col: str) -> DataFrame:
    """A17 from ``id, shares``."""
    met = shares.join(periods.select(F.col("id"), F.col(period_col)), "id")
    per = (met.select(period_col, F.posexplode("shares").alias("topic", "share"))
           .groupBy(period_col, "topic").agg(F.avg("share").alias("Frequency"),
                                            F.count(F.lit(1)).alias("n_docs")))
    return per.select(period_col, F.format_string("Topic %d", F.col("topic") + 1).alias("Topic"),
                      "Frequency", "n_docs")

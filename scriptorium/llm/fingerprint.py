"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words; a term weighs its count times the square of its
length less one (at least 1), so that frequent short words count little.  In a
draw a term has two gamma(2, 1) numbers r and c and a uniform one b, all from
its hash: with weight w, t = floor(ln(w) / r + b) and
ln a = ln c - r (t + 1 - b).  The term with the least a is picked; two texts pick
the same (term, t) with probability equal to their generalised Jaccard
similarity.  The least a itself stands for the pick, since it depends on nothing
else; sixteen bits of its hash make four digits of the fingerprint.

Every term takes part in all ``DRAWS`` draws.  They are made ``GROUP`` at a time:
a row holds a term and one group of draws, whose least values are as many
aggregates side by side, so that the aggregation looks up one key for all of them
and no array is built a term.  Texts that are fingerprinted together, as a text
and its edited form, share the row of a term: its numbers r, b and c do not
depend on the weight and are made once for all of them.

Plan of ``against_next``: documents go by blocks of adjacent ids to the tasks,
once; each block also gets the first document of the next block, so that
every document meets its successor inside its block.  All that follows
(windows, counting and sampling by hash aggregation)
keeps that distribution, so the texts are shuffled once and nothing else is.
The only broadcast is one row per block, of which there are at most ``MAX_BLOCKS``
by the choice of the blocks' width.

Cases: a null text is an empty one; texts without words have one fixed
fingerprint; texts are sampled whole at any length (word lengths above 63 count
as 63); null ids come before all others; equal ids are ordered by text and equal
rows are documents of their own, all of one id in one task; an empty table
gives an empty table; only the named columns are read, so extra columns cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import common
from scriptorium.operators.indexing import consecutive_index

#: Draws a text, and how many of them one row makes.
DRAWS, GROUP = 64, 16
BLOCK_IDS = 256
MAX_BLOCKS = 1_000_000


def log_weight(h: Column, n: Column) -> Column:
    """Logarithm of a term's weight: count times squared length less one."""
    length = F.greatest(h.bitwiseAND(F.lit(63)) - 1, F.lit(1).cast("long"))
    return F.ln(n * length * length)


def _uniform(bits: Column, shift: int, width: int) -> Column:
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) / F.lit(float(1 << width))


def log_a(x: Column, lnw: Column) -> Column:
    """ln a of a term in one draw, ``x`` its hash there."""
    y = F.xxhash64(x)
    r = -F.ln(_uniform(x, 4, 20) * _uniform(x, 24, 20))
    b = _uniform(x, 44, 20)
    c = -F.ln(_uniform(y, 0, 32) * _uniform(y, 32, 32))
    return F.ln(c) - r * (F.floor(lnw / r + b) + 1 - b)


def render(code: Column) -> Column:
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of draws with equal picks."""
    equal = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda s, x: s + x) / F.size(a)


def term(word: Column) -> Column:
    """58 bits of the word's hash and, below, its length up to 63."""
    return F.xxhash64(word).bitwiseAND(F.lit(-64)).bitwiseOR(F.least(F.length(word), F.lit(63)).cast("long"))


def draw(df: DataFrame, keys: list[str], texts: list[str], carry: list[str]) -> DataFrame:
    """Rows (keys, carry as long, codes0, codes1 ...): the digits of several texts a row, zeros for a text without words.

    ``keys`` name a row.  Where ``df`` is distributed by one of them, no row
    moves.  The carried values travel as rows of their own beside the terms,
    numbered behind the groups of draws.
    """
    marks, groups = range(len(texts)), DRAWS // GROUP
    side = "array<struct<k:int,words:array<string>,g:int,v:bigint>>"
    none = F.lit(None)
    own = [F.struct(none.alias("k"), F.array(none).alias("words"), F.lit(groups + j).alias("g"), F.col(c).cast("long").alias("v")) for j, c in enumerate(carry)]
    held = [F.struct(F.lit(i).alias("k"), common.word_list(F.col(t)).alias("words"), none.alias("g"), none.alias("v")) for i, t in enumerate(texts)]
    sides = df.select(*keys, F.inline(F.concat(*[F.array(x).cast(side) for x in [*held, *own]])))
    words = sides.select(*keys, "k", "g", "v", F.explode("words").alias("word")).select(*keys, "k", "g", "v", F.when(F.col("k").isNotNull(), term(F.col("word"))).alias("h"))
    counted = words.groupBy(*keys, "g", "h").agg(*[F.sum(F.when(F.col("k") == i, 1)).alias(f"n{i}") for i in marks], F.min("v").alias("v"))
    part = F.when(F.col("g").isNull(), F.array(*[F.lit(g) for g in range(groups)])).otherwise(F.array("g"))
    weighed = counted.select(*keys, "h", "v", *[log_weight(F.col("h"), F.col(f"n{i}")).alias(f"lnw{i}") for i in marks], F.explode(part).alias("g"))
    least = [F.min(log_a(F.xxhash64("h", F.col("g") * GROUP + j), F.col(f"lnw{i}"))).alias(f"a{i}_{j}") for i in marks for j in range(GROUP)]
    picks = weighed.groupBy(*keys, "g").agg(*least, F.min("v").alias("v"))
    digit = lambda a: F.when(F.col(a).isNull(), 0).otherwise(F.xxhash64(a).bitwiseAND(F.lit(0xFFFF)).cast("int"))
    codes = [F.array(*[digit(f"a{i}_{j}") for j in range(GROUP)]).alias(f"codes{i}") for i in marks]
    found = picks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("g", "v", *codes))).alias("found"))
    drawn = F.filter("found", lambda e: e["g"] < groups)
    marked = F.filter("found", lambda e: e["g"] >= groups)
    both = found.select(*keys, drawn.alias("drawn"), marked.alias("marked"))
    digits = lambda i: F.flatten(F.transform("drawn", lambda e: e[f"codes{i}"]))
    whole = [F.when(F.size("drawn") > 0, digits(i)).otherwise(F.array_repeat(F.lit(0), DRAWS)) for i in marks]
    return both.select(*keys, *[F.get("marked", F.lit(j))["v"].alias(c) for j, c in enumerate(carry)], *[x.alias(f"codes{i}") for i, x in enumerate(whole)])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id (long) and fingerprint."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return draw(rows, ["row"], ["text"], ["doc_id"]).select("doc_id", render(F.col("codes0")).alias("fingerprint"))


def in_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, halo, ord, doc_id, text): each document in its block, and the next block's first as halo."""
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = base.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = (span["lo"] or 0, span["hi"] or 0)
    width = max(BLOCK_IDS, -(-(hi - lo + 2) // MAX_BLOCKS))
    order = F.coalesce(F.col("doc_id"), F.lit(lo - 1))
    block = F.expr(f"(coalesce(doc_id, {lo - 1}) - {lo - 1}) div {width}")
    first = base.select(order.alias("ord"), block.alias("block")).groupBy("block").agg(F.min("ord").alias("ord"))
    chain = common.checkpointed(consecutive_index(first, ["block"], "at", 8).select("block", "ord", "at"))
    n = max(chain.count(), 1)
    before = chain.select(F.col("block").alias("halo_block"), F.pmod(F.col("at") + 1, F.lit(n)).alias("at"))
    heads = chain.join(before, "at").select(F.col("ord").alias("head"), "halo_block")
    placed = base.withColumn("ord", order).withColumn("own", block).join(F.broadcast(heads), F.col("ord") == F.col("head"), "left")
    seats = F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("halo")), F.struct(F.col("halo_block").alias("block"), F.lit(True).alias("halo")))
    return placed.select("ord", "doc_id", "text", F.inline(F.filter(seats, lambda s: s["block"].isNotNull())))


def against_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited form, whose second half gives way to the next text's start.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The next document is that of the next id; after
    the last comes the first.
    """
    seat = Window.partitionBy("block").orderBy("halo", "ord", "text")
    met = in_blocks(df, id_col, text_col).select(
        "block", "halo", "doc_id", "text", F.row_number().over(seat).alias("pos"), F.coalesce(F.lead("text").over(seat), F.lit("")).alias("next"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    both = met.select("block", "pos", "halo", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # the digest as four numbers, so that it is carried in fixed width
    digest = F.sha2("edited", 256)
    words = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(f"d{k}") for k in range(4)]
    drawn = draw(both.select("*", *words), ["block", "pos"], ["text", "edited"], ["halo", "doc_id", "n_chars", "d0", "d1", "d2", "d3"])
    beside = drawn.select("*", F.lead("codes0").over(Window.partitionBy("block").orderBy("pos")).alias("next_codes"))
    digits = F.concat(*[F.lpad(F.lower(F.hex(f"d{k}")), 16, "0") for k in range(4)])
    return beside.where(F.col("halo") == 0).select(
        "doc_id", "n_chars", digits.alias("edited_sha256"), render(F.col("codes0")).alias("fingerprint"), render(F.col("codes1")).alias("edited_fingerprint"),
        likeness(F.col("codes0"), F.col("codes1")).alias("near_edited"), likeness(F.col("codes0"), F.col("next_codes")).alias("near_next"))

"""Secret scans: fixed key patterns, and strings that a tokenizer cannot compress.

A text of a natural language needs few tokens of a byte-level vocabulary;
random strings need many.  Every run of key characters that is long enough is
therefore encoded with a tiktoken vocabulary, and runs with few characters per
token are reported, unless they are known digests (hexadecimal of a digest's
length), UUIDs or numbers.  A run that has enough characters a token as a whole is
measured again in the parts between its separators, so a readable name before a
random string hides nothing; of a run that touches a fixed pattern's span what lies
outside the span is measured.  Runs in the shape of names (parts of letters of one case or
camel case, with up to four digits) are judged by their letters alone: by all parts
of three or more letters together, and by each long part.

Runs in Arrow batches of the scan's own partitions: no shuffle, no state, and
the memory is that of one batch.

Cases: null and empty texts have no spans; a text of any length is scanned
whole; repeated rows are scanned each; an empty table gives an empty table.
The operators are column expressions, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.llm import common

#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "random")

#: Fixed patterns; those of ``hex`` and ``access`` say "long enough" at once, since a
#: run cut at its start is only shorter.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6

MIN_RUN = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: Letters of a name that say something at all, that are judged as a part of their own, and that are judged by the full ratio.
LETTERS, LONG_PART, FULL_RATIO = 12, 16, 20
#: Fewer letters spread more, so their ratio must be lower by this.
SHORT_FACTOR = 0.875
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_DIGITS = (32, 40, 56, 64, 96, 128)
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
NUMBER = re.compile(r"0x[0-9A-Fa-f]{1,16}")
NAME_PART = re.compile(r"\d+|[a-z]+\d{0,4}|[A-Z]+\d{0,4}|(?:[A-Z]?[a-z]{2,})+\d{0,4}")
PART_BREAK = re.compile(r"[+/_=-]+")
#: Separators at which a run that is not random as a whole is parted, one after the other.
BREAKS = (re.compile(r"=+"), re.compile(r"[_-]+"), re.compile(r"[+/]+"))

SPANS_TYPE = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_encoders: dict = {}


def encoder(path: str):
    """The tiktoken encoding of a ranks file, once per worker."""
    if path not in _encoders:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=common.tokenizer_pattern(), mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def known(run: str) -> bool:
    """A digest, a UUID or a number, which is no secret however random it looks."""
    if len(run) in DIGEST_DIGITS and HEX_ONLY.fullmatch(run) or UUID.fullmatch(run) or NUMBER.fullmatch(run):
        return True
    return all(p.isdigit() for p in PART_BREAK.split(run) if p)


def is_random(run: str, encoding, max_ratio: float) -> bool:
    """Whether a run has too few characters a token."""
    def tokens(x: str) -> int:
        return len(encoding.encode_ordinary(x))

    parts = [p for p in PART_BREAK.split(run) if p]
    if not all(NAME_PART.fullmatch(p) for p in parts):
        return len(run) < max_ratio * tokens(run)
    words = [w for w in (p.rstrip("0123456789") for p in parts) if len(w) > 2]
    # a word in capitals is as known as the same in small letters
    counts = [(len(w), min(tokens(w), tokens(w.lower())) if w.isupper() else tokens(w)) for w in words]
    judged = [(sum(n for n, _ in counts), sum(k for _, k in counts))] + [x for x in counts if x[0] >= LONG_PART]
    return any(n >= LETTERS and n < max_ratio * (1 if n >= FULL_RATIO else SHORT_FACTOR) * k for n, k in judged)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns as (start, kind number, end)."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def merged(found: list[tuple[int, int, int]]) -> list[list[int]]:
    """The stretches that spans cover, ascending and disjoint."""
    out: list[list[int]] = []
    for s, _, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def random_parts(run: str, encoding, max_ratio: float, breaks: tuple = BREAKS) -> list[tuple[int, int]]:
    """Places of random strings in a run: the run itself, or else what its separators part."""
    if len(run) < MIN_RUN or known(run):
        return []
    if is_random(run, encoding, max_ratio):
        return [(0, len(run))]
    if not breaks:
        return []
    out, at = [], 0
    for m in [*breaks[0].finditer(run), None]:
        end = m.start() if m else len(run)
        if end - at >= MIN_RUN:
            # a run without this separator goes on to the next one
            out += [(at + s, at + e) for s, e in random_parts(run[at:end], encoding, max_ratio, breaks[1:])]
        at = m.end() if m else end
    return out


def find(text: str | None, encoding, max_ratio: float) -> list[tuple[int, int, int]]:
    """All spans of one text as (start, kind number, end), in listing order."""
    if not text:
        return []
    out = base_spans(text)
    taken, at = merged(out), 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        # what base spans leave of the run
        free, k = [], at
        while k < len(taken) and taken[k][0] < end:
            free.append((start, taken[k][0]))
            start = taken[k][1]
            k += 1
        for s, e in [*free, (start, end)]:
            out += [(s + a, 3, s + b) for a, b in random_parts(text[s:e], encoding, max_ratio)]
    return sorted(out)


def spans(text: Column, ranks: str | None = None, max_ratio: float = 2.0) -> Column:
    """Secrets of a text as array<struct<kind, start, end>>, code points, end exclusive.

    ``ranks`` is the tiktoken vocabulary file, ``max_ratio`` the characters per
    token below which a string counts as random.
    """
    path = ranks or common.tokenizer_file("byte_bpe_50k.tiktoken")

    @F.arrow_udf(SPANS_TYPE)
    @common.batchwise
    def scan(texts: pa.Array) -> pa.Array:
        encoding = encoder(path)
        found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t.as_py(), encoding, max_ratio)] for t in texts]
        return pa.array(found, _ARROW_SPANS)

    return scan(text)


def render(spans_col: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str | None, found: list[tuple[int, int, int]], mask: str) -> str | None:
    """``text`` with each stretch covered by spans replaced by ``mask``."""
    if not found:
        return text
    at, parts = 0, []
    for s, e in merged(found):
        parts += (text[at:s], mask)
        at = e
    return "".join([*parts, text[at:]])


def masked(text: Column, mask: str = "[secret]", ranks: str | None = None, max_ratio: float = 2.0) -> Column:
    """The text without its secrets, found and replaced in one pass; null stays null."""
    path = ranks or common.tokenizer_file("byte_bpe_50k.tiktoken")

    @F.arrow_udf("string")
    @common.batchwise
    def cut(texts: pa.Array) -> pa.Array:
        encoding = encoder(path)
        out = []
        for t in texts:
            whole = t.as_py()
            out.append(redacted(whole, find(whole, encoding, max_ratio), mask))
        return pa.array(out, pa.string())

    return cut(text)


def report(df, id_col: str = "doc_id", text_col: str = "text", **options):
    """One row per document: counts by kind, digest of the base spans, all spans."""
    found = df.select(F.col(id_col).alias("doc_id"), spans(F.col(text_col), **options).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(render(F.filter("found", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        render(F.col("found")).alias("spans"), count("random").alias("n_random"))

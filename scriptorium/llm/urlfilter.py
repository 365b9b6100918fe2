"""URL filters: all glob rules at once by a bit-parallel automaton.

Every glob becomes a run of bits, one for each character matched so far.  A
batch of URLs is advanced one character at a time: the state words shift by
one (with carry from word to word), are masked by the character's mask, and
keep those bits whose next sign is a star that accepts the character.  All
patterns thus run together, and all URLs of a batch beside each other in
numpy.

A canonical URL is the host with a dot before it, a separator, then the path
and query.  In a glob ``*`` stands for any characters but the separator,
``**`` for any at all, ``?`` for one character, and ``^`` for the separator
between host and path.

Runs in Arrow batches of the scan's partitions, sorted by length within a
batch: no shuffle; the automaton's masks grow with the rules only.

Cases: a null URL or one without ``://`` has an empty host and path and fits no
rule (method's verdict: allow); long URLs are read whole; repeated rows are
judged each; an empty table gives an empty table; only the named columns are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"

#: Host, path and verdict of the fixed rules: each fits its host and all
#: subdomains where the path starts with the rule's; the longest rule wins.
BASE_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: The method's own globs, which block where no fixed rule fits.
BLOCK_GLOBS = (
    "*cheap-pills*^**", "*free-bets*^**", "*casino*^**", "*viagra*^**", "*porn*^**", "*xxx*^**", "*payday-loan*^**", "*replica-watch*^**",
    "*.ads.*^**", "*.adserver.*^**", "*.doubleclick.*^**", "*.tracker.*^**",
    "*^/wp-login*", "*^/wp-admin/*", "*^/cgi-bin/*", "*^**.exe", "*^**.zip", "*^**.apk",
)


class Automaton:
    """Globs as masks over words of 64 bits, read by ``run``."""

    def __init__(self, globs: list[str]):
        signs: list[tuple[str, str]] = []  # character before a state ("" at a glob's start), star after it
        self.last: list[int] = []
        for g in globs:
            signs.append(("", ""))
            i = 0
            while i < len(g):
                if g[i] == "*":
                    wide = g[i:i + 2] == "**"
                    signs[-1] = (signs[-1][0], "**" if wide or signs[-1][1] == "**" else "*")
                    i += 1 + wide
                else:
                    signs.append((SEPARATOR if g[i] == "^" else "any" if g[i] == "?" else g[i], ""))
                    i += 1
            self.last.append(len(signs) - 1)
        self.words = max(1, -(-len(signs) // 64))
        chars = sorted({c for c, _ in signs if len(c) == 1} | {SEPARATOR})
        self.code = {c: k + 1 for k, c in enumerate(chars)}  # 0: every other character

        def mask(states) -> list[int]:
            value = sum(1 << s for s in states)
            return [value >> 64 * w & (2**64 - 1) for w in range(self.words)]

        self.start = np.array(mask(k for k, (c, _) in enumerate(signs) if c == ""), np.uint64)
        self.move = np.array([mask(k for k, (s, _) in enumerate(signs) if s == c or s == "any") for c in ["", *chars]], np.uint64)
        self.move[0] &= np.array(mask(k for k, (s, _) in enumerate(signs) if s == "any"), np.uint64)
        self.stay = np.array([mask(k for k, (_, star) in enumerate(signs) if star == "**" or star == "*" and c != SEPARATOR) for c in ["", *chars]], np.uint64)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        table = np.zeros(128, np.uint8 if len(self.code) < 255 else np.uint16)
        for c, k in self.code.items():
            if ord(c) < 128:
                table[ord(c)] = k
        out = np.where(points < 128, table[np.minimum(points, 127)], 0)
        for c, k in self.code.items():
            if ord(c) >= 128:
                out[points == ord(c)] = k
        return out

    def run(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix of texts by globs: which globs match which whole text."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        coded = [self.codes(texts[i]) for i in order]
        state = np.repeat(self.start[None, :], len(texts), 0)
        live, one = len(texts), np.uint64(1)
        for p in range(len(coded[0]) if coded else 0):
            while len(coded[live - 1]) <= p:
                live -= 1
            now = np.array([c[p] for c in coded[:live]])
            d = state[:live]
            moved = d << one
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.move[now] | d & self.stay[now]
        out = np.zeros((len(texts), len(self.last)), bool)
        for k, s in enumerate(self.last):
            out[order, k] = (state[:, s // 64] >> np.uint64(s % 64) & one).astype(bool)
        return out


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """``.host`` without default port, the separator, then path and query without fragment."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    return F.concat(F.lit("."), F.translate(host, SEPARATOR, ""), F.lit(SEPARATOR), F.translate(path_of(url), SEPARATOR, ""), query)


def rule_globs(rules=BASE_RULES) -> list[str]:
    return [f"*.{host}^{path}**" for host, path, _ in rules]


def matches(canonical_url: Column, globs: list[str]) -> Column:
    """Numbers of the globs that match, ascending, as array<int>; null matches none."""

    @F.arrow_udf("array<int>")
    def run(urls: pa.Array) -> pa.Array:
        hit = automaton.run([u.as_py() or "" for u in urls])
        counts, found = hit.sum(1), np.nonzero(hit)[1]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found, pa.int32()))

    automaton = Automaton(globs)
    return run(canonical_url)


def report(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=BASE_RULES, block=BLOCK_GLOBS) -> DataFrame:
    """Host, path, winning rule (or null) and verdict of every URL."""
    names = [h + p for h, p, _ in rules]
    by_length = sorted(range(len(rules)), key=lambda k: -len(names[k]))
    url = F.col("url")
    base = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    cut = base.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    # the fixed rules are about the host as it stands, with its port, and the path alone
    plain = F.concat(F.lit("."), F.translate("host", SEPARATOR, ""), F.lit(SEPARATOR), F.translate("path", SEPARATOR, "\x1e"))
    hit = cut.select("page_id", "host", "path", matches(plain, rule_globs(rules)).alias("fixed"), matches(F.col("canonical"), list(block)).alias("own"))
    pick = lambda value: F.coalesce(*[F.when(F.array_contains("fixed", k), F.lit(value(k))) for k in by_length])
    return hit.select(
        "page_id", "host", "path", pick(lambda k: names[k]).alias("rule"),
        F.coalesce(pick(lambda k: rules[k][2]), F.when(F.size("own") > 0, F.lit("block")), F.lit("allow")).alias("verdict"))


def _sql_glob(glob: str) -> str:
    import re
    parts = re.split(r"(\*\*|\*|\^|\?)", glob)
    return "^" + "".join({"**": ".*", "*": r"[^\x1f]*", "^": r"\x1f", "?": "."}.get(p) or re.escape(p) for p in parts) + "$"


def oracle() -> str:
    """DuckDB SQL of ``report`` over ``pages``."""
    rules = sorted(BASE_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}'))"
    name = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules)
    own = " OR ".join(f"regexp_matches(canonical, '{_sql_glob(g)}', 's')" for g in BLOCK_GLOBS)
    return rf"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
        regexp_extract(u, '^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1, 's') AS query FROM a),
c AS (SELECT *, '.' || regexp_replace(host, ':(80|443)$', '') || chr(31) || path || coalesce(query, '') AS canonical FROM b)
SELECT page_id, host, path, CASE {name} END AS rule,
       CASE {verdict} WHEN {own} THEN 'block' ELSE 'allow' END AS verdict FROM c"""

"""Quality rules: a threshold table compiled into one projection.

The measures are built-in expressions over the text, its words and its lines;
the rules are rows of a table (measure, over, bounds, from how many words on)
that become one boolean expression each in a single select.  No user function,
no shuffle: each row is judged from its own text, so the plan is a scan with
projections at any size.

Words are maximal runs of characters other than blank and tab to carriage
return; lines are parted by line feeds.

Cases: null counts as an empty text (no words, fails the base rule); texts are
measured whole at any length; repeated rows are judged each; an empty table
gives an empty table; only the named id and text columns are read, so extra
columns cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be this by from or an at not have which "
    "der die das und den von zu mit sich des dem nicht ein eine als auch auf für ist im "
    "le la les et des en du une un que est pour dans qui par sur pas plus au avec "
    "el los las y que del se por con para una su al lo como más de a").split()


class Rule(NamedTuple):
    """Kept only if low <= measure / over <= high; judged from ``words`` words on."""
    name: str
    measure: str
    over: str | None
    low: float | None
    high: float | None
    words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("lettered_words", "n_lettered", "n_words", 0.6, None),
    Rule("stop_words", "n_stop", "n_words", 0.03, None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("line_length", "n_words", "n_lines", 1.5, None, 50),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more in ``words``.

    Windows are compared by a 64-bit hash of their words.  Texts without an
    equal pair end after one distinct; else windows are sorted by hash, those
    with an equal neighbour give their places, and the places' cover is summed.
    """
    def count(h: Column) -> Column:
        found = common.bound(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]).__or__(F.get(s, i + 1)["h"] == x["h"])), lambda x: x["i"])))
        return common.bound(found, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)]))

    return common.bound(words, lambda w: F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(
        common.bound(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(count(h)))))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measures that rules may name, all long."""
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = base.select("doc_id", "text", common.word_list(F.col("text")).alias("words"),
                      F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(common.WORD))).alias("lines"))
    size = lambda c: F.size(c).cast("long")
    return cut.select(
        "doc_id", size("words").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        size(F.filter("words", lambda w: F.rlike(w, F.lit(r"\p{L}")))).alias("n_lettered"),
        size(F.filter(F.transform("words", lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()")))), lambda w: w.isin(*STOP_WORDS))).alias("n_stop"))


def passes(rule: Rule) -> Column:
    """One rule as an expression over the measures; a share of nothing passes."""
    value = F.col(rule.measure).cast("double")
    if rule.over:
        value = F.try_divide(value, F.col(rule.over).cast("double"))
    tests = [value >= rule.low] if rule.low is not None else []
    tests += [value <= rule.high] if rule.high is not None else []
    ok = tests[0] if len(tests) == 1 else tests[0] & tests[1]
    return F.coalesce(ok, F.lit(True)) | (F.col("n_words") < rule.words)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base verdict, names of the failed rules and ``kept``.

    The base verdict fails texts under 10 words and texts of which over a fifth
    of the words lie in repeated windows.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    done = measures(df, id_col, text_col).select("*", base.alias("base_failed"), failed.alias("failed_rules"))
    return done.select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judge(df, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_lettered", "n_stop", F.array_join("failed_rules", ",").alias("failed_rules"))


def _sql_rules() -> str:
    out = []
    for r in RULES:
        v = f"{r.measure}::DOUBLE / nullif({r.over}, 0)" if r.over else r.measure
        tests = ([f"{v} >= {r.low}"] if r.low is not None else []) + ([f"{v} <= {r.high}"] if r.high is not None else [])
        out.append(f"CASE WHEN NOT (coalesce({' AND '.join(tests)}, true) OR n_words < {r.words}) THEN '{r.name}' END")
    return ", ".join(out)


def oracle() -> str:
    """DuckDB SQL of ``report`` over ``documents``, windows compared by their words."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
cut AS (SELECT doc_id, k, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
pos AS (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM cut WHERE len(words) >= 5),
win AS (SELECT k, i, array_to_string(words[i:i+4], ' ') AS w FROM pos),
rep AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt
        FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS c FROM win) WHERE c >= 2),
cover AS (SELECT k, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM rep GROUP BY k),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda w: regexp_matches(w, '\p{{L}}')))::BIGINT AS n_lettered,
        len(list_filter(words, lambda w: lower(trim(w, '.,;:!?"''()')) IN ({stop})))::BIGINT AS n_stop
      FROM cut LEFT JOIN cover USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        array_to_string(list_filter([{_sql_rules()}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, n_lines, n_lettered, n_stop, failed_rules FROM b"""

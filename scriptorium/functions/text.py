"""Text column expressions.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen and run where the data lives; no Python worker is involved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from scriptorium.functions import fixed_values as fv

# Unicode-aware whitespace, as the reference's str.strip() and re's \s.
_WS = r"(?U)\s"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ustrip(col: Column) -> Column:
    """Strip leading and trailing Unicode whitespace; the first and last character tell whether there is any."""
    def strip(t: Column) -> Column:
        ends = F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
        return F.when(ends.rlike(_WS), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t)
    return let(col, strip)


def clean_text(col: Column) -> Column:
    """Null or empty → ``No Data``; else strip, then delete ``"`` and ``'``.

    A whitespace-only value is not empty, so it becomes the empty string.
    """
    return (F.when(col.isNull() | (col == F.lit("")), F.lit(fv.NO_DATA))
            .otherwise(F.translate(ustrip(col), "\"'", "")))


def phrase_pattern(phrase: str) -> str:
    """Java regex for one phrase: optional opening tags, whitespace, the
    literal phrase (case-insensitive), whitespace, optional closing tags."""
    return r"(?iuU)(<.*?>)*\s*" + "\\Q" + phrase + "\\E" + r"\s*(</.*?>)*"


def remove_forbidden_phrases(col: Column, phrases: Sequence[str] = fv.FORBIDDEN_PHRASES) -> Column:
    """Replace each phrase (in list order) by one space, then strip.

    A step's pattern is tried only on a text that holds its phrase
    (case-insensitively) by then, which a scan for the literal tells; a text in which
    none of them occurs at first, which one scan tells, is only stripped.
    Texts between the steps are computed once.
    """
    def without(phrase: str) -> Callable[[Column], Column]:
        return lambda t: F.when(t.rlike("(?iu)\\Q" + phrase + "\\E"), F.regexp_replace(t, phrase_pattern(phrase), " ")).otherwise(t)

    def chain(text: Column) -> Column:
        for phrase in phrases:
            text = let(text, without(phrase))
        return text

    any_phrase = "(?iu)" + "|".join("\\Q" + p + "\\E" for p in dict.fromkeys(p.lower() if p.isascii() else p for p in phrases))
    return let(col, lambda t: ustrip(F.when(t.rlike(any_phrase), chain(t)).otherwise(t)))


def strip_inline_tags(raw: Column, sections: Sequence[str] = fv.MIXED_SECTIONS) -> Column:
    """P2 on the raw XML string: drop all markup inside the mixed-content
    sections (title, abstract), whatever its name, and keep the text.

    A tag lies inside a section if a section's end follows it before any
    section's start.

    Applied before the parse, where every real ``<`` is markup (text ``<`` is
    escaped as ``&lt;``), so escaped text can never be mistaken for a tag.
    """
    names = "|".join(re.escape(t) for t in sections)
    other = r"<(?!/?(?:" + names + r")[\s/>])"
    return F.regexp_replace(raw, other + r"[^>]*>(?=[^<]*+(?:" + other + r"[^<]*+)*+</(?:" + names + r")\s*>)", "")


def xml_escape(col: Column) -> Column:
    """Escape ``& < >`` and drop characters XML 1.0 forbids."""
    no_ctrl = F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.replace(F.replace(F.replace(no_ctrl, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# --- tokens for topic models (P11, F5, F6, U5) --------------------------------

EDGE_PUNCT = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
POSSESSIVE = r"['’]s$"
ALNUM_TOKEN = r"^[\p{L}\p{N}]+$"
# the same tokens in one pass over a lower-cased text: between whitespace, edge punctuation, a run, a possessive
# and edge punctuation; texts with line ends that `$` knows and `\s` does not take the steps
PLAIN_TOKEN = r"(?<!\S)[^\p{L}\p{N}\s]*+([\p{L}\p{N}]++)(?:['’]s)?[^\p{L}\p{N}\s]*+(?!\S)"
OTHER_LINE_ENDS = "[\u0085\u2028\u2029]"


def raw_tokens(col: Column) -> Column:
    """Lower-case, split on whitespace, trim edge punctuation, cut ``'s``."""
    parts = F.split(F.lower(col), r"\s+")
    return F.transform(parts, lambda t: F.regexp_replace(F.regexp_replace(t, EDGE_PUNCT, ""), POSSESSIVE, ""))


def topic_tokens(col: Column, stop_words: Sequence[str] = fv.ENGLISH_STOP_WORDS) -> Column:
    """Null → []; keep alphanumeric tokens that are not stop words.

    Repeats are kept (an ``array_except`` would drop them, U5).  The stop-word
    test is an ``isin`` that Catalyst turns into a hash-set probe.
    """
    plain = F.regexp_extract_all(F.lower(col), F.lit(PLAIN_TOKEN), F.lit(1))
    alnum = F.when(col.rlike(OTHER_LINE_ENDS), F.filter(raw_tokens(col), lambda t: t.rlike(ALNUM_TOKEN))).otherwise(plain)
    toks = F.filter(alnum, lambda t: ~t.isin(*stop_words))
    return F.coalesce(toks, F.array().cast("array<string>"))


def vectorizer_terms(tokens: Column) -> Column:
    """the default vectorizer token pattern ignores one-character terms."""
    return F.filter(tokens, lambda t: F.length(t) >= 2)


def join_tokens(tokens: Column) -> Column:
    """P12."""
    return F.array_join(tokens, " ")


def word_pieces(col: Column) -> Column:
    """Lower-cased alphanumeric runs: the tokens of the default embedder."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda t: t != F.lit(""))

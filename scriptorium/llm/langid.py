"""Language identification that fuses several kinds of evidence by Bayes' rule.

* Text: a naive Bayes model of hashed character trigrams, tempered since
  neighbouring trigrams are not independent.  It is fitted on at most
  ``SAMPLE`` labelled rows a language, those with the least hash of their id.
* Declared language (markup or metadata) and address suffix (a path part or
  country domain): the right language with a fixed trust, else any other.
* Host: expected counts of languages by host and by every parent domain, from
  grouped aggregation over all rows.  A host's prior is its counts smoothed
  with its parent's prior, up to all rows; a row's own share is left out.

A row is accepted if its text has letters, is likelier under its language than
under evenly spread trigrams, and the language's posterior is at least
``CONFIDENT``.

Plan: one pass fits (sampled rows only), one pass scores; what moves then is
narrow: sums by host with partial aggregation, and a salted join of rows to
their host's chain of counts, so a host with a third of all rows is no single
task.  The model is ``BUCKETS`` numbers a language.

Cases: null and empty texts have no text evidence and are not accepted; null
declarations, suffixes and hosts are no evidence; texts are read whole at any
length, in stretches; equal rows each have a result; with no labelled rows
nothing is accepted; an empty table gives an empty table; only the named
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import common

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS, SAMPLE = 1 << 15, 500
SMOOTH, TEMPER, TRUST, KAPPA, CONFIDENT = 0.5, 0.1, 0.9, 5.0, 0.5
#: Code points that are scored at once.
STRETCH = 1 << 18

#: Country domains that say something about the language (fixed values).
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

_BLANK = np.ones(128, bool)
_BLANK[65:91] = _BLANK[97:123] = False


def trigrams(text: str):
    """Buckets of the trigrams of letters and blanks of a lower-cased text, in stretches.

    Runs of other ASCII characters count as one blank.
    """
    for at in range(0, len(text), STRETCH):
        part = text[max(0, at - 2):at + STRETCH].lower()
        c = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        low = np.minimum(c, 127)
        blank = (c < 128) & _BLANK[low]
        c = np.where(blank, np.uint32(32), c)
        keep = ~(blank & np.concatenate([[False], blank[:-1]]))
        c = c[keep]
        if len(c) > 2 and (c != 32).any():
            x = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
            yield (x ^ (x >> np.uint32(15))) % np.uint32(BUCKETS)


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> np.ndarray:
    """Log probabilities of buckets by language, shape (BUCKETS, languages)."""
    rows = df.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h")).where(
        F.col("label").isin(*LANGUAGES) & F.col("text").isNotNull())
    # a cut of the hash leaves about twice the sample before texts move to a label's task
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    cuts = [F.when(F.col("label") == l, F.lit(int(-2**63 + 2**64 * (2 * sample / n)))) for l, n in found.items() if n > 2 * sample]
    cut = F.coalesce(*cuts, F.lit(2**63 - 1))
    some = rows.where(F.col("h") <= cut).withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).where(F.col("n") <= sample).select("label", "text")

    def count(batches):
        total = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
        for b in batches:
            for label, text in zip(b.column(0), b.column(1)):
                for x in trigrams(text.as_py()):
                    total[LANGUAGES.index(label.as_py())] += np.bincount(x, minlength=BUCKETS)
        l, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(l, pa.int32()), pa.array(k, pa.int32()), pa.array(total[l, k], pa.int64())], ["l", "k", "n"])

    counts = np.full((BUCKETS, len(LANGUAGES)), SMOOTH)
    for l, k, n in some.mapInArrow(count, "l int, k int, n bigint").groupBy("l", "k").agg(F.sum("n")).toPandas().itertuples(index=False):
        counts[k, l] += n
    return np.log(counts / counts.sum(0)).astype(np.float32)


def text_scores(text: Column, model) -> Column:
    """struct<n, scores>: number of trigrams, and log likelihood a trigram by language."""
    kind = pa.struct([("n", pa.int64()), ("scores", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<n:bigint,scores:array<double>>")
    @common.batchwise
    def run(texts: pa.Array) -> pa.Array:
        table, out = model.value, []
        for t in texts:
            n, total = 0, np.zeros(len(LANGUAGES))
            for x in trigrams(t.as_py() or ""):
                n += len(x)
                total += table[x].sum(0, dtype=np.float64)
            out.append({"n": n, "scores": total / max(n, 1)})
        return pa.array(out, kind)

    return run(text)


def suffix_language(host: Column, path: Column) -> Column:
    """Language of an address: its first path part if that names one, else its country domain."""
    part = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"^/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1))
    domain = F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([a-z]{2})$", 1)
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.when(part.isin(*LANGUAGES), part).otherwise(F.try_element_at(table, domain))


def _evidence(claim: Column) -> list[Column]:
    """Log factors by language of a claimed language; none where it is null or unknown."""
    tag = F.lower(F.substring(F.trim(claim), 1, 2))
    other = (1 - TRUST) / (len(LANGUAGES) - 1)
    return [F.when(tag.isin(*LANGUAGES), F.when(tag == l, F.lit(float(np.log(TRUST)))).otherwise(F.lit(float(np.log(other))))).otherwise(F.lit(0.0)) for l in LANGUAGES]


def _softmax(logs: Column) -> Column:
    """Probabilities of an array of logs."""
    return common.bound(logs, lambda x: common.bound(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: common.bound(
        F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s))))


def scored(df: DataFrame, model, keep: list[Column], text: Column, claims: list[Column], host: Column) -> DataFrame:
    """``keep``, host, mean scores, logs of all evidence but the host's, and their probabilities."""
    read = df.select(*keep, F.coalesce(host, F.lit("")).alias("host"), text_scores(text, model).alias("t"),
                     *[e.alias(f"e{i}_{l}") for i, c in enumerate(claims) for l, e in zip(LANGUAGES, _evidence(c))])
    logs = F.array(*[reduce(lambda a, b: a + b, [TEMPER * F.col("t.n") * F.get("t.scores", F.lit(k)), *[F.col(f"e{i}_{l}") for i in range(len(claims))]]) for k, l in enumerate(LANGUAGES)])
    names = read.columns[:len(keep) + 1]
    out = read.select(*names, "t", logs.alias("logs"))
    return out.select(*names, "t", "logs", _softmax(F.col("logs")).alias("p"))


def ancestors(host: Column) -> Column:
    """A host, its parent domains and the root "", nearest first."""
    parts = F.split(host, r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.array_distinct(F.concat(ups, F.array(F.lit(""))))


def host_chains(rows: DataFrame) -> DataFrame:
    """(host, chain): sums of the probabilities in ``p`` for all rows, then each domain down to the host."""
    sums = [F.sum(F.get("p", F.lit(k))).alias(f"c{k}") for k in range(len(LANGUAGES))]
    of_host = rows.groupBy("host").agg(*sums)
    of_host = common.checkpointed(of_host)
    again = [F.sum(f"c{k}").alias(f"c{k}") for k in range(len(LANGUAGES))]
    of_all = of_host.select("*", F.explode(ancestors(F.col("host"))).alias("up")).groupBy("up").agg(*again)
    place = of_host.select("host", F.posexplode(ancestors(F.col("host"))).alias("near", "up"))
    met = common.salted_join(place, of_all, ["up"], F.col("host"), "inner")
    level = F.struct((-F.col("near")).alias("at"), F.array(*[f"c{k}" for k in range(len(LANGUAGES))]).alias("c"))
    return met.groupBy("host").agg(F.sort_array(F.collect_list(level)).alias("levels")).select("host", F.transform("levels", lambda x: x["c"]).alias("chain"))


def judged(rows: DataFrame, chains: DataFrame, spread: Column) -> DataFrame:
    """Add lang, confidence and accepted to scored rows."""
    return _judge(common.salted_join(rows, chains, ["host"], spread))


def _judge(met: DataFrame) -> DataFrame:
    even = F.array(*[F.lit(1.0 / len(LANGUAGES))] * len(LANGUAGES))

    def smooth(prior: Column, c: Column) -> Column:
        others = F.zip_with(c, F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return common.bound(others, lambda o: common.bound(F.aggregate(o, F.lit(KAPPA), lambda a, v: a + v), lambda n: F.zip_with(o, prior, lambda a, b: (a + KAPPA * b) / n)))

    prior = F.aggregate(F.coalesce("chain", F.array().cast("array<array<double>>")), even, smooth)
    post = _softmax(F.zip_with("logs", prior, lambda a, b: a + F.ln(b)))
    done = met.withColumn("post", post)
    best = F.array_position("post", F.array_max("post")).cast("int") - 1
    lang = F.get(F.array(*[F.lit(l) for l in LANGUAGES]), best)
    readable = (F.col("t.n") > 0) & (F.get("t.scores", best) > float(-np.log(BUCKETS)))
    confidence = F.array_max("post")
    return done.select("*", F.when(readable, lang).otherwise("und").alias("lang"), confidence.alias("confidence"),
                       (F.coalesce(readable, F.lit(False)) & (confidence >= CONFIDENT)).alias("accepted")).drop("post", "chain")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
             claims: list[Column] | None = None, host: Column | None = None, model=None) -> DataFrame:
    """doc_id, lang ("und" if unreadable), confidence, accepted for each row.

    ``claims`` are columns that declare a language, ``host`` is the row's host;
    the model is fitted on ``label_col`` unless a broadcast one is given.
    """
    model = model or df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, label_col))
    rows = common.checkpointed(scored(df, model, [F.col(id_col).alias("doc_id")], F.col(text_col), claims if claims is not None else [F.col(label_col)],
                                      host if host is not None else F.col("source")))
    return judged(rows, host_chains(rows), F.col("doc_id")).select("doc_id", "lang", "confidence", "accepted")


def accepted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The accepted rows of ``df``, whole.

    The rows are scored again beside their texts, so that equal ids with other
    texts are judged apart.  The hosts' chains are broadcast where they are few.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, label_col))
    text, claims, host = F.col(text_col), [F.col(label_col)], F.col(host_col)
    chains = common.checkpointed(host_chains(scored(df, model, [F.col(id_col).alias("doc_id")], text, claims, host)))
    rows = scored(df, model, [F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(id_col).alias("doc_id")], text, claims, host)
    if chains.count() <= 10_000:
        # with so few hosts the broadcast is a few megabytes at most
        met = rows.join(F.broadcast(chains.withColumnRenamed("host", "_host")), F.col("host") == F.col("_host"), "left").drop("_host")
        return _judge(met).where("accepted").select("row.*")
    return judged(rows, chains, F.col("doc_id")).where("accepted").select("row.*")


def report(df: DataFrame) -> DataFrame:
    return identify(df)


def page_report(df: DataFrame, model) -> DataFrame:
    """The same for web pages: markup's language, address suffix and host as evidence."""
    from scriptorium.llm import html_extract, urlfilter
    # neither a user nor a port is part of the domain
    host = F.regexp_replace(urlfilter.host_of(F.col("url")), r"^.*@|:[0-9]*$", "")
    base = df.select("page_id", host.alias("host"), urlfilter.path_of(F.col("url")).alias("path"),
                     F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1).alias("markup"), html_extract.extract(F.col("html")).alias("text"))
    done = identify(base, "page_id", "text", "markup", [F.col("markup"), suffix_language(F.col("host"), F.col("path"))], F.col("host"), model)
    return done.withColumnRenamed("doc_id", "page_id")


def pages_by_documents(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_report`` of all pages by a model fitted on the labelled documents."""
    return page_report(pages, docs.sparkSession.sparkContext.broadcast(fit(docs, "doc_id", "text", "lang")))

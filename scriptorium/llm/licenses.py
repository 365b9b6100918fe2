"""License scans: TF-IDF cosine to templates, then inheritance down directories.

Templates are one-sentence notices, the standard headers of source files and
the full texts (and the title and preamble of those that have one).  Units are
lines, blocks between blank lines, and windows of a template's length at every
word, so a notice inside a long line is met as well; long templates meet the
whole text and windows a quarter of their length apart, with dampened word counts,
since common words would rule there.  A unit's sparse TF-IDF vector is compared by
cosine.  Document frequencies of the template words are counted over all
documents; words that no template has count as seen in none, so they lengthen
a unit's vector but never meet a template's.  ``SPDX-License-Identifier`` lines
name their licence and are read, not compared.

A cosine is at most the root of the share of the template's squared length that
lies on words of the text.  Templates whose share is too small for ``SIMILAR``
are left out at once, which loses no match; the score of a text without licence
is 0.

A document whose own text has no licence inherits that of the licence file in
its nearest ancestor directory.  Directories are resolved apart from the
documents: distinct directories are spread over their ancestors and joined to
the directories' licences; documents then join their directory, salted, so
that one directory with a third of all rows is no single task.

Cases: null and empty texts have no licence of their own; texts are read whole
at any length; a null path has no directory and inherits nothing; of several
licence files in a directory the best score counts, then the least id, then
the licence's name; equal rows each have a result; an empty table gives an
empty table; only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import functools
import math
import pkgutil
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common

#: Notices by licence (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
)

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation, {1}. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU {0} License for more details.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
          "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")

#: Standard headers of source files, and texts of the short licences (fixed values).
HEADERS = (
    *[(name, _GNU.format(kind, f"either version {v} of the License, or (at your option) any later version")) for name, kind, v in (
        ("GPL-3.0", "General Public", "3"), ("GPL-2.0", "General Public", "2"), ("LGPL-3.0", "Lesser General Public", "3"), ("LGPL-2.1", "Lesser General Public", "2.1"),
        ("AGPL-3.0", "Affero General Public", "3"))],
    *[(name, _GNU.format("General Public", f"version {v} of the License").split(". This")[0] + ".") for name, v in (("GPL-3.0", "3"), ("GPL-2.0", "2"))],
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
            "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
                  "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Licences whose full text is a file of ``license_texts``.
FULL = ("Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0")

SPDX = re.compile(r"SPDX-License-Identifier:[\x20\x09(]*([A-Za-z0-9.-]+)(\+?)", re.A)
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SIMILAR = 0.7
#: Templates with more words are long.
LONG = 200


@functools.cache
def templates() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(licence, words) of all templates; only the driver reads them."""
    out = [*TEMPLATES, *HEADERS]
    for name in FULL:
        text = pkgutil.get_data("scriptorium.llm", f"license_texts/{name}.txt").decode()
        head = re.split(r"TERMS AND CONDITIONS", text)[0] if "Preamble" in text else ""
        out += [(name, x) for x in (text, head) if x]
    return tuple((name, tuple(TOKEN.findall(text.lower()))) for name, text in out)


def vocabulary() -> list[str]:
    return sorted({w for _, words in templates() for w in words})


def word_frequencies(df: DataFrame, text_col: str) -> DataFrame:
    """(word, df): in how many documents a template word occurs; word "" counts documents."""
    known = frozenset(vocabulary())

    def count(batches):
        total = dict.fromkeys(["", *known], 0)
        for b in batches:
            for t in b.column(0):
                total[""] += 1
                for w in known.intersection(TOKEN.findall((t.as_py() or "").lower())):
                    total[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "df"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, df bigint").groupBy("word").agg(F.sum("df").alias("df"))


class Matcher:
    """Cosine of units of a text to every template."""

    def __init__(self, frequencies: dict[str, int]):
        docs, words = frequencies.get("", 0), vocabulary()
        self.idf = {w: 1 + math.log((1 + docs) / (1 + frequencies.get(w, 0))) for w in words}
        self.unknown = 1 + math.log(1 + docs)
        self.row = {w: i for i, w in enumerate(words)}
        self.templates = [(name, len(t), *self.vector(t, len(t) > LONG)) for name, t in templates()]
        #: Share of a template's squared length on each word.
        self.share = np.zeros((len(words), len(self.templates)))
        for k, (_, _, weights, length) in enumerate(self.templates):
            for w, x in weights.items():
                self.share[self.row[w], k] = (x / length) ** 2

    def vector(self, words, dampened: bool) -> tuple[dict[str, float], float]:
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        weights = {w: (1 + math.log(n) if dampened else n) * self.idf.get(w, self.unknown) for w, n in counts.items()}
        return weights, math.sqrt(sum(x * x for x in weights.values()))

    def cosine(self, k: int, words) -> float:
        _, size, weights, length = self.templates[k]
        vector, norm = self.vector(words, size > LONG)
        return sum(x * weights.get(w, 0.0) for w, x in vector.items()) / (norm * length) if norm else 0.0

    def windows(self, k: int, words: list[str], idf: np.ndarray, least: float):
        """Windows of template ``k``'s length that may come above ``least``, the best first."""
        _, size, weights, length = self.templates[k]
        m = min(size, len(words))
        if size > LONG:
            starts = [*range(0, len(words) - m, max(m // 4, 1)), len(words) - m]
            yield from ((1.0, words[i:i + m]) for i in starts)
            return
        met = np.array([weights.get(w, 0.0) for w in words]) * idf
        total = lambda x: (c := np.concatenate([[0.0], np.cumsum(x)]))[m:] - c[:-m]
        # a word that occurs n times adds n squared to the exact norm, here only n
        bound = total(met) / (np.sqrt(np.maximum(total(idf * idf), 1e-12)) * length)
        at = np.nonzero(bound >= least - 1e-9)[0]
        for i in at[np.argsort(-bound[at], kind="stable")]:
            yield float(bound[i]), words[i:i + m]

    def scan(self, text: str | None) -> tuple[str | None, float]:
        """The best licence of a text and its cosine; None and 0 below ``SIMILAR``."""
        if not text:
            return None, 0.0
        named = SPDX.search(text)
        if named:
            return re.sub(r"-(only|or-later)$", "", named[1].rstrip(".-")), 1.0
        words = TOKEN.findall(text.lower())
        rows = [self.row[w] for w in set(words) if w in self.row]
        near = np.nonzero(self.share[rows].sum(0) >= SIMILAR ** 2 - 1e-6)[0]
        if not len(near):
            return None, 0.0
        idf = np.array([self.idf.get(w, self.unknown) for w in words])
        units = [words]
        for block in re.split(r"\n[\x20\x09-\x0D]*\n", text):
            units += [TOKEN.findall(x.lower()) for x in dict.fromkeys([*block.split("\n"), block])]
        score, name = 0.0, None
        for k in near:
            for unit in units:
                found = self.cosine(k, unit)
                if found > score + 1e-12:
                    score, name = found, self.templates[k][0]
            for bound, unit in self.windows(k, words, idf, max(score, SIMILAR)):
                if bound <= score + 1e-12:
                    break
                found = self.cosine(k, unit)
                if found > score + 1e-12:
                    score, name = found, self.templates[k][0]
        return (name, score) if score >= SIMILAR else (None, 0.0)


def own_licences(text: Column, matcher) -> Column:
    """struct<license, score> of a text column; ``matcher`` is broadcast."""
    kind = pa.struct([("license", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<license:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        m = matcher.value
        return pa.array([dict(zip(("license", "score"), m.scan(t.as_py()))) for t in texts], kind)

    return run(text)


def directory(path: Column) -> Column:
    """What stands before the last slash; "" for a file at the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def up(folder: Column) -> Column:
    """A directory and its ancestors down to the root "", as an array."""
    parts = F.split(folder, "/")
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(""))))


def scan(df: DataFrame, id_col: str, text_col: str, path: Column, is_licence_file: Column) -> DataFrame:
    """doc_id, path, own license and score, license (own or inherited), and the directory it comes from."""
    frequencies = {r["word"]: r["df"] for r in word_frequencies(df, text_col).collect()}
    matcher = df.sparkSession.sparkContext.broadcast(Matcher(frequencies))
    read = df.select(F.col(id_col).alias("doc_id"), path.alias("path"), is_licence_file.alias("is_file"), own_licences(F.col(text_col), matcher).alias("o"))
    docs = common.checkpointed(read.select("doc_id", "path", directory(F.col("path")).alias("folder"), "is_file",
                                           F.col("o.license").alias("own_license"), F.col("o.score").alias("score")))
    best = F.min(F.struct((-F.col("score")).alias("s"), "doc_id", "own_license"))
    given = docs.where(F.col("is_file") & F.col("own_license").isNotNull() & F.col("folder").isNotNull()).groupBy("folder").agg(best.alias("b")).select(
        F.col("folder").alias("above"), F.col("b.own_license").alias("inherited"))
    folders = docs.where(F.col("folder").isNotNull()).select("folder").distinct().select("folder", F.explode(up(F.col("folder"))).alias("above"))
    met = common.salted_join(folders, given, ["above"], F.col("folder"), "inner")
    nearest = met.groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "inherited")).alias("n")).select(
        "folder", F.col("n.above").alias("from_folder"), F.col("n.inherited").alias("inherited"))
    done = common.salted_join(docs, nearest, ["folder"], F.col("doc_id"))
    own = F.col("own_license").isNotNull()
    return done.select("doc_id", "path", "own_license", "score", F.coalesce("own_license", "inherited").alias("license"),
                       F.when(~own, F.col("from_folder")).alias("from_folder"))


def document_path() -> tuple[Column, Column]:
    """A path for rows of ``documents``, which have none, and whether it is a licence file's.

    Sources hold directories of a thousand ids with ten of a hundred each; every
    hundredth document is the upper directory's licence file and every
    twentieth the lower one's.
    """
    n, source = F.col("doc_id"), F.coalesce(F.col("source"), F.lit("unknown"))
    upper = F.concat_ws("/", source, F.expr("doc_id div 1000").cast("string"))
    lower = F.concat_ws("/", upper, F.expr("doc_id div 100 % 10").cast("string"))
    path = F.when(n % 100 == 0, F.concat(upper, F.lit("/LICENSE"))).when(n % 20 == 0, F.concat(lower, F.lit("/LICENSE"))).otherwise(
        F.concat(lower, F.lit("/"), n.cast("string"), F.lit(".txt")))
    return path, F.coalesce(n % 20 == 0, F.lit(False))


def report(df: DataFrame) -> DataFrame:
    path, is_file = document_path()
    return scan(df, "doc_id", "text", path, is_file)

"""Fields of text blocks by label places, against one pattern over the whole block."""

import itertools
import random
import re

from scriptorium.sources.citations import block_fields

WHOLE = re.compile(r"[^\n]*\nTitle: (.*?)\nAuthors: (.*?)\nAbstract: (.*)\nJournal: (.*?)\nPublication Date: (.*?)\n*\Z", re.S)
NAMES = ["Title", "Authors", "Abstract", "Journal", "Publication Date"]


def plain(block):
    found = WHOLE.match(block)
    if found:
        return list(found.groups())
    lines = [re.search(rf"^{name}: (.*)$", block, re.M) for name in NAMES]
    return [m[1] if m else "" for m in lines]


def test_fields_equal_one_pattern_over_the_block(spark):
    r = random.Random(1)
    pieces = ["\nTitle: ", "\nAuthors: ", "\nAbstract: ", "\nJournal: ", "\nPublication Date: ", "text", "\n", "two\nlines", "é😀 ", "Journal: ", ""]
    blocks = ["Abstract #1" + "".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    whole = ["Abstract #2\nTitle: {}\nAuthors: {}\nAbstract: {}\nJournal: {}\nPublication Date: {}\n"]
    values = ["", "a", "b\nc", "\nJournal: x", "\nAbstract: y\nAuthors: z", "\nPublication Date: 2001", "end\n\n"]
    blocks += [whole[0].format(*v) for v in itertools.islice(itertools.product(values, repeat=5), 0, None, 7)]
    rows = block_fields(spark.createDataFrame([(b,) for b in blocks], "block string")).collect()
    assert len(rows) == len(blocks)
    for row in rows:
        assert [row.title, row.authors, row.abstract, row.journal, row.pub_date] == plain(row.block), row.block
    assert sum(WHOLE.match(b) is not None for b in blocks) > 1000


def test_nulls_and_empty_blocks(spark):
    rows = block_fields(spark.createDataFrame([("",), ("Abstract #7",)], "block string")).collect()
    assert [(r.pmid, r.title, r.pub_date) for r in rows] == [("", "", ""), ("7", "", "")]

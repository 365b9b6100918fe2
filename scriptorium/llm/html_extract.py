"""Main text of web pages by minimum cut over their blocks.

A page is cut into blocks (stretches of text between block-level tags) with
their place in the element tree.  A linear classifier over structure, class
names, links and punctuation gives each block a cost of being called
boilerplate and a cost of being called content; these are the capacities to
the two terminals.  Neighbouring blocks, and blocks that follow one another
under the same parent, are joined by edges that weigh more the deeper their
common ancestor lies.  The minimum cut labels the blocks; those on the
content side are the text.

Each page is solved by itself in the scan's tasks (no shuffle); a page's graph
has at most two edges a block, so memory follows the longest page.

Cases: null and empty pages give an empty text; pages are read whole at any
length, also where tags are unclosed or cut off; repeated rows are extracted
each; an empty table gives an empty table; only the named columns are read, so
extra columns cannot clash.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements that end a block,
#: elements whose content is no markup, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul button iframe noscript template textarea").split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp svg math template noscript".split())
HIDDEN = frozenset("script style title iframe noembed noframes svg math template noscript head object audio video canvas".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "body": {"head"}}
CLOSES_P = frozenset((
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul").split())
SCOPES = frozenset("table ul ol dl select article section div body".split())

BOILERPLATE_TAGS = {"nav": 12.0, "footer": 12.0, "aside": 12.0, "form": 12.0, "button": 12.0, "select": 12.0, "menu": 12.0,
                    "dialog": 12.0, "header": 9.0, "textarea": 12.0, "fieldset": 9.0, "address": 1.0}
CONTENT_TAGS = {"article": -6.0, "main": -5.0, "p": -1.0, "h1": -1.5, "pre": -1.0, "blockquote": -1.0, "figcaption": -0.5, "td": -0.3}
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|breadcrumb|breadcrumbs|byline-share|comment|comments|consent|cookie|cookies|"
    r"disclaimer|discussion|disqus|footer|gdpr|header|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|"
    r"outbrain|pager|pagination|popup|promo|promoted|related|replies|respond|search|share|sharing|sidebar|signup|social|"
    r"sponsor|sponsored|subscribe|taboola|toolbar|widget)s?(?:$|[\s_-])")
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?:$|[\s_-])")
ROLES = {"navigation": 12.0, "banner": 9.0, "contentinfo": 12.0, "complementary": 12.0, "search": 12.0, "alert": 6.0, "main": -5.0, "article": -6.0}

TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)(?:>|$)|<[!?/][^>]*(?:>|$)""", re.S)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
SENTENCE = re.compile(r"[.!?](?:\s|$)")

#: Weight of an edge between neighbours whose common ancestor lies at the root and per level below it.
SMOOTH, SMOOTH_LEVEL = 0.15, 0.2


class Node:
    """An open or closed element: its tag, parent, depth and the evidence it hands down."""

    __slots__ = ("tag", "parent", "depth", "score", "hidden", "link")

    def __init__(self, tag: str, parent: Node | None, attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.score = parent.score if parent else 0.0
        self.hidden = bool(parent and parent.hidden) or tag in HIDDEN
        self.link = bool(parent and parent.link) or tag == "a"
        self.score += BOILERPLATE_TAGS.get(tag, 0.0) + CONTENT_TAGS.get(tag, 0.0)
        if attrs and tag != "body" and tag != "html":
            for name, *values in ATTR.findall(attrs):
                name, value = name.lower(), "".join(values).lower()
                if name == "role":
                    self.score += ROLES.get(value, 0.0)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.hidden = True
                elif name in ("class", "id"):
                    if BOILERPLATE_NAMES.search(value):
                        self.score += 12.0
                    elif CONTENT_NAMES.search(value):
                        self.score -= 2.0


class Block:
    """A stretch of text between block-level tags."""

    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def blocks(page: str) -> list[Block]:
    """The page's visible blocks in order, texts decoded and with single blanks."""
    out: list[Block] = []
    parts: list[str] = []
    linked, owner = 0, None
    node = root = Node("#", None, "")
    at = 0

    def text(raw: str, literal: bool = False) -> None:
        nonlocal linked, owner
        if node.hidden or not raw:
            return
        s = raw if literal or "&" not in raw else html.unescape(raw)
        parts.append(s)
        if owner is None and not s.isspace():
            owner = node
        if node.link:
            linked += len(s)

    def flush() -> None:
        nonlocal linked, owner
        if parts:
            s = BLANKS.sub(" ", "".join(parts)).strip(" ")
            if s:
                place = owner or node
                while place.parent is not None and place.tag not in BLOCK:
                    place = place.parent
                out.append(Block(place, s, linked))
            parts.clear()
        linked, owner = 0, None

    while True:
        m = TAG.search(page, at)
        text(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                text(m["cdata"], True)
            continue
        name = name.lower()
        if m["end"]:
            if name in BLOCK:
                flush()
            up = node
            while up is not root and up.tag != name and not (name == "p" and up.tag in SCOPES):
                up = up.parent
            if up is not root and up.tag == name:
                node = up.parent
            continue
        if name in BLOCK:
            flush()
            shut = ENDS.get(name, ())
            if name in CLOSES_P:
                shut = {"p", *shut}
            if shut:
                up = node
                while up is not root and up.tag not in shut and up.tag not in SCOPES:
                    up = up.parent
                if up.tag in shut:
                    node = up.parent
        elif name == "br":
            text(" ", True)
        if name in VOID:
            continue
        attrs = m["attrs"]
        if attrs.endswith("/") and name in ("svg", "math"):
            continue
        node = Node(name, node, attrs)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if name == "textarea":
                text(page[at:end.start() if end else len(page)])
            at = end.start() if end else len(page)
    flush()
    return out


def costs(block: Block) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content)."""
    n = len(block.text)
    score = block.node.score
    share = block.linked / n
    if share > 0.5:
        score += 4.0 * share
    score -= min(n, 400) / 200
    if SENTENCE.search(block.text):
        score -= 0.7
    if block.text[0] == "©" or block.text[:9].lower() == "copyright":
        score += 6.0
    score += 0.8
    return (-score, 0.0) if score < 0 else (0.0, score)


def nearness(a: Block, b: Block) -> float:
    """Weight of the edge between two blocks: more the deeper their common ancestor."""
    x, y = a.node, b.node
    far = 0
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        far += 1
    return (SMOOTH + SMOOTH_LEVEL * x.depth) / (1 + far / 2)


def edges(page_blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, and blocks that follow one another below the same parent."""
    out, seen = [], {}
    for i, b in enumerate(page_blocks):
        if i:
            out.append((i - 1, i, nearness(page_blocks[i - 1], b)))
        above = b.node.parent or b.node
        j = seen.get(id(above))
        if j is not None and j != i - 1:
            out.append((j, i, nearness(page_blocks[j], b)))
        seen[id(above)] = i
    return out


def min_cut(capacities: list[tuple[float, float]], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut.

    ``capacities`` are those from the source and to the sink; ``links`` are
    undirected.  Flow is pushed along shortest paths in phases over level
    graphs, without recursion; a node with both capacities passes the lesser
    straight through first.
    """
    n = len(capacities)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, (a, b) in enumerate(capacities):
        if a > b:
            join(s, i, a - b, 0.0)
        elif b > a:
            join(i, t, b - a, 0.0)
    for a, b, w in links:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        step = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while step[a] < len(out[a]):
                e = out[a][step[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                step[a] += 1
            if step[a] < len(out[a]):
                path.append(out[a][step[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(page: str | None) -> str:
    """The main text of one page, its blocks joined by line feeds."""
    found = blocks(page) if page else []
    if not found:
        return ""
    content = min_cut([costs(b) for b in found], edges(found))
    return "\n".join(b.text for b, keep in zip(found, content) if keep)


def extract(page: Column) -> Column:
    """The main text of an HTML column; empty where there is none."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return run(page)


def report(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    done = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(F.col(html_col)).alias("text"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

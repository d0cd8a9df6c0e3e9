"""Main text of HTML pages by a minimum cut.

A page becomes a row of text blocks. A linear classifier over a block's place in the page (elements and names around
it), its links and its length gives the cost of calling it content and of calling it boilerplate; these are the
capacities to the two terminals. Blocks that follow each other or stand in the same element are joined by smoothness
edges, the stronger the more of their path they share. The minimum cut labels all blocks of the page at once.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.words import blocks

TAG = re.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)>|<[!?/][^>]*>"""
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
# Elements of HTML, and names that pages give to their parts.
HIDDEN = frozenset("script style noscript template head title textarea select svg iframe object canvas audio video math datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"button", "label", "legend", "caption", "summary"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
LIMIT = frozenset("ul ol menu dl table article section div main body".split())
AGAINST = frozenset("nav footer aside form button menu dialog fieldset label search".split())
BAD = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline caption comment comments consent cookie cookies copyright dialog disclaimer "
    "discussion footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup privacy promo promoted "
    "promotion reader recommended related replies reply search share sharing sidebar sign signup skip social sponsor sponsored subscribe subscription tags "
    "toolbar topbar trending warning widget".split()
)
GOOD = frozenset("article articlebody body content entry main post prose story text".split())
WEIGHTS = {
    "bias": 0.5, "inside": 3.5, "against": -5.0, "bad_name": -5.0, "good_name": 1.2, "header": -4.0,
    "links": -3.5, "length": 1.6, "sentence": 0.6, "heading": 0.6,
}
NEXT, NEAR = 0.35, 0.65


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # elements around it, by number
    tags: tuple[str, ...]
    bad: int
    good: int
    link: int  # characters inside links


def parse(page: str) -> list[Block]:
    """Blocks of a page with text, in order. Missing end tags are implied, unknown ones ignored."""
    out: list[Block] = []
    # open elements: tag, number, names that speak against and for content around here
    stack: list[tuple[str, int, int, int]] = []
    pieces: list[str] = []
    link = links = number = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(
                Block(text, tuple(e[1] for e in stack), tuple(e[0] for e in stack), stack[-1][2] if stack else 0, stack[-1][3] if stack else 0, links)
            )
        pieces.clear()
        links = 0

    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            pieces.append(piece)
            if link and not piece.isspace():
                links += len(piece)
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if name == "a":
                link = 0
            elif name in BLOCK:
                if name == "p" and not any(e[0] == "p" for e in stack):
                    flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        flush()
                        del stack[i:]
                        link = 0
                        break
            continue
        attributes = m["attributes"] or m["attributes2"] or ""
        if name in HIDDEN:
            if attributes.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            if name in ("head", "title", "textarea", "select"):
                flush()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name == "a":
            link = 1
        if name not in BLOCK:
            continue
        flush()
        if name == "hr":
            continue
        closed = CLOSED_BY.get(name, set()) | ({"p"} if name in CLOSES_P else set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closed:
                del stack[i:]
                link = 0
                break
            if stack[i][0] in LIMIT:
                break
        bad, good = (stack[-1][2], stack[-1][3]) if stack else (0, 0)
        if "=" in attributes and name != "body":
            for value in NAMES.findall(attributes):
                words = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(value)).lower()))
                bad += bool(words & BAD)
                good += bool(words & GOOD)
        number += 1
        stack.append((name, number, bad, good))
    flush()
    return out


def content_score(b: Block, weights: dict[str, float] = WEIGHTS) -> float:
    """Log odds of content."""
    words = b.text.count(" ") + 1
    score = weights["bias"]
    inside = max((i for i, t in enumerate(b.tags) if t in ("article", "main")), default=-1)
    if inside >= 0:
        score += weights["inside"]
    if any(t in AGAINST for t in b.tags):
        score += weights["against"]
    if "header" in b.tags and not (inside >= 0 and b.tags.index("header") > inside):
        score += weights["header"]
    score += weights["bad_name"] * bool(b.bad) + weights["good_name"] * bool(b.good)
    score += weights["links"] * min(1.0, b.link / len(b.text))
    score += weights["length"] * (min(words, 40) / 40 - 0.25)
    score += weights["sentence"] * (b.text[-1] in ".!?:;…\"”'")
    score += weights["heading"] * (bool(b.tags) and b.tags[-1] in ("h1", "h2", "h3"))
    return score


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut; edges hold both ways. Blocking flows by level."""
    n = len(source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        # what passes straight through a node needs no path
        both = min(source[i], sink[i])
        add(s, i, source[i] - both, 0.0)
        add(i, t, sink[i] - both, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == s:
                    break
                a = to[path.pop() ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def closeness(a: Block, b: Block) -> float:
    """Share of the longer path that two blocks have in common, counted from the page's root."""
    common = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        common += 1
    return common / max(len(a.path), len(b.path), 1)


def label(found: list[Block], weights: dict[str, float] = WEIGHTS) -> list[bool]:
    """Whether each block is content."""
    if not found:
        return []
    odds = [max(-12.0, min(12.0, content_score(b, weights))) for b in found]
    source = [math.log1p(math.exp(x)) for x in odds]
    sink = [math.log1p(math.exp(-x)) for x in odds]
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT * closeness(found[i - 1], b) ** 2))
        home = b.path[-2] if len(b.path) > 1 else -1
        if home in last:
            edges.append((last[home], i, NEAR * closeness(found[last[home]], b) ** 2))
        last[home] = i
    return minimum_cut(source, sink, edges)


def extract_text(page: str) -> str:
    found = parse(page)
    return " ".join(b.text for b, keep in zip(found, label(found)) if keep)


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points).

    A null or empty page has an empty text, and so has a page without content blocks; text outside any element is a
    block as well. Repeated rows are read one by one.
    """
    source = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(page).cast("string").alias("page"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "page"):
                texts = [extract_text(p or "") for p in block.column("page").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": block.column("id"),
                        "url": block.column("url"),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    }
                )

    return source.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint").withColumnsRenamed({"id": id, "url": url})

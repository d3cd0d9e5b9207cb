"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of text blocks and tags. Words score positive, linked words and tags negative, with
weights learned from pages whose markup labels their content; a linear scan finds the contiguous region with
the largest sum. Menus, adverts, forms and the like are marked by their elements and names and take no part in
the sequence, unless that leaves no region: a mark around all content is an error of its name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|textarea|title|template|noscript|iframe|svg)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that never hold main text.
NEVER = frozenset("nav aside footer head menu dialog".split())
#: Containers that hold none either, unless they are wrapped around the whole page.
SELDOM = frozenset("form fieldset header".split())
#: Names of classes, ids and roles that mark a container without main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense alert banner breadcrumb breadcrumbs comment comments "
    "commentlist complementary contentinfo cookie cookies consent disclaimer disqus footer gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notification notifications overlay pager pagination popup privacy promo promoted promotion "
    "recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser "
    "teasers toolbar topbar warning widget widgets".split()
)
#: A name of several parts marks one if the others only say where it stands or what it is made of.
WHERE = frozenset(
    "area bar block bottom box buttons container content desktop form fixed global inner items left links list main mobile outer "
    "page panel posts primary region right secondary section site sticky thread top unit wrap wrapper".split()
)


def _is_mark(name: str) -> bool:
    parts = [w.lower() for w in _NAME_PARTS.findall(name)]
    held = [w for w in parts if w in MARKS]
    return bool(held) and all(w in MARKS or w in WHERE or w.isdigit() for w in parts) and parts[-1] != "content"


_CLOSES_P = BLOCKS - {"body", "html"}
_SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


@dataclass
class Weights:
    """word: score of a word; linked: of a word inside a link; tag: of each tag, other: of an unlisted tag."""

    word: float = 1.0
    linked: float = -0.5
    other: float = -0.3
    tag: dict[str, float] = field(default_factory=dict)


@dataclass
class Element:
    tag: str
    parent: int
    #: 0: may hold main text, 1: doesn't unless it is wrapped around it, 2: never does
    mark: int


@dataclass
class Page:
    elements: list[Element]
    #: (element, text, words, words in links, tags since the block before)
    blocks: list[tuple[int, str, int, int, tuple[str, ...]]]


def _mark(tag: str, attrs: str, inside_article: bool) -> int:
    if tag in NEVER:
        return 2
    mark = int(tag in SELDOM and not (tag == "header" and inside_article))
    if not attrs or tag in ("html", "body", "main"):
        return mark
    for name, a, b, c, hidden in _ATTR.findall(attrs):
        if hidden:
            return 2
        name, value = name.lower(), a or b or c
        if name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if name in ("class", "id", "role") and any(_is_mark(x) and not (inside_article and x.lower() == "header") for x in value.split()):
            mark = 1
    return mark


def parse(text: str) -> Page:
    """Blocks of text in page order with the elements that hold them; every part of the page is read."""
    elements = [Element("html", -1, 0)]
    stack = [0]
    blocks: list[tuple[int, str, int, int, tuple[str, ...]]] = []
    parts: list[str] = []
    tags: list[str] = []
    linked, in_link, at = 0, 0, 0
    articles = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            line = html.unescape("".join(parts)).split()
            if line:
                blocks.append((stack[-1], " ".join(line), len(line), min(linked, len(line)), tuple(tags)))
                tags.clear()
            parts.clear()
            linked = 0

    def pop() -> None:
        nonlocal articles
        e = elements[stack.pop()]
        articles -= e.tag == "article"

    for m in _TOKEN.finditer(text):
        if m.start() > at:
            chunk = text[at : m.start()]
            parts.append(chunk)
            if in_link:
                linked += len(chunk.split())
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if m[2] else 1
            continue
        tags.append(tag)
        if m[2]:
            if tag in BLOCKS or tag in NEVER:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].tag == tag), 0)
                flush()
                while depth and len(stack) > depth:
                    pop()
            else:
                depth = len(stack) - 1
                while depth > 0 and elements[stack[depth]].tag not in BLOCKS:
                    if elements[stack[depth]].tag == tag:
                        flush()
                        while len(stack) > depth:
                            pop()
                        break
                    depth -= 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        block = tag in BLOCKS
        if block:
            flush()
            if tag in _CLOSES_P:
                _close(elements, stack, "p", pop)
            if tag in _SELF_CLOSING:
                _close(elements, stack, tag, pop, _SELF_CLOSING[tag])
        mark = _mark(tag, m[4], articles > 0)
        if not block and not mark:
            continue  # inline markup has no part in the tree
        flush()
        elements.append(Element(tag, stack[-1], mark))
        stack.append(len(elements) - 1)
        articles += tag == "article"
    if at < len(text):
        parts.append(text[at:])
    flush()
    return Page(elements, blocks)


def _close(elements: list[Element], stack: list[int], tag: str, pop, stops=frozenset()) -> None:
    """End an open ``tag`` that the next element ends implicitly, within the nearest container."""
    for i in range(len(stack) - 1, 0, -1):
        own = elements[stack[i]].tag
        if own == tag:
            while len(stack) > i:
                pop()
            return
        if own in stops or own in BLOCKS and (stops or own != "p"):
            if not stops or own in stops:
                return


def gain(block, w: Weights) -> float:
    """Score of a block's words."""
    return w.word * (block[2] - block[3]) + w.linked * block[3]


def gap(block, w: Weights) -> float:
    """Score of the tags that lead up to a block."""
    return sum(w.tag.get(t, w.other) for t in block[4])


def best_region(gains: list[float], gaps: list[float]) -> tuple[int, int]:
    """Half-open range with the largest sum of gains and of the gaps within, the first of equal ones; none: (0, 0).

    What leads up to the first block of a range isn't part of it.
    """
    best, top, start, run = (0, 0), -math.inf, 0, 0.0
    for i, (own, before) in enumerate(zip(gains, gaps)):
        if i == 0 or run + before <= 0:
            start, run = i, own
        else:
            run += before + own
        if run > top:
            top, best = run, (start, i + 1)
    return best


def extract(text: str | None, w: Weights) -> str:
    """The main text; null, empty or wordless pages: the empty string."""
    if not text:
        return ""
    page = parse(text)
    while True:
        blocks = [page.blocks[i] for i in free_blocks(page)]
        gains, gaps = [gain(x, w) for x in blocks], [gap(x, w) for x in blocks]
        a, b = best_region(gains, gaps)
        if sum(gains[a:b]) > 0 or not _lift(page):
            break
    return "\n\n".join(blocks[i][1] for i in _completed(page, blocks, gains, gaps, a, b))


def _completed(page: Page, blocks, gains, gaps, a: int, b: int):
    """The region's blocks and those that belong to it, in page order.

    An article that holds most of the region's words is taken whole. Otherwise blocks of the region's common
    container belong to it if their words outweigh their tags; right under the body, they must be elements of
    a kind that the region has.
    """
    if a == b:
        return []
    el = page.elements
    paths = [_path(el, x[0]) for x in blocks]
    words: Counter = Counter()
    for i in range(a, b):
        for e in paths[i]:
            if el[e].tag in ("article", "main"):
                words[e] += blocks[i][2]
    held = [e for e in words if 2 * words[e] > sum(x[2] for x in blocks[a:b])]
    if held:
        whole = max(held, key=lambda e: (el[e].tag == "article", -e))
        return [i for i, path in enumerate(paths) if whole in path]
    common = [e for e in paths[a] if all(e in paths[i] for i in range(a, b))]
    root = common[-1] if b - a > 1 or len(common) == 1 else common[-2]
    kinds = {el[blocks[i][0]].tag for i in range(a, b)} if el[root].tag in ("html", "body") else None
    own = lambda i: gains[i] + gaps[i] > 0 and (kinds is None or el[blocks[i][0]].tag in kinds)
    return [i for i, path in enumerate(paths) if a <= i < b or root in path and own(i)]


def free_blocks(page: Page) -> list[int]:
    """Numbers of the blocks outside every marked container.

    A mark on a container that holds the page's only article is an error of its name, so it doesn't count.
    """
    el = page.elements
    articles = [i for i, e in enumerate(el) if e.tag in ("article", "main")]
    if articles and not any(_highest(el, i) == 0 for i in articles):
        own = _most_words(page, [i for i in articles if _highest(el, i) == 1])
        for i in _path(el, own) if own is not None else ():
            el[i].mark = 0
    return [i for i, b in enumerate(page.blocks) if _highest(el, b[0]) == 0]


def _highest(el: list[Element], at: int) -> int:
    return max(el[i].mark for i in _path(el, at))


def _lift(page: Page) -> bool:
    """Take the mark off the outermost container with the most words; False if there is none."""
    el = page.elements
    own = _most_words(page, [i for i, e in enumerate(el) if e.mark == 1 and (e.parent < 0 or _highest(el, e.parent) == 0)])
    if own is not None:
        el[own].mark = 0
    return own is not None


def _most_words(page: Page, among: list[int]) -> int | None:
    """The element with the most unlinked words, the first of equal ones."""
    words = dict.fromkeys(among, 0)
    for at, _, n, linked, _ in page.blocks:
        for i in _path(page.elements, at):
            if i in words:
                words[i] += n - linked
    return max(words, key=lambda i: (words[i], -i), default=None)


def _path(elements: list[Element], at: int) -> list[int]:
    out = []
    while at >= 0:
        out.append(at)
        at = elements[at].parent
    return out[::-1]


def _labelled_counts(text: str | None) -> Counter:
    """Counts of words, linked words and tags by whether the page's markup says they are content."""
    out: Counter = Counter()
    if not text:
        return out
    page = parse(text)
    for el, _, words, linked, tags in page.blocks:
        inside = any(page.elements[e].tag in ("article", "main") for e in _path(page.elements, el))
        inside = inside and _highest(page.elements, el) == 0
        out["word", inside] += words - linked
        out["linked", inside] += linked
        for t in tags:
            out[f"tag:{t}", inside] += 1
    return out


#: Tags that get weights of their own; the vocabulary of learned weights is bounded by it.
WEIGHED = BLOCKS | NEVER | frozenset("b i em strong span img ul ol code".split())


def fit_weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", max_pages: int = 2000) -> Weights:
    """Weights from labelled pages: those whose markup names their content (article or main element).

    ``max_pages`` bounds the sample (the smallest hashes of the id). A word's weight is the log-odds of
    standing inside content, a tag's is the same less what makes it negative: tags always cost. Without
    labelled pages, the defaults of Weights hold.
    """

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(_labelled_counts(text))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
            names=["feature", "inside", "n"],
        )

    ids = pages.select(F.col(id_col)).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(max_pages)
    text = pages.join(F.broadcast(ids.distinct()), id_col).where(F.col(html_col).rlike("(?i)<(article|main)\\b")).select(html_col)
    known = [f"tag:{t}" for t in sorted(WEIGHED)] + ["word", "linked"]
    rows = text.mapInArrow(run, "feature string, inside boolean, n long").where(F.col("feature").isin(known))
    n = {(r["feature"], r["inside"]): r["n"] for r in rows.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()}
    if not n.get(("word", True)):
        return Weights()
    odds = lambda k: math.log((n.get((k, True), 0) + 1) / (n.get((k, False), 0) + 1))
    base = max(0.25, min(4.0, odds("word")))
    tags = {t: max(-1.0, min(-0.1, (odds(f"tag:{t}") - base) / base)) for t in sorted(WEIGHED) if (f"tag:{t}", True) in n or (f"tag:{t}", False) in n}
    linked = max(-2.0, min(0.5, odds("linked") / base))
    return Weights(1.0, linked, -0.3, tags)


def extract_pages(pages: DataFrame, weights: Weights, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with the main text as ``text_col`` (replaced if it is there).

    Null, empty and wordless html gives the empty string. Each row is read by itself and whole, so null and
    repeated ids and repeated rows make no difference; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def main_text(column):
        return column.map(lambda t: extract(t, weights))

    return pages.withColumn(text_col, main_text(F.col(html_col)))

"""Main text of web pages by composite text density.

Every node of the page gets its characters per tag, lowered where the characters
are those of links. The node whose children have the greatest sum of densities
holds the article; the least density on its path up to the body is the threshold
that other subtrees must reach. They must also be as dense as the article and have
half of its density sum; where article or main elements say what belongs to the
article, the threshold is enough for parts in one, and others go. Lists of links
below the threshold go. Parts whose element says what they are (menus, forms and so on) are left
out before anything is counted, those whose class or id says so (adverts,
comments) unless they hold most of the text.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from collections import defaultdict
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element names of the HTML standard; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Blocks that hold a paragraph rather than paragraphs.
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd figcaption caption legend summary hr address".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
CLOSES_PARAGRAPH = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
# An element that starts closes an open one of these names, up to the element that may hold several of them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Never part of an article.
LEFT_OUT = frozenset(
    "nav footer aside form button select input label dialog menu svg canvas object audio video map head".split()
)
ARTICLE = frozenset({"article", "main"})
LEFT_OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split()
)
# Words of a class or an id that name such parts.
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored promo promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer sidebar sidebars aside widget "
    "widgets related share sharing social cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist disqus respond replies reply pagination pager "
    "toolbar copyright disclaimer".split()
)
# Words that make a name tell of a page's state or layout, not of the part: "has-sidebar", "share-enabled".
STATE_WORDS = frozenset(
    "has have with without no non not is enable enabled disable disabled show shows hide hides allow allows support "
    "supports open closed on off layout template".split()
)
# An article in one of these means that it was never closed, or encloses the page.
REOPENED = frozenset({"nav", "menu", "head", "header", "form"})
WHOLE_NAMES = frozenset({"header", "site-header", "page-header", "siteheader", "pageheader"})

#: Another part of an article that no element names has at least this share of the greatest density sum.
SMALLEST_PART = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+|\d+", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Page:
    """A page's elements in the order of their start tags, and its blocks of text."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.name: list[str] = ["body"]
        self.own_chars: list[int] = [0]
        self.own_links: list[int] = [0]
        self.link: list[bool] = [False]
        self.told: list[bool] = [False]  # its class or id names a part that is not the article's
        self.blocks: list[tuple[int, str]] = []  # the element where the block begins, and its text


def _left_out(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether the element is never part of an article, and whether its class or id says that it is none."""
    if name in LEFT_OUT or name == "header" and not in_article:
        return True, False
    if not attributes or attributes.isspace():
        return False, False
    told = False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return True, False
        if key == "role" and value in LEFT_OUT_ROLES:
            return True, False
        if key in ("class", "id") and name not in ARTICLE and name != "body":
            names = value.split()
            told = told or bool(WHOLE_NAMES.intersection(names)) and not in_article
            for one in names:
                words = _WORD.findall(one)
                told = told or bool(LEFT_OUT_WORDS.intersection(words)) and not STATE_WORDS.intersection(words)
    return False, told


def _without_told(page: _Page, pieces: list[list[tuple[int, str]]]) -> _Page:
    """The page without the parts that their names tell, and with its blocks.

    Such a part stays if it holds most of the text outside links, of its article
    or, if it is in none, of the page; but not if there is an article elsewhere.
    One without blocks, as an advert beside a line of text may be, must hold more
    than three quarters.
    """
    n = len(page.name)
    chars, links = _totals(page)
    held = [c - l for c, l in zip(chars, links)]
    around = [-1] * n  # the innermost article or main element around the node
    articles = [0] * n  # text in the outermost of these below the node
    blocks = [False] * n  # whether there are any below the node
    for node in range(1, n):
        up = page.parent[node]
        around[node] = up if page.name[up] in ARTICLE else around[up]
    for node in range(n - 1, 0, -1):
        blocks[page.parent[node]] |= blocks[node] or page.name[node] in BLOCK and held[node] > 0
        articles[page.parent[node]] += held[node] if page.name[node] in ARTICLE else articles[node]
    place = [0] * n
    kept = _Page()
    kept.own_chars[0], kept.own_links[0] = page.own_chars[0], page.own_links[0]
    for node in range(1, n):
        up = place[page.parent[node]]
        most = held[max(around[node], 0)] * (0.5 if blocks[node] else 0.75)
        elsewhere = around[node] < 0 and articles[0] > articles[node]
        if up < 0 or page.told[node] and (elsewhere or held[node] <= most):
            place[node] = -1
            continue
        place[node] = len(kept.name)
        kept.parent.append(up)
        for old, new in (
            (page.name, kept.name), (page.own_chars, kept.own_chars), (page.own_links, kept.own_links),
            (page.link, kept.link), (page.told, kept.told),
        ):
            new.append(old[node])
    for block in pieces:
        left = [(place[node], raw) for node, raw in block if place[node] >= 0]
        text = " ".join("".join(raw for _, raw in left).split())
        if text:
            kept.blocks.append((left[0][0], text))
    return kept


def parse(text: str) -> _Page:
    """The page without what is left out; open, crossed and missing tags are mended as browsers mostly do."""
    page = _Page()
    stack: list[tuple[str, int]] = [("body", 0)]  # name and node; node -1 for a part that is left out
    skipping = 0
    skipped_from = 0  # where in the stack the part that is left out begins
    # Where in the stack the open elements of each name are, and the blocks: no tag has to look through all of them.
    places: defaultdict[str, list[int]] = defaultdict(list)
    block_places = [0]
    blocks: list[list[tuple[int, str]]] = []
    pieces: list[tuple[int, str]] = []  # those of the open block, with their nodes

    def flush() -> None:
        if pieces:
            blocks.append(pieces.copy())
            pieces.clear()

    def add(raw: str) -> None:
        if "&" in raw:
            raw = entities.unescape(raw)
        pieces.append((stack[-1][1], raw))
        size = len("".join(raw.split()))
        if size:
            node = stack[-1][1]
            page.own_chars[node] += size
            if page.link[node]:
                page.own_links[node] += size

    def pop_to(depth: int) -> None:
        nonlocal skipping
        while len(stack) > depth:
            name, node = stack.pop()
            places[name].pop()
            if name in BLOCK:
                block_places.pop()
            if node < 0:
                skipping -= 1
            elif name in BLOCK:
                flush()

    def push(name: str, node: int) -> None:
        places[name].append(len(stack))
        if name in BLOCK:
            block_places.append(len(stack))
        stack.append((name, node))

    def innermost(names: Collection[str]) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((places[n][-1] for n in names if places[n]), default=0)

    at, size = 0, len(text)
    while at < size:
        mark = text.find("<", at)
        if mark < 0:
            mark = size
        token = _TOKEN.match(text, mark) if mark < size else None
        if token is None and mark < size:  # a lone "<" is text
            if not skipping:
                add(text[at:mark + 1])
            at = mark + 1
            continue
        if mark > at and not skipping:
            add(text[at:mark])
        if token is None:
            break
        at = token.end()
        closing, name, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if not name:
            if text.startswith("<![CDATA[", mark) and not skipping:
                add(entities.escape(text[mark + 9:at].removesuffix("]]>"), False))
            continue
        name = name.lower()
        if closing:
            if name in ("body", "html"):
                continue
            depth = innermost((name,))
            # An inline end tag does not close blocks.
            if depth and (name in BLOCK or name in LEFT_OUT or depth > block_places[-1]):
                pop_to(depth)
            continue
        if name in ("body", "html"):
            if skipping and stack[-1][0] == "head":
                pop_to(1)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]|\Z", re.I).search(text, at)
            at = end.end() if end.end() == size else text.find(">", end.start()) + 1 or size
            continue
        if name in ARTICLE and skipping:
            if stack[skipped_from][0] in REOPENED:
                pop_to(skipped_from)
        if name in BLOCK:
            if not skipping:
                flush()
            if name in CLOSES_PARAGRAPH and stack[block_places[-1]][0] == "p":
                pop_to(block_places[-1])
        if name in CLOSES:
            names, until = CLOSES[name]
            while (depth := innermost(names)) > innermost(until | ARTICLE):
                pop_to(depth)
                if name != "tr" or stack[-1][0] not in names:
                    break
        empty = name in VOID or attributes.endswith("/") and name not in BLOCK
        if skipping:
            if not empty:
                skipping += 1
                push(name, -1)
            continue
        left_out, told = _left_out(name, attributes, innermost(ARTICLE) > 0)
        if left_out:
            if name in BLOCK:
                flush()
            if not empty:
                skipping += 1
                skipped_from = len(stack)
                push(name, -1)
            continue
        parent = stack[-1][1]
        node = len(page.name)
        page.parent.append(parent)
        page.name.append(name)
        page.own_chars.append(0)
        page.own_links.append(0)
        page.link.append(name == "a" or page.link[parent])
        page.told.append(told)
        if empty:
            if name == "br" and pieces:
                pieces.append((parent, " "))
        else:
            push(name, node)
    pop_to(1)
    flush()
    return _without_told(page, blocks)


def _totals(page: _Page) -> tuple[list[int], list[int]]:
    """The characters of every node's subtree, and those of links among them."""
    chars, links = list(page.own_chars), list(page.own_links)
    for node in range(len(chars) - 1, 0, -1):  # children come after their parents
        chars[page.parent[node]] += chars[node]
        links[page.parent[node]] += links[node]
    return chars, links


def densities(page: _Page) -> tuple[list[float], list[float]]:
    """The composite text density of every node, and the sum of its children's.

    A node's own text counts in the sum as a child with one tag.
    """
    n = len(page.name)
    chars, links = _totals(page)
    tags, link_tags = [0] * n, [0] * n
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        tags[up] += tags[node] + 1
        link_tags[up] += link_tags[node] + page.link[node]
    share = links[0] / chars[0] if chars[0] else 0.0

    def density(c: int, lc: int, t: int, lt: int) -> float:
        if not c:
            return 0.0
        t = max(t, 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1e-9)) / math.log(base) if base > 1 else c / t

    own = [density(chars[i], links[i], tags[i], link_tags[i]) for i in range(n)]
    sums = [density(page.own_chars[i], page.own_links[i], 1, int(page.link[i])) for i in range(n)]
    for node in range(1, n):
        sums[page.parent[node]] += own[node]
    return own, sums


def _densest(page: _Page, sums: list[float], held: list[int]) -> int:
    """The node whose children have the greatest sum of densities.

    Where that is the body, or a wrapper of all text, the part in it that holds
    most of the text is taken instead: what stands beside it on the page, as
    headers and footers do, adds to the sum but is no part of the article.
    """
    # Paragraphs and what stands in a line are parts of an article, not one.
    holders = [i for i in range(len(page.name)) if page.name[i] in BLOCK - PARAGRAPH or not i]
    best = max(holders, key=lambda i: (sums[i], -i))
    most = {page.parent[i]: i for i in holders if i and 2 * held[i] > held[page.parent[i]]}
    while held[best] == held[0] and best in most:
        best = most[best]
    return best


def main_text(text: str) -> str:
    """The article's blocks, two newlines between them; empty if the page has none."""
    page = parse(text)
    if not page.blocks:
        return ""
    own, sums = densities(page)
    n = len(page.name)
    chars, links = _totals(page)
    best = _densest(page, sums, [c - l for c, l in zip(chars, links)])
    path = [best]
    while path[-1]:
        path.append(page.parent[path[-1]])
    threshold = min(own[i] for i in path)
    named = [False] * n  # inside an article or main element
    for node in range(1, n):
        named[node] = page.name[node] in ARTICLE or named[page.parent[node]]
    chosen = [False] * n
    chosen[best] = True
    leader = list(range(n))  # the node of each subtree with the greatest sum
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        if sums[leader[node]] > sums[leader[up]]:
            leader[up] = leader[node]
    around = set(path)
    for node in range(1, n):
        first = leader[node]
        if node in around or sums[first] <= 0 or own[node] < threshold or named[first] < named[best]:
            continue
        # Beside an article that no element names, another part has to be as dense as it is, and not far smaller.
        if named[first] or own[node] >= own[best] and sums[first] >= SMALLEST_PART * sums[best]:
            chosen[first] = True
    for node in range(1, n):
        linked = page.name[node] in BLOCK - PARAGRAPH and 2 * links[node] > chars[node] and own[node] < threshold
        chosen[node] = chosen[node] or chosen[page.parent[node]] and not linked
    return "\n\n".join(block for node, block in page.blocks if chosen[node])


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page's main text: ``key, url, text, n_chars``.

    A null or empty html, and a page without an article, gives an empty text.
    Rows that repeat are extracted each for itself; null keys and urls are passed
    on; other columns are ignored. A page is parsed in memory and alone.
    """

    def extract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(value.as_py() or "") for value in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["id", "url", "text", "n_chars"],
                )

    schema = (
        T.StructType().add("id", pages.schema[key].dataType).add("url", pages.schema[url].dataType)
        .add("text", "string").add("n_chars", "long")
    )
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(extract, schema).toDF(key, url, "text", "n_chars")

"""Main text of web pages by composite text density.

A page is parsed into a tree of elements. Every node gets a density: its characters per tag, adjusted for the
characters and tags that stand in links. The densities of a node's children add up to its density sum. The node with
the greatest sum holds the article; the least density on the path from the body to that node is the threshold that
decides which subtrees and texts beside the path belong to it; inside the innermost ``article`` or ``main`` around
the node parts that are mostly unlinked belong to it anyway and others count ``INSIDE`` times as dense, and such
elements beside the path count ``BESIDE_ARTICLE`` times. Elements that are never part of an article (menus, footers,
forms, scripts, adverts, notices, reader comments) are told by tag, role or class and take no part in the sums.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import releasing, small_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
CELL = frozenset(("td", "th", "table"))
#: An opening tag ends an open element of these kinds, within the nearest container.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
SCOPE = frozenset("article aside body div dl fieldset figure footer form header html main nav ol section table td th ul".split())
ASIDE = frozenset("nav footer aside form menu button select dialog head input option".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
#: Words of a class or id that name something beside the article.
BESIDE = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)
#: Marks that weigh in: how many times denser linked parts of the innermost one around the best node count, and others beside the path.
ARTICLE, INSIDE, BESIDE_ARTICLE = ("article", "main"), 64.0, 2.0
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*'|[\"'])*+)>|[!?][^<>]*>)", re.S)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: With these, a word of BESIDE names the element itself ("ad-slot", "comments-list"); with others, a trait of it ("has-sidebar").
PARTS = frozenset(
    "area bar block bottom box container content first footer header inner item items label last left links list main outer panel "
    "primary right secondary section slot top unit widget wrap wrapper".split()
)


class Node:
    __slots__ = ("tag", "up", "parts", "beside", "likely", "open", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, up: Node | None, beside: bool):
        self.tag, self.up, self.parts, self.beside = tag, up, [], beside
        self.likely = False
        #: How many elements of each kind are open inside the nearest table or cell.
        self.open: Counter[str] = Counter() if up is None or tag in CELL else up.open


def _beside(tag: str, attributes: str, inside_article: bool) -> bool | None:
    """Whether an element stands beside the article; None if it does unless it holds most of the page's plain text."""
    likely = False
    if tag in ASIDE:
        return True
    if tag == "header":  # of the page, not of the article
        return not inside_article
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    seen = set()
    for name, *values in ATTR.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "class" or name == "id":
            for token in value.split():
                if token.lower() in BESIDE:
                    return True
                if _compound(token):
                    likely = True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
    return None if likely else False


def _compound(token: str) -> bool:
    """Whether a class or id of several words names something beside the article: words of BESIDE and PARTS alone."""
    words = [w.lower() for w in WORD.findall(token)]
    return not BESIDE.isdisjoint(words) and BESIDE.union(PARTS).issuperset(words)


def parse(page: str) -> Node:
    """The tree of a page; parts of a node are texts (decoded) and nodes, in order."""
    root = Node("html", None, False)
    here, at, size = root, 0, len(page)
    low = None
    every = Counter({"html": 1})  # open elements by kind, anywhere

    def leave(node: Node, to: Node) -> Node:  # each element is left once, so closing costs no more than opening
        while node is not to:
            every[node.tag] -= 1
            node.up.open[node.tag] -= 1
            node = node.up
        return to

    add = lambda s: here.parts.append(html.unescape(s) if "&" in s else s)
    while True:
        m = TAG.search(page, at)
        if m is None:
            if at < size:
                add(page[at:])
            return root
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            node = here
            through = tag in SCOPE or tag in ("tr", "tbody", "thead")  # others do not close what is open outside a cell
            if not (every if through else here.open)[tag]:
                node = None
            while node is not None and node.tag != tag:
                node = node.up
            if node is not None and node.up is not None:
                here = leave(here, node.up)
            elif tag == "p":
                here.parts.append(Node("p", here, False))
            continue
        if tag in ("html", "body") and every[tag]:
            continue
        if tag in VOID:
            here.parts.append(Node(tag, here, tag in ASIDE))
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
            if len(low) != size:  # lower case may be longer in rare scripts
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = low.find(f"</{tag}", at)
            at = size if end < 0 else end
            here.parts.append(Node(tag, here, True))
            if end >= 0:
                close = page.find(">", end)
                at = size if close < 0 else close + 1
            continue
        ends = ENDS.get(tag) or (("p",) if tag in BLOCK else ())
        node, stop = here, None
        left = sum(every[e] for e in ends)
        while left and node.up is not None and (node.tag not in SCOPE or node.tag in ends):
            if node.tag in ends:
                stop = node
                left -= 1
            node = node.up
        if stop is not None:
            here = leave(here, stop.up)
        sure = _beside(tag, m[4], every["article"] + every["main"] > 0)
        new = Node(tag, here, sure is not False)
        new.likely = sure is None
        here.parts.append(new)
        every[tag] += 1
        here.open[tag] += 1
        here = new


def _path(node: Node | None):
    while node is not None:
        yield node
        node = node.up


def _keep_most(root: Node) -> None:
    """Elements that only likely stand beside the article stay if they hold most of the unlinked text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.parts if type(x) is Node and (x.likely or not x.beside)]
    if not any(n.likely for n in order):
        return
    for node in reversed(order):
        node.chars = 0
        if node.tag != "a":
            node.chars = sum(len(x.strip()) if type(x) is str else x.chars for x in node.parts if type(x) is str or x.likely or not x.beside)
    for node in order:
        if node.likely and 2 * node.chars > root.chars:
            node.beside = False


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density; ``ratio`` is the share of the page's characters that stand in links."""
    if not chars:
        return 0.0
    tags, links = max(tags, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e)
    gain = chars / max(link_chars, 1) * tags / links
    return chars / tags * max(math.log(max(gain, 1.0)) / math.log(base + 1), 0.0)


def _measure(root: Node) -> list[Node]:
    """Characters, tags and their linked parts of every node that may be content; children stand before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.parts if type(x) is Node and not x.beside]
    order.reverse()
    for node in order:
        chars = tags = link_chars = link_tags = 0
        total = 0.0
        for x in node.parts:
            if type(x) is str:
                chars += len(x.strip())
            elif not x.beside:
                chars, tags = chars + x.chars, tags + x.tags + 1
                link_chars, link_tags = link_chars + x.link_chars, link_tags + x.link_tags
                total += x.density
        if node.tag == "a":
            link_chars, link_tags = chars, link_tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags, node.sum = chars, tags, link_chars, link_tags, total
        node.density = chars / max(tags, 1)
    body = next((n for n in reversed(order) if n.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for node in order:
        if node.chars:
            node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
    for node in order:
        node.sum = sum(x.density for x in node.parts if type(x) is Node and not x.beside) or node.density * bool(node.chars) * 1e-6
    return order


def _gather(best: Node, out: list[str]) -> None:
    """The texts of ``best`` and, beside the path to it, of what is as dense as the sparsest part of that path.

    Of the parts of a node on the path, all from the first to the last of these stay, and headings just before them.
    """
    above = list(_path(best.up))
    body = next((k for k, n in enumerate(above) if n.tag == "body"), len(above) - 1)
    above = above[: body + 1]
    limit = min((n.density for n in above if n.tag != "html" and n.chars), default=0.0)
    limit = min(limit, best.density)
    marked = next((k for k, n in enumerate(above) if n.tag in ARTICLE), -1)
    need = {id(n): limit / (INSIDE if k <= marked else 1) for k, n in enumerate(above)}
    inside = {id(n) for n in above[: marked + 1]}
    top = above[-1] if above else best
    ratio = top.link_chars / max(top.chars, 1)
    stack: list = [top]
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
        elif not x.beside:
            if x.tag in BLOCK or x.tag == "br":
                out.append("\n")
                stack.append("\n")
            if (least := need.get(id(x))) is None:
                stack += reversed(x.parts)
                continue
            held = []
            for k, y in enumerate(x.parts):
                if type(y) is str:
                    dense = _density(len(y.strip()), 1, 0, 0, ratio)
                elif y.beside:
                    continue
                else:
                    dense = y.density * (BESIDE_ARTICLE if y.tag in ARTICLE else 1)
                full = bool(y.strip()) if type(y) is str else y.chars > 0
                plain = id(x) in inside and (type(y) is str or 2 * y.link_chars <= y.chars)
                if y is best or id(y) in need or full and (plain or dense >= least):
                    held.append(k)
            first = held[0]
            while first and (type(y := x.parts[first - 1]) is str and not y.strip() or type(y) is Node and (y.beside or not y.chars or y.tag in HEADING)):
                first -= 1
            stack += reversed(x.parts[first : held[-1] + 1])


def main_text(page: str | None) -> str:
    """The article of one page, blocks joined by one space; empty for a null or empty page."""
    if not page:
        return ""
    root = parse(page)
    _keep_most(root)
    order = _measure(root)
    best = max(reversed(order), key=lambda n: n.sum)  # of equals the one that stands higher
    out: list[str] = []
    _gather(best, out)
    return " ".join("".join(out).split())


def extracted(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` with ``text`` (never null) and ``n_chars``, its code points.

    White space inside a block becomes one space and blocks are joined by one space; nothing else is dropped or cut.
    Null or empty html gives an empty text. Pages are handled one by one; columns of those names are replaced.
    """
    small_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    names = pages.columns

    def run(batches):
        for batch in batches:
            texts = [main_text(x).encode("utf-8", "replace").decode() for x in batch.column("html").to_pylist()]
            columns = [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(releasing(run), f"{kinds}, text string, n_chars long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.col("n_chars").cast("long"))

"""Main text of web pages by composite text density.

A tolerant reader builds the node tree, in time linear in the page. For each node, the characters per tag are adjusted
for link text; the densities of its children are summed; the block with the largest sum holds the article, whatever its
tag or name. The smallest density on the way from that node to the body is the threshold by which content outside of it
is kept.

Before densities are taken, what is not the article is cut: by tags and roles (menus, headers, footers, sidebars, forms,
scripts, styles), by names that say what a part is (adverts, notices, comments), and by names that only hint at it
(shares, related links, widgets) where the part doesn't read like prose. A part that holds most of the page and its
heading is never cut.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.llm.store import table

_OTHER = re.compile(r"<!--(?:.*?--!?>|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>?", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of the values, up to the nearest element that holds such a list or the page.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table html body div section article main td th".split())
_ITEMS = _HOLDS | frozenset(t for tags in _CLOSES.values() for t in tags)
_CUT_TAGS = frozenset("head script style noscript template iframe noembed noframes object svg canvas button select textarea input dialog nav header footer aside form menu".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Names that say that a part is not the article.
_CUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|footer|masthead|"
    r"(?:site|page|top|main)-?header|comments?|comment-?list|disqus\w*|respond|replies)(?:$|[\s_-])",
    re.I,
)
#: Names that only hint at it.
_HINT_NAMES = re.compile(r"(?:^|[\s_-])(?:banner|share|sharing|social|related|recommend\w*|popup|modal|overlay|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])", re.I)
#: A part with a hint reads like prose with at least so many characters, also per tag, and less than a third of them in links.
PROSE_CHARS, PROSE_DENSITY = 140, 30
_WHOLE_NAMES = frozenset({"header", "aside", "side"})


class Node:
    __slots__ = ("block", "chars", "children", "cut", "density", "item", "link_chars", "link_tags", "open", "parent", "parts", "scope", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, cut: str = ""):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.block = tag in _BLOCK
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        #: The nearest block around, itself included, and the phrases that are open directly in it.
        self.scope: Node = self if self.block or parent is None else parent.scope
        self.open: dict[str, int] = {}
        #: The nearest element around, itself included, that matters for ``_CLOSES``.
        self.item: Node | None = self if tag in _ITEMS else parent.item if parent is not None else None


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_ATTRIBUTE.finditer(raw)))}


def boilerplate(tag: str, raw: str) -> str:
    """``"cut"`` by tag, role or name; ``"hint"`` by a name that only hints at it; else empty."""
    if tag in _CUT_TAGS:
        return "cut"
    if not raw.strip() or tag in ("html", "body"):
        return ""
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return "cut"
    if a.get("role", "").lower() in _CUT_ROLES:
        return "cut"
    names = [n for n in (a.get("class", ""), a.get("id", "")) if n]
    if any(_CUT_NAMES.search(n) or n.strip().lower() in _WHOLE_NAMES for n in names):
        return "cut"
    return "hint" if any(_HINT_NAMES.search(n) for n in names) else ""


def tag_end(source: str, pos: int) -> int:
    """Where the tag that is read at ``pos`` ends: after the next > outside quotes, else after the next >; 0 if there is none."""
    at = pos
    while m := _STOP.search(source, at):
        if m[0] == ">":
            return m.end()
        at = source.find(m[0], m.end()) + 1
        if not at:
            break
    return source.find(">", pos) + 1


def parse(source: str) -> Node:
    """The node tree of a page. Unclosed and stray tags are mended as browsers do, as far as the text is concerned. Open tags
    are counted and each is left once, so the time is linear also where end tags match nothing."""
    top = here = Node("#page", None)
    open_blocks: dict[str, int] = {}
    pos, n = 0, len(source)

    def enter(x: Node) -> None:
        nonlocal here
        count = open_blocks if x.block else x.scope.open
        count[x.tag] = count.get(x.tag, 0) + 1
        here = x

    def leave(x: Node) -> None:
        nonlocal here
        while True:
            y, here = here, here.parent
            (open_blocks if y.block else y.scope.open)[y.tag] -= 1
            if y is x:
                return

    def add(text: str) -> None:
        if text:
            here.parts.append(html.unescape(text) if "&" in text else text)

    last = source.rfind(">")
    while pos < n:
        at = source.find("<", pos)
        if at < 0 or at > last:  # no tag ends any more; an open comment hides the rest
            comment = source.find("<!--", pos)
            n = comment if comment >= 0 else n
            break
        add(source[pos:at])
        tag = _TAG.match(source, at)
        if tag is None:
            other = _OTHER.match(source, at)
            if other is None:  # a stray <
                add("<")
                pos = at + 1
                continue
            if other[0].startswith("<![CDATA["):
                add(other[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            pos = other.end()
            continue
        pos = tag_end(source, tag.end())
        name, raw = tag[2].lower(), source[tag.end() : pos - 1]
        if tag[1]:
            # an end tag of a phrase doesn't close blocks around it
            if (open_blocks if name in _BLOCK else here.scope.open).get(name):
                x = here
                while x.tag != name:
                    x = x.parent
                leave(x)
            continue
        if name in _BLOCK and name not in ("option", "optgroup") and here.scope.tag == "p":
            leave(here.scope)  # a block ends an open paragraph
        if name in _CLOSES:
            x = here.item
            while x is not None and x.tag not in _CLOSES[name] and x.tag not in _HOLDS:
                x = x.parent.item
            while x is not None and x.tag in _CLOSES[name]:
                leave(x)
                x = here
        if name in ("html", "body") and here is not top:
            x = here
            while x.parent is not top:
                x = x.parent
            leave(x)
        node = Node(name, here, boilerplate(name, raw))
        here.parts.append(node)
        here.children.append(node)
        if name in _VOID or raw.rstrip().endswith("/") and name not in _BLOCK and name not in _RAW:
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, pos)
            node.cut = "cut"
            pos = end.end() if end else n
            continue
        enter(node)
    add(source[pos:n])
    return top


def measure(top: Node) -> tuple[Node, list[Node]]:
    """Counts, densities and sums of all nodes but the cut ones; (the body, all kept nodes in page order)."""
    every: list[Node] = []
    stack = [top]
    while stack:
        x = stack.pop()
        every.append(x)
        stack.extend(c for c in x.children if c.tag not in _CUT_TAGS and c.tag not in _RAW)
    held: dict[int, list[int]] = {id(x): [0, 0, 0] for x in every}  # characters, those in links, tags
    heads: set[int] = set()
    for x in reversed(every):
        own = held[id(x)]
        if x.tag in ("article", "main", "h1") or id(x) in heads:
            heads.add(id(x.parent))
        own[0] += sum(len(p) for p in x.parts if isinstance(p, str))
        if x.tag == "a":
            own[1] = own[0]
        if x.parent is not None:
            up = held[id(x.parent)]
            up[0], up[1], up[2] = up[0] + own[0], up[1] + own[1], up[2] + own[2] + 1
    for x in every:
        chars, links, tags = held[id(x)]
        if x.cut == "hint":
            x.cut = "" if chars >= max(PROSE_CHARS, PROSE_DENSITY * tags) and 3 * links < chars else "cut"
        # a wrapper of most of the page and of its main heading is not what its name says
        if x.cut and id(x) in heads and 2 * chars > held[id(top)][0]:
            x.cut = ""
    order: list[Node] = []
    stack = [top]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in reversed(x.children) if not c.cut)
    for x in reversed(order):
        own = sum(len("".join(p.split())) for p in x.parts if isinstance(p, str))
        x.chars += own
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.link_chars += x.link_chars
            x.parent.tags += x.tags + 1
            x.parent.link_tags += x.link_tags
    body = next((x for x in order if x.tag == "body"), top)
    ratio = body.link_chars / max(1, body.chars)
    for x in order:
        c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, x.link_tags
        if c == 0:
            continue
        base = math.log(c * lc / max(1, c - lc) + ratio * c + math.e)
        x.density = c / t * math.log(max(1.0 + 1e-9, c / max(1, lc) * t / max(1, lt))) / math.log(max(base, 1.0 + 1e-9)) if c > t else c / t * 1e-3
    for x in order:
        if x.parent is not None:
            x.parent.sum += x.density
    return body, order


def content(top: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    body, order = measure(top)
    place = {id(x): i for i, x in enumerate(order)}
    last = list(range(len(order)))
    for i in range(len(order) - 1, 0, -1):
        up = place[id(order[i].parent)]
        last[up] = max(last[up], last[i])

    def inside(x: Node, holder: Node) -> bool:
        i = place[id(holder)]
        return i <= place[id(x)] <= last[i]

    if body.chars == 0:
        return [top] if top.chars else []
    within = order[place[id(body)] : last[place[id(body)]] + 1]
    best = max((x for x in within if x.block or x is body), key=lambda x: x.sum)
    if best.sum == 0:
        return [body]
    least, x = best.density, best
    while x is not body and x.parent is not None:
        x = x.parent
        least = min(least, x.density)

    def largest(x: Node) -> Node:
        return max(order[place[id(x)] : last[place[id(x)]] + 1], key=lambda y: y.sum)

    marked = [best]
    stack = [c for c in body.children if not c.cut]
    while stack:
        x = stack.pop()
        if x.density >= least and x.block and x.link_chars < 0.5 * x.chars and not inside(best, x) and not inside(x, best):
            top_of = largest(x)
            marked.append(top_of if top_of.sum > 0 else x)
        elif x is not best:
            stack.extend(c for c in x.children if not c.cut)
    if len(marked) > 1:
        # sections of one article lie in one node; its other blocks, however short, belong to it
        lo, hi = min(place[id(m)] for m in marked), max(last[place[id(m)]] for m in marked)
        common = best
        while not (place[id(common)] <= lo and hi <= last[place[id(common)]]):
            common = common.parent
        if common is not body and common is not top and common.tag != "html":
            return [common]
    elif best is body and body.parent is not None:
        return [body]
    # a heading or short blocks right beside the densest node, in a node of their own; lists of links beside it end this
    while len(marked) == 1 and best.parent is not None and best.parent is not body and best.parent.tag not in ("html", "#page"):
        beside = [c for c in best.parent.children if c is not best and not c.cut]
        if any(c.link_tags > 1 and 2 * c.link_chars > c.chars for c in beside):
            break
        best = best.parent
        marked = [best]
    return sorted(marked, key=lambda x: place[id(x)])


def blocks(node: Node) -> Iterator[str]:
    """The texts of the blocks below a node, in page order; white space is one space, blank blocks are left out."""
    run: list[str] = []

    def text() -> str:
        return " ".join("".join(run).split())

    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            if t := text():
                yield t
            run.clear()
        elif x.tag == "br":
            run.append(" ")
        elif not (x.cut and x is not node):
            if x.block:
                if t := text():
                    yield t
                run.clear()
                stack.append(None)
            stack.extend(reversed(x.parts))
    if t := text():
        yield t


def main_text(source: str | None) -> str:
    """The article of a page, its blocks joined by two line breaks; empty for null, empty and textless pages."""
    if not source:
        return ""
    return "\n\n".join(b for node in content(parse(source)) for b in blocks(node))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) in place of the ``html`` column; columns of these names are
    replaced, others are carried and not read.

    A page that is null, empty or has no text outside of boilerplate gives an empty text and 0. Whole pages are read, in
    time linear in their length. Of equally dense nodes the first of the page is taken. Each row stands for itself, so
    repeated rows repeat their result; an empty table gives an empty one.
    """

    def scan(sources: pa.Array) -> pa.Array:
        texts = [main_text(x.as_py()) for x in sources]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "n_chars"])

    got = F.arrow_udf(scan, "text string, n_chars long")(pages[column].cast("string"))
    return pages.select(*[pages[c] for c in pages.columns if c not in (column, "text", "n_chars")], got["text"].alias("text"), got["n_chars"].alias("n_chars"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages`` from its whole html. Null or textless html: empty text. Repeated rows each give their
    row; an empty table gives an empty result; extra columns are not read."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

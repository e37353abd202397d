"""Main text of web pages by composite text density.

A page is parsed into a tree of elements in time linear in its length. For
every node, characters per tag are adjusted by the links (composite text
density), and a node's density sum adds the densities of its child blocks. The
block with the largest sum is the centre of the article; the smallest density
on its path to the body is the threshold, and every block that reaches it
contributes the subtree of largest sum inside it. What the densities do not
select is not part of the text, whatever its name.

Two things are known without densities. Elements that HTML itself sets apart
from the article (menus, page headers and footers, sidebars, forms, scripts,
hidden parts) are not candidates and add nothing to counts. Inside what the
densities selected, lists of links below the threshold go, and so do parts
whose class or id names an advert, a notice or comments; but no such name
removes the centre or anything that holds it. Where the densest text lies under
such a name, the name stands only if the rest of the page holds text of its
own, ``OTHER_TEXT`` of what is under the name or more: comments longer than an
article stay out, and a wrapper named after a sidebar stays in.

Character references are decoded; inside a block white space becomes one space;
blocks are trimmed and joined in page order by a blank line. Null and empty
pages, and pages without text, give an empty text; an empty table gives an
empty result. Of equal sums the outermost, then the first block is the centre.
Unclosed, misnested and unknown tags are taken as they come; an unclosed
comment or script runs to the end of the page, and a tag that is never closed
is text. Pages are read whole, of any length. Columns other than the three named
are ignored; repeated rows each get a result.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements without content, with raw content, and of block level.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html".split())
#: Opening the key ends an open element of the values, up to the stops.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
#: Elements that are never part of the article.
OUTSIDE = frozenset("nav aside footer form button select option input textarea label fieldset dialog menu script style noscript template iframe svg math object embed applet canvas head title noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar tablist toolbar".split())
#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register comment comments commentlist disqus respond reply replies related recommended recommendations share sharing social toolbar pagination pager widget widgets skip hidden copyright disclaimer paywall".split()
)
#: Words that stand beside them in such names; any other word makes it the name of something else.
FRAME = frozenset(
    "site page main global post article blog user reader readers box wrapper wrap container inner outer list section block area zone unit slot group panel pane column col row item items link links bar button buttons icons thread content text title header heading head body top bottom left right upper lower primary secondary mobile desktop sticky fixed floating inline dfp google wp div module latest posts stories articles form field input count the of and for policy message msg".split()
)
#: Text outside a part named by MARKS, as a share of the text in it, from which on the name counts against the densest text.
OTHER_TEXT = 0.2
#: So many links make a block below the threshold a list of links.
LINK_LIST = 3

_QUOTE_OR_END = re.compile(r"[\"'>]")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element with its children: nodes, and strings of decoded text."""

    __slots__ = ("tag", "parent", "marked", "children", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None = None, marked: bool = False):
        self.tag, self.parent, self.marked = tag, parent, marked
        self.children: list = []


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    for m in _ATTRIBUTE.finditer(text):
        yield m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")


def _named(value: str) -> bool:
    """Whether a class or id names something beside the article: one of MARKS, with words of FRAME at most."""
    for token in value.split():
        found = [w for w in _WORD.findall(_CAMEL.sub(" ", token).lower()) if len(w) > 1]
        if not MARKS.isdisjoint(found) and all(w in MARKS or w in FRAME for w in found):
            return True
    return False


def _apart(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether HTML itself sets an element apart from the article, and whether its class or id does."""
    if tag in OUTSIDE or (tag == "header" and not inside_article):
        return True, False
    named = False
    if attributes and not attributes.isspace():
        for name, value in _attributes(attributes):
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES) or (name == "style" and _HIDES.search(value)):
                return True, False
            named |= name in ("class", "id") and _named(value)
    return False, named and tag not in ("body", "html", "article", "main")


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page's pieces: text, start and end tags. Comments and raw content are left out.

    No part of the page is scanned more than a fixed number of times: a search
    that comes to the end without success is not made again.
    """
    at, n = 0, len(page)
    quoted, open_raw = True, set()
    while at < n:
        start = page.find("<", at)
        if start < 0:
            break
        name = _NAME.match(page, start + 2 if page.startswith("/", start + 1) else start + 1)
        if not name:
            if page.startswith(("!", "?"), start + 1) or page.startswith("/", start + 1):
                if start > at:
                    yield "text", "", page[at:start]
                if page.startswith("<!--", start):
                    end = start + 4 if page.startswith(">", start + 4) else page.find("-->", start + 4)
                    at = n if end < 0 else end + (1 if end == start + 4 and page[end] == ">" else 3)
                else:
                    end = page.find(">", start)
                    at = n if end < 0 else end + 1
            else:
                yield "text", "", page[at : start + 1]
                at = start + 1
            continue
        end = name.end()
        while quoted and (stop := _QUOTE_OR_END.search(page, end)):
            if stop[0] == ">":
                end = stop.start()
                break
            close = page.find(stop[0], stop.end())
            if close < 0:
                quoted = False  # such a quote is never closed: quotes no longer count
            end = close + 1
        else:
            if quoted:  # a quote holds every end of a tag that is left
                quoted = False
            end = page.find(">", name.end())
            if end < 0:
                break  # no tag ends any more
        if start > at:
            yield "text", "", page[at:start]
        tag, rest = name[0].lower(), page[name.end() : end]
        at = end + 1
        if page.startswith("/", start + 1):
            yield "end", tag, ""
            continue
        if tag in RAW and not rest.endswith("/"):
            if tag in open_raw:
                stop = None
            elif not (stop := re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)):
                open_raw.add(tag)
            close = page.find(">", stop.end()) if stop else -1
            if close >= 0 or tag in ("script", "style", "textarea", "title"):
                at = close + 1 if close >= 0 else n
            continue
        yield "start", tag, rest
    if at < n:
        yield "text", "", page[at:]


def parse(page: str) -> Node:
    """The tree of the page's candidates; text keeps its white space, references are decoded."""
    root = Node("html")
    stack: list[Node | None] = [root]  # None: an open element inside a part that is set apart
    names = ["html"]
    places: dict[str, list[int]] = defaultdict(list)  # where each name stands in the stack
    blocks = [0]
    apart = 0  # depth of the outermost part that is set apart

    def close(k: int) -> None:
        nonlocal apart
        while len(stack) > k:
            stack.pop()
            places[names.pop()].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
        if apart and len(stack) <= apart:
            apart = 0

    def top(tags: str) -> int:
        return max((places[t][-1] for t in tags.split() if places[t]), default=-1)

    for kind, tag, rest in _pieces(page):
        if kind == "text":
            if not apart:
                stack[-1].children.append(html.unescape(rest))
            continue
        if kind == "end":
            if places[tag] and (tag in BLOCK or places[tag][-1] > blocks[-1]):  # an inline end tag does not close a block
                close(places[tag][-1])
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P and names[blocks[-1]] == "p":
            close(blocks[-1])
        if tag in ENDS:
            ends, stops = ENDS[tag]
            floor = top(stops)
            if top(ends) > floor:
                close(top(ends) if tag != "tr" else min(p[k] for t in ends.split() if (p := places[t]) and (k := bisect_right(p, floor)) < len(p)))
        closed = tag in VOID or (rest.endswith("/") and tag not in BLOCK)
        if apart:
            node = None
        else:
            out, marked = _apart(tag, rest, bool(places["article"] or places["main"]))
            if out:
                if tag in BLOCK:
                    stack[-1].children.append(Node("hr", stack[-1]))  # blocks on both sides stay apart
                node = None
                apart = 0 if closed else len(stack)
            else:
                node = Node(tag, stack[-1], marked)
                stack[-1].children.append(node)
        if not closed:
            places[tag].append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            names.append(tag)
            stack.append(node)
    return root


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body: float) -> float:
    """Composite text density: characters per tag, less where they are links. ``body``: share of link characters in the page."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body * chars + math.e)
    return chars / max(1, tags) * math.log(max(1.0, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / base


def _measure(root: Node, skip: frozenset[int] | set[int] = frozenset()) -> list[Node]:
    """Counts, densities and density sums of every node outside ``skip`` (ids of nodes); those nodes, parents first.

    Text and inline elements that stand directly in a block are one child of it.
    """
    order = [root]
    for node in order:
        order += [x for x in node.children if isinstance(x, Node) and id(x) not in skip]
    own: dict[int, list[int]] = {}
    for node in reversed(order):
        block, inline = [0, 0, 0, 0], [0, 0, 0, 0]
        for child in node.children:
            if isinstance(child, str):
                inline[0] += len("".join(child.split()))
            elif id(child) not in skip:
                to = block if child.tag in BLOCK else inline
                for k, x in enumerate((child.chars, child.tags + 1, child.link_chars, child.link_tags + (child.tag == "a"))):
                    to[k] += x
        own[id(node)] = inline
        node.chars, node.tags, node.link_chars, node.link_tags = (x + y for x, y in zip(block, inline, strict=True))
        if node.tag == "a":
            node.link_chars = node.chars
    body = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, body)
        node.total = _density(*own[id(node)], body) + sum(x.density for x in node.children if isinstance(x, Node) and x.tag in BLOCK and id(x) not in skip)
    return order


def _centre(order: list[Node]) -> Node:
    """The block of the largest density sum."""
    return max((n for n in order if n.tag in BLOCK), key=lambda n: n.total)


def _above(node: Node | None) -> Iterator[Node]:
    """The node and what holds it, up to the root."""
    while node is not None:
        yield node
        node = node.parent


def _threshold(centre: Node) -> float:
    """The smallest density on the path from the centre to the body."""
    return min(n.density for n in _above(centre))


def select(root: Node) -> tuple[list[Node], Node, set[int]]:
    """Roots of the subtrees that make up the article in page order, the centre, and the ids of lists of links."""
    order = _measure(root)
    centre = _centre(order)
    names = [n for n in _above(centre) if n.marked]
    beside: set[int] = set()
    if names:
        under = names[-1].chars - names[-1].link_chars
        beside = {id(n) for n in order if n.marked}
        order = _measure(root, beside)
        if root.chars - root.link_chars >= OTHER_TEXT * under:
            centre = _centre(order)
        else:
            for node in names:
                node.marked = False
            beside = set()
            order = _measure(root)
    # Lists of links would lower the densities of all that holds them.
    least, held = _threshold(centre), {id(n) for n in _above(centre)}
    lists = {id(n) for n in order if n.tag in BLOCK and n.link_tags >= LINK_LIST and n.density < least and 2 * n.link_chars >= n.chars and id(n) not in held}
    if lists:
        order = _measure(root, beside | lists)
        centre = _centre(order)
    threshold = _threshold(centre)
    best: dict[int, Node] = {}  # block of largest sum in each subtree
    for node in reversed(order):
        top = node
        for child in node.children:
            if isinstance(child, Node) and (low := best.get(id(child))) and low.tag in BLOCK and low.total > top.total:
                top = low
        best[id(node)] = top
    chosen = {id(best[id(n)]) for n in order if n.tag in BLOCK and n.density >= threshold and n.chars and n is not root}
    chosen.add(id(centre))
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if id(node) in chosen:
            out.append(node)
        else:
            todo += [x for x in reversed(node.children) if isinstance(x, Node)]
    return out, centre, lists


def _prune(tops: list[Node], centre: Node, lists: set[int]) -> list[Node]:
    """What was selected without adverts, notices and comments by name, and without lists of links; whatever holds the centre stays."""
    held = {id(n) for n in _above(centre)}

    def goes(node: Node) -> bool:
        return id(node) not in held and (node.marked or id(node) in lists)

    tops = [n for n in tops if not any(goes(x) for x in _above(n))]
    todo = list(tops)
    while todo:
        node = todo.pop()
        for k, child in enumerate(node.children):
            if isinstance(child, Node):
                if goes(child):
                    node.children[k] = Node("hr" if child.tag in BLOCK else "span", node)
                else:
                    todo.append(child)
    return tops


def blocks_of(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under the nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            elif item.tag == "br":
                run.append(" ")
            elif item.tag in BLOCK:
                flush()
                todo.append(None)
                todo += reversed(item.children)
            else:
                todo += reversed(item.children)
        flush()
    return out


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    return "\n\n".join(blocks_of(_prune(*select(parse(page)))))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")

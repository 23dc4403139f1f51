"""Main text of web pages by composite text density.

A page is parsed into a tree, forgivingly.  Parts that are never article text (menus,
page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) are known by their elements, roles and names, and hold no text.  Every
other node gets its composite density: characters for each tag, adjusted by how many
of the characters and tags are links'.  A node's density sum is its children's
densities added up; elements inside a line (bold, links, line breaks) are text of
their block and no children of their own here.  The threshold is the least density on
the path from the densest node to the body.  The subtree with the largest density sum
is main text, and so is what lies beside its path to the body and reaches the
threshold.  An article or main element around the subtree is taken whole if it reaches
the threshold itself; pages without one are read by densities alone.

Null and empty pages, and pages without text, give an empty text.  Blocks keep page
order, white space inside a block becomes one space, and two newlines join blocks.
Rows that repeat, or whose page_id is null, give a result each; an empty table gives none.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import pieces

# Element names of HTML by what they do.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript noembed noframes iframe xmp template".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOT_TEXT = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map nav menu aside footer form button input select textarea "
    "dialog noembed noframes datalist".split()
)
#: A start tag of the first kind ends open elements of the second, up to a boundary of the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
_P_ENDS = _BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "optgroup", "option"}
_P_BOUNDS = frozenset("td th table button article section div li blockquote main body html dd dt figure figcaption aside nav header footer form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that name a part which isn't the article.
_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent "
    "disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup "
    "promo promoted promotion related recommended rail replies respond share sharing shareaddthis sidebar sidebars signup skip social sponsor sponsored "
    "sponsors subscribe subscription toolbar widget widgets".split()
)

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACES = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("block", "chars", "children", "density", "link_chars", "link_tags", "skip", "tag", "tags", "total")

    def __init__(self, tag: str, skip: int = 0):
        self.tag, self.skip = tag, skip
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = tag in _BLOCKS


#: Why a node holds no article text: what it is, or only what it is called.
KNOWN, NAMED = 1, 2


def _not_article(tag: str, attributes: str, inside: bool) -> int:
    if tag in _NOT_TEXT or tag == "header" and not inside:
        return KNOWN
    if not attributes or tag in ("body", "html", "article", "main"):
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in _ROLES:
            return KNOWN
        if key in ("class", "id") and any(w.lower() in _NAMES for w in _NAME.findall(_CAMEL.sub(" ", value))):
            found = NAMED
    return found


def _restore(body: Node) -> None:
    """Parts that are left out by their names alone come back if they hold an article, or most of the text.

    So a wrapper called `has-sidebar` isn't taken for a sidebar.
    """
    order, todo = [], [body]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and c.skip != KNOWN]
    if all(x.skip != NAMED for x in order):
        return
    size: dict[int, int] = {}
    holds: set[int] = set()
    for node in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node) and c.skip != KNOWN]
        size[id(node)] = sum(size[id(c)] for c in inner) + sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if any(c.tag in ("article", "main") or id(c) in holds for c in inner):
            holds.add(id(node))
    for node in order:
        if node.skip == NAMED and (id(node) in holds or 2 * size[id(node)] > size[id(body)]):
            node.skip = 0


def parse(source: str) -> Node:
    """The page's tree. Unclosed, stray and misnested tags are put right as far as blocks go."""
    root = Node("html")
    stack = [root]
    at, n = 0, len(source)
    depth = 0  # of article and main
    opened: dict[str, list[int]] = {}  # where in the stack the elements of each name are
    blocks_at: list[int] = []  # where in the stack the blocks are

    def push(node: Node) -> None:
        nonlocal depth
        opened.setdefault(node.tag, []).append(len(stack))
        if node.block:
            blocks_at.append(len(stack))
        depth += node.tag in ("article", "main")
        stack.append(node)

    def pop_to(k: int) -> None:
        nonlocal depth
        for x in stack[k:]:
            depth -= x.tag in ("article", "main")
            opened[x.tag].pop()
        while blocks_at and blocks_at[-1] >= k:
            blocks_at.pop()
        del stack[k:]

    def highest(tags) -> int:
        """Where in the stack the innermost open element of these names is; 0 if none."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    while at < n:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else n
        if stop > at:
            stack[-1].children.append(html.unescape(source[at:stop]))
        if m is None:
            break
        at = m.end()
        slash, tag, rest = m[1], m[2], m[3]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
                continue
            loose = _LOOSE.match(m[0])
            if not loose:
                continue
            slash, tag, rest = loose[1], loose[2], m[0][loose.end() : -1]
        tag = tag.lower()
        if slash:
            k = highest((tag,))
            # An inline end tag doesn't end a block.
            if k and (tag in _BLOCKS or not blocks_at or blocks_at[-1] < k):
                pop_to(k)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not opened.get("body"):
                pop_to(1)
                stack[-1].children.append(node := Node("body"))
                push(node)
            continue
        if tag in _P_ENDS:
            k = highest(("p",))
            if k > highest(_P_BOUNDS):
                pop_to(k)
        if tag in _CLOSES:
            ends, bounds = _CLOSES[tag]
            edge = highest(bounds)
            lowest = min((x for t in ends for x in opened.get(t, ()) if x > edge), default=0)
            if lowest:
                pop_to(lowest)
        if tag == "head" and opened.get("body"):
            continue
        if stack[-1].tag == "head" and tag not in _RAW and tag not in _VOID:
            pop_to(len(stack) - 1)
        node = Node(tag, _not_article(tag, rest, depth > 0))
        stack[-1].children.append(node)
        if tag in _VOID or rest.endswith("/") and tag not in _BLOCKS:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            node.skip = KNOWN
            continue
        push(node)
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that may hold text, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.skip]
    return out


def measure(body: Node) -> list[Node]:
    """Counts, composite densities and density sums, children first; the nodes, parents first."""
    nodes = _walk(body)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACES.sub(" ", c).strip())
            elif not c.skip:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
                node.block |= c.block
        if node.tag == "a":
            node.link_chars = node.chars
    whole, linked = max(1, body.chars), body.link_chars
    for node in nodes:
        if node.chars:
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + linked / whole * node.chars + math.e)
            ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.density = node.chars / max(1, node.tags) * max(0.0, math.log(max(ratio, 1e-9)) / base)
    for node in nodes:
        inner = [c.density for c in node.children if isinstance(c, Node) and not c.skip and c.block]
        node.total = sum(inner)
        if not inner or any(c.strip() if isinstance(c, str) else c.chars and not c.skip and not c.block for c in node.children):
            node.total = max(node.total, node.density)  # text of its own counts as a child
    return nodes


def _find(root: Node, tag: str) -> Node | None:
    return next((x for x in _walk(root) if x.tag == tag), None)


def select(body: Node) -> list[Node]:
    """Subtrees of main text, in page order."""
    nodes = measure(body)
    parents = {id(c): x for x in nodes for c in x.children if isinstance(c, Node)}
    densest = max(nodes, key=lambda x: x.density)
    threshold, at = densest.density, densest
    while at is not body:
        at = parents[id(at)]
        threshold = min(threshold, at.density)
    best: list[Node] = []

    def largest(top: Node) -> Node:
        return max((x for x in _walk(top) if x.block or x is top), key=lambda x: x.total)

    chief = largest(body)
    up = chief
    while up is not body:  # an article is one whole
        if up.tag in ("article", "main") and up.density >= threshold:
            chief = up
        up = parents[id(up)]
    # The chief subtree, and what lies beside its path to the body and is as dense.
    taken = {id(chief)}
    at = chief
    while at is not body:
        parent = parents[id(at)]
        for c in parent.children:
            if isinstance(c, Node) and not c.skip and c is not at and c.chars and c.density >= threshold:
                taken.add(id(c if c.tag not in ("div", "section") else largest(c)))
        at = parent
    for x in nodes:
        if id(x) in taken:
            best.append(x)
    return best


def blocks(nodes: list[Node]) -> list[str]:
    """The blocks' texts in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _SPACES.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo: list[tuple[Node | str | None, bool]] = [(top, False)]
        while todo:
            node, headed = todo.pop()
            if node is None:
                end()
            elif isinstance(node, str):
                if not headed:
                    line.append(node)
            elif node.skip:
                continue
            elif node.tag == "br":
                line.append(" ")
            else:
                block = node.tag in _BLOCKS
                # Of a header inside an article only the headings are its text.
                headed = node.tag == "header" or headed and node.tag not in _HEADINGS
                if block:
                    end()
                    todo.append((None, False))
                todo += [(c, headed) for c in reversed(node.children)]
        end()
    return out


def main_text(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source.replace("\x00", ""))
    body = _find(root, "body") or root
    if body is root:
        root.children = [c for c in root.children if isinstance(c, str) or c.tag != "head"]
    _restore(body)
    found = select(body)
    return "\n\n".join(blocks(found))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; other columns are left out."""

    def run(batches):
        for b in pieces(batches):
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")

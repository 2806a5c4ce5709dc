"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("br caption option optgroup summary tbody td tfoot th thead tr html body title".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
FENCES = frozenset("table ul ol dl select menu".split())
# Elements whose content is not text of the page.
NEVER = frozenset("script style noscript template head title button select textarea input label datalist iframe object embed applet canvas svg math audio video map dialog noembed noframes".split())
# Elements that stand around an article. (A form may hold one: some servers put the whole page into one.)
BESIDE = frozenset("nav aside footer menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what stands around an article, unless the element holds the article.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " nav navbar navigation menu submenu breadcrumb breadcrumbs toolbar pagination pager sidebar aside rail widget widgets header masthead topbar footer copyright colophon"
    " comment comments commentlist disqus reply replies respond responses discussion talkback guestbook share sharing related recommended recommendations newsletter subscribe subscription"
    " signup login search searchform skip".split()
)
#: Those of them that count for article elements too.
NOT_ARTICLES = frozenset("comment comments reply related ad advert promo sponsored".split())
LIFTS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are a paragraph or several by themselves, even without elements in them.
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
#: Parts of a block, which is what is chosen.
INNER = HEADINGS | frozenset("p li dd dt blockquote pre td th tr tbody thead tfoot ul ol dl table figure figcaption caption".split())
#: Blocks in which a start tag looks for an open paragraph to end.
HOLDS_P = frozenset("p div section article td th li body main form button".split()) | FENCES

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)", re.I)
NAME = re.compile(r"[a-z]+|\d+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "never", "around", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, never: bool = False, around: bool = False, named: bool = False):
        self.tag, self.parent, self.never, self.around, self.named = tag, parent, never, around, named
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_hidden(tag: str, attributes: str) -> bool:
    """Whether a page does not show the element."""
    if tag in NEVER:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def _is_beside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element says that it stands beside the article."""
    if tag in BESIDE or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    return any(m[1].lower() == "role" and unescape(m[2] or m[3] or m[4] or "").lower() in ROLES for m in ATTRIBUTE.finditer(attributes))


def _is_named(tag: str, attributes: str) -> bool:
    """Whether a class, an id or being a form says that an element stands around the article; ``_settle`` has the last word."""
    if tag == "form":
        return True
    if not attributes or tag in ("html", "body", "main", "h1"):
        return False
    words = NOT_ARTICLES if tag == "article" else AROUND
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
        if (name == "role" and value == "form") or (name in ("class", "id") and not words.isdisjoint(NAME.findall(value))):
            return True
    return False


def _settle(root: Node) -> None:
    """Named elements are around the article unless they hold it.

    One holds it that has a main or h1 element or the longest article element in it. On a page without main and article
    elements, one does too that has most of the plain text (text outside links), if more than stands outside named elements
    is in it and not in named elements of its own, as each of many comments is.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str) and not c.around and not c.never)
    named = [n for n in order if n.named]
    if not named:
        return
    articles = [n for n in order if n.tag == "article" and not n.named]
    holds = [n for n in order if n.tag in ("main", "h1")]
    told = bool(articles) or any(n.tag == "main" for n in holds)
    if len(articles) > 1 or not told:
        plain, inner = _plain(order)
    holds += [max(articles, key=lambda n: plain[id(n)])] if len(articles) > 1 else articles
    marked: set[int] = set()
    for node in holds:
        while node is not None and id(node) not in marked:
            marked.add(id(node))
            node = node.parent
    for node in named:
        node.around = id(node) not in marked
    if told:
        return
    above: dict[int, Node] = {}  # the named element, or the page, that an element is in
    outside = {id(root): inner[id(root)]}  # text of those that an element is in, but not in other named ones
    for node in order[1:]:
        above[id(node)] = node.parent if node.parent.named else above.get(id(node.parent), root)
        if node.named:
            outside[id(node)] = outside[id(above[id(node)])] + inner[id(node)]
    for node in reversed(named):
        up = above[id(node)]
        if 2 * plain[id(node)] > plain[id(root)] and inner[id(node)] > outside[id(up)]:
            node.around = False
        if not node.around:
            inner[id(up)] += inner[id(node)]


def _plain(order: list[Node]) -> tuple[dict[int, int], dict[int, int]]:
    """Text outside links in every node of ``order`` (parents first), and how much of it is in no named element of the node."""
    plain: dict[int, int] = {}
    inner: dict[int, int] = {}
    for node in reversed(order):
        all_text = own_text = 0
        if node.tag != "a":
            for c in node.children:
                if isinstance(c, str):
                    size = len(SPACE.sub(" ", c).strip())
                    all_text, own_text = all_text + size, own_text + size
                elif not c.around and not c.never:
                    all_text += plain[id(c)]
                    own_text += 0 if c.named else inner[id(c)]
        plain[id(node)], inner[id(node)] = all_text, own_text
    return plain, inner


class _Open:
    """The open elements of a page that is read, and what of them is asked again and again, so that no tag walks up the page."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.count: Counter[str] = Counter()
        self.holds_p = [0]  # places of the elements that a paragraph does not cross
        self.inline: list[Counter[str]] = [Counter()]  # inline elements open since each block
        self.fences: list[dict[str, int]] = [{}]  # place of the outermost li, dt, ... since each list or table
        self.tables: list[dict[str, int]] = [{}]  # of the outermost tr, td, ... since each table

    def push(self, node: Node) -> None:
        at, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.count[tag] += 1
        if tag in HOLDS_P:
            self.holds_p.append(at)
        if tag in BLOCKS:
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        if tag in SAME_CLOSES:
            self.fences[-1].setdefault(tag, at)
            self.tables[-1].setdefault(tag, at)
        if tag in FENCES:
            self.fences.append({})
        if tag == "table":
            self.tables.append({})

    def close(self, at: int) -> None:
        """Close all elements from that place on; the page itself stays."""
        while len(self.stack) > max(at, 1):
            node = self.stack.pop()
            place, tag = len(self.stack), node.tag
            self.count[tag] -= 1
            if self.holds_p[-1] == place:
                self.holds_p.pop()
            if tag in FENCES:
                self.fences.pop()
            if tag == "table":
                self.tables.pop()
            if tag in BLOCKS:
                self.inline.pop()
            else:
                self.inline[-1][tag] -= 1
            for scope in (self.fences[-1], self.tables[-1]):
                if scope.get(tag) == place:
                    del scope[tag]

    def before(self, tag: str) -> None:
        """What a start tag closes: an open paragraph, and items or cells of its kind."""
        if tag in CLOSES_P and self.stack[self.holds_p[-1]].tag == "p":
            self.close(self.holds_p[-1])
        if tag in SAME_CLOSES:
            scope = (self.fences if tag in ("li", "dt", "dd", "option") else self.tables)[-1]
            found = [scope[t] for t in SAME_CLOSES[tag] if t in scope]
            if found:
                self.close(min(found))

    def end(self, tag: str) -> None:
        """An end tag: closes up to its element, if that is open, and open since the last block for an inline one."""
        if (self.count if tag in BLOCKS else self.inline[-1])[tag] > 0:
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.close(at)


def parse(html: str) -> Node:
    """The tree of a page; text children are strings with references decoded. Never fails.

    Elements left open close where their parent does; a paragraph also at the next block; end tags without
    a start are passed over; what a cut-off page ends in is read as far as it goes. The time is in proportion to the page.
    """
    root = Node("html", None)
    opened, at, size = _Open(root), 0, len(html)
    in_article = opened.count
    while at < size:
        m = TOKEN.search(html, at)
        stop = m.start() if m else size
        top = opened.stack[-1]
        if stop > at:
            top.children.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        end, start = m[1], m[2] or m[4]
        if start:
            tag = start.lower()
            if tag in ("html", "body"):
                if tag == "html" or top.tag == "head":
                    opened.close(1)
                if tag == "body" and len(opened.stack) == 1:
                    body = Node("body", root)
                    root.children.append(body)
                    opened.push(body)
                continue
            opened.before(tag)
            if opened.stack[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
                opened.close(len(opened.stack) - 1)
            top = opened.stack[-1]
            attributes = m[3] or m[5] or ""
            inside = in_article["article"] + in_article["main"] > 0
            never = top.never or _is_hidden(tag, attributes)
            node = Node(tag, top, never, top.around or _is_beside(tag, attributes, inside), _is_named(tag, attributes))
            top.children.append(node)
            if tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = found.start() if found else size
            elif tag not in VOID and not (attributes.endswith("/") and tag in ("path", "use", "circle", "rect", "line", "g", "svg")):
                opened.push(node)
        elif end:
            tag = end.lower()
            if tag == "br":
                top.children.append(Node("br", top, top.never, top.around))
            else:
                opened.end(tag)
    _settle(root)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes that a page shows, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.never)
    return out


def weigh(nodes: list[Node]) -> None:
    """Composite text density of every node, and the sum of its children's.

    Characters per tag, lowered by the share of characters and tags that are links, against the whole body.
    """
    own: dict[int, int] = {}
    for node in reversed(nodes):
        node.tags = node.link_tags = node.link_chars = 0
        node.chars = own[id(node)] = sum(len(SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        for c in node.children:
            if not isinstance(c, str) and not c.never:
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.tags += c.tags + 1
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        tags = max(1, node.tags)
        links, link_tags = max(1, node.link_chars), max(1, node.link_tags)
        plain = max(1, node.chars - node.link_chars)
        if node.chars:
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            node.density = node.chars / tags * math.log(max(1.0, node.chars / links * tags / link_tags)) / base
        else:
            node.density = 0.0
    for node in nodes:
        # Text of its own stands for a child without tags.
        node.total = own[id(node)] + sum(c.density for c in node.children if not isinstance(c, str) and not c.never)


def choose(root: Node) -> tuple[list[Node], float]:
    """The subtrees that hold the article, in page order, and the threshold of densities.

    All that the page shows is weighed, menus and footers too. Of what does not say that it stands beside the article, the
    node of the largest density sum is chosen; the threshold is the least density on the way from the body to it. A
    paragraph stands for the block it is in; a node with most of the plain text of an article or main element, for that
    element. Then, level by level on the way, headings come too, and siblings whose density reaches the threshold and that
    are no link list, if they are paragraphs or have elements whose densities add up to it.
    """
    nodes = _walk(root)
    weigh(nodes)
    if not nodes[0].chars:
        return [], 0.0
    best = max((n for n in nodes if not n.around), key=lambda n: n.total)
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min((n.density for n in path if n.tag != "html"), default=0.0)
    plain = best.chars - best.link_chars
    for node in path[1:]:
        if node.tag in LIFTS and 2 * plain >= node.chars - node.link_chars:
            best = node
    while best.parent is not None and best.parent.tag not in ("html", "body") and (best.tag not in BLOCKS or best.tag in INNER):
        best = best.parent
    inside = set(map(id, path[path.index(best) :])) if best in path else {id(best)}
    chosen: list[Node] = []

    def belongs(n: Node) -> bool:
        if n.tag == "h1":
            return True
        dense = n.density >= threshold and 2 * n.link_chars < n.chars
        return dense and (n.tag in PARAGRAPHS or sum(c.density for c in n.children if not isinstance(c, str) and not c.never) >= threshold)

    stack = [nodes[0]]
    while stack:
        n = stack.pop()
        if n is best or (id(n) not in inside and n.chars and belongs(n)):
            chosen.append(n)
        elif id(n) in inside:
            stack.extend(c for c in reversed(n.children) if not isinstance(c, str) and not c.never and not c.around)
    return chosen or [best], threshold


def text_of(nodes: list[Node], threshold: float = 0.0) -> list[str]:
    """The blocks of text below ``nodes``, in page order, white space made one space and trimmed.

    What says that it stands beside the article is left out, and so are blocks below the threshold that are mostly links.
    """
    blocks, run = [], []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            blocks.append(text)
        run.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            elif not item.never and not item.around:
                block = item.tag in BLOCKS
                if block and item is not top and 2 * item.link_chars > item.chars and item.density < threshold:
                    continue
                if block:
                    flush()
                    stack.append(None)
                stack.extend(reversed(item.children))
        flush()
    return blocks


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by one space; empty for null, empty or textless pages."""
    if not html:
        return ""
    return " ".join(text_of(*choose(parse(html))))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; rows are independent, none is dropped."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column("html")], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "html")
    return slim.mapInArrow(run, f"{kinds}, text string").withColumn("n_chars", F.length("text").cast("long"))

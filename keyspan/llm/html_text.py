"""Main text of web pages by composite text density.

A page is parsed into a tree, forgivingly and in linear time: unclosed blocks are closed by what
follows them, cut off pages end where they end.  What a page's authors mark as no part of an
article (scripts, menus, forms' controls, and elements whose class, id or role names such a
thing) is no part of the tree; this is a filter ahead of the densities, and a page that it would
leave empty is read without regard to names.

Each node then has a density: characters per tag, lowered by the share of characters and tags
that belong to links.  Inline elements are tags of their block, not subtrees.  The subtree with
the largest sum of its children's densities is the core; it grows to its parent as long as the
parent is the denser one.  The least density on its path below body is the threshold: of all
subtrees beside the path those that reach it (a single block: the mean of the core's blocks) are
kept too, and headings just above the core.
Within what is kept, blocks that are mostly links go (LINKS): their density falls to next to
nothing against the threshold.  No element is the article by its name.

A form is kept if it holds most of the page's text, and is left out otherwise.  The only h1 of
a page, if it stands in a header and holds no link, is the article's.

Defined results: a null or empty page gives an empty text; pages are read whole, however long;
repeated rows are judged alike; of equal sums the first node in page order wins; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from .common import arrow_schema, ddl, slices

COLUMNS = [("page_id", "long"), ("url", "string"), ("text", "string"), ("n_chars", "long")]

#: Elements by their part in a page (fixed values of the language).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - frozenset("body head html tbody td tfoot th thead tr caption".split())
LEFT_OUT = frozenset("nav footer aside menu button dialog head search fieldset label legend datalist output".split())
#: Raw elements that swallow the page if they are not closed; others are then no more than their start tag.
SWALLOWS = frozenset("script style xmp iframe".split())
#: Elements whose start tags close open ones, by family: the element above which none is looked for, and what closes what.
FAMILIES = (("ul ol menu", {"li": "li"}), ("dl", {"dt": "dt dd", "dd": "dt dd"}), ("table", {"tr": "tr td th", "td": "td th", "th": "td th"}))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of a block's characters in links from which it is a list of links.
LINKS = 0.6
#: Words in a class, id or role that mark what is not the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline-links|comments?|comment\w*|cookies?|consent|copyright|disqus|footer|gdpr|hidden|login|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notices?|notification|overlay|pagination|pager|popup|promo\w*|related|replies|reply|respond|rss|search|share|sharing|"
    r"sidebar|signup|skip|social|sponsor\w*|subscribe|tags|toolbar|topbar|tracking|widget|complementary|contentinfo|alert|alertdialog|header|site-header|page-header)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Names that have such a word and yet are the article's or the page's.
NOT_NOISE = re.compile(r"(?:article|entry|post|content|story|main|page)[_-]?header|(?:has|with|no|without)[_-]\w+", re.IGNORECASE)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b|\baria-hidden\s*=\s*["']?true)""", re.IGNORECASE)
TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<[a-zA-Z/][^>]*(?:>|\Z)""",
    re.DOTALL,
)
MARKUP = re.compile(r"<([a-zA-Z][^\s/>]*)")


_FAMILY = {tag: k for k, (stops, closes) in enumerate(FAMILIES) for tag in (*stops.split(), *closes)}
_CLOSES = {tag: (k, frozenset(names.split())) for k, (_, closes) in enumerate(FAMILIES) for tag, names in closes.items()}


class Node:
    """An element; block: the nearest block at or above it; near: the nearest member of each family; inside: whether it is in an article or main."""

    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "order", "block", "near", "inside", "gone", "inline")

    def __init__(self, tag: str, parent):
        self.tag, self.parent, self.children = tag, parent, []  # children: nodes and texts
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = self if parent is None or tag in BLOCK else parent.block
        near = parent.near if parent else (None,) * len(FAMILIES)
        k = _FAMILY.get(tag)
        self.near = near if k is None else (*near[:k], self, *near[k + 1 :])
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.gone = False
        self.inline: dict[str, int] = {}  # of a block: its open inline elements


class Tree:
    """Open elements while a page is read; each is looked for in constant time and closed once."""

    def __init__(self):
        self.root = self.at = Node("body", None)
        self.open: dict[str, int] = {}

    def start(self, tag: str) -> Node:
        node = Node(tag, self.at)
        self.at.children.append(node)
        self.at = node
        counts = self.open if tag in BLOCK else node.block.inline
        counts[tag] = counts.get(tag, 0) + 1
        return node

    def close(self, node: Node) -> None:
        """Close an open element and all within it."""
        while True:
            at = self.at
            counts = self.open if at.tag in BLOCK else at.block.inline
            counts[at.tag] -= 1
            self.at = at.parent
            if at is node:
                return

    def end(self, tag: str) -> None:
        """An end tag: it closes the nearest such element; of inline ones only one within the same block."""
        if tag in BLOCK:
            if self.open.get(tag):
                node = self.at
                while node.tag != tag:
                    node = node.parent
                self.close(node)
        elif self.at.block.inline.get(tag):
            node = self.at
            while node.tag != tag:
                node = node.parent
            self.close(node)

    def before(self, tag: str) -> None:
        """What a start tag closes."""
        if tag in ENDS_P and self.at.block.tag == "p" and self.at.block is not self.root:
            self.close(self.at.block)
        if tag in _CLOSES:
            k, names = _CLOSES[tag]
            while (node := self.at.near[k]) is not None and node.tag in names:
                self.close(node)


def noisy(tag: str, attributes: str) -> bool:
    if tag in LEFT_OUT:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    return any(m[4] or NOISE.search(NOT_NOISE.sub("", m[1] or m[2] or m[3] or "")) for m in NAMES.finditer(attributes))


def parsed(page: str, by_name: bool = True) -> Node:
    """The tree below body, without what is left out; by_name: also for a class, id or role."""
    tree = Tree()
    skipping, depth, position = "", 0, 0  # inside an element that is left out
    size, ends = len(page), {}
    while position < size:
        m = TOKEN.search(page, position)
        if m is None:
            if not skipping:
                tree.at.children.append(page[position:])
            break
        if m.start() > position and not skipping:
            tree.at.children.append(page[position : m.start()])
        position = m.end()
        end, start = m[1], m[2]
        if start is None and end is None and (late := MARKUP.match(m[0])) and m[0].endswith(">"):
            start = late[1]  # its quotes are unbalanced
        if start:
            tag, attributes = start.lower(), m[3] or ""
            if tag in RAW:
                if attributes.endswith("/") and tag in ("svg", "math") or ends.get(tag, position) < 0:
                    continue
                stop = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, position)
                if stop:
                    position = stop.end()
                elif tag in SWALLOWS:
                    position = size
                else:
                    ends[tag] = -1  # not looked for again
            elif skipping:
                if tag == skipping and tag not in VOID:
                    depth += 1
            elif tag in VOID:
                if tag == "hr":
                    tree.before(tag)
                elif tag != "wbr":
                    tree.at.tags += 1
                if tag != "wbr":
                    tree.at.children.append(" ")
            else:
                tree.before(tag)
                if tag in ("html", "body"):
                    continue
                if noisy(tag, attributes if by_name else "") and not (tag == "header" and tree.at.inside):
                    skipping, depth = tag, 1
                    tree.at.children.append(Node("gap", tree.at))
                    continue
                tree.start(tag)
        elif end:
            tag = end.lower()
            if skipping:
                if tag == skipping:
                    depth -= 1
                    if not depth:
                        skipping = ""
                elif skipping == "head" and tag == "html":
                    skipping = ""
            elif tag not in ("html", "body") and tag not in VOID:
                tree.end(tag)
        if skipping == "head" and start and start.lower() == "body":
            skipping, depth = "", 0
    return tree.root


def in_order(root: Node) -> list[Node]:
    """All nodes that are not left out, in page order."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in reversed(node.children) if type(c) is Node and c.tag != "gap" and not c.gone]
    return nodes


def count(nodes: list[Node]) -> None:
    """Characters and tags of each node, and of its links."""
    for k, node in enumerate(nodes):
        node.order = k
    for node in reversed(nodes):
        node.tags += 1
        for c in node.children:
            if type(c) is str:
                node.chars += len("".join(html.unescape(c).split()))
            elif c.tag != "gap" and not c.gone:
                node.chars += c.chars
                node.tags += c.tags
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags


def settled(root: Node) -> list[Node]:
    """Nodes in page order, counted, after forms and page headers have been judged."""
    nodes = in_order(root)
    if any(n.tag in ("form", "header") for n in nodes):
        voids = [n.tags for n in nodes]
        count(nodes)
        most = root.chars / 2
        titles = [n for n in nodes if n.tag == "h1"]
        title = titles[0] if len(titles) == 1 and not titles[0].link_chars else None
        for n in nodes:
            if n.tag == "form" and n.chars <= most:
                n.gone = True
            elif n.tag == "header" and not n.inside:
                if title is not None and _holds(n, title):
                    n.children = [title]
                    title.parent = n
                else:
                    n.gone = True
        for n, tags in zip(nodes, voids):
            n.chars = n.link_chars = n.link_tags = 0
            n.tags = tags
        nodes = in_order(root)
    count(nodes)
    return nodes


def _holds(node: Node, other: Node) -> bool:
    while other is not None and other is not node:
        other = other.parent
    return other is node


def measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes; the nodes in page order."""
    nodes = settled(root)
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        c, t, lc, lt = node.chars, node.tags, max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            other = max(c - node.link_chars, 1)
            base = math.log(c / other * node.link_chars + share * c + math.e)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)), 1e-6) / base
    for node in nodes:
        if node.tag in BLOCK:  # inline elements count as tags of the block around them, not as subtrees
            node.total = sum(k.density for k in blocks_below(node))
    return nodes


def blocks_below(node: Node) -> list[Node]:
    return [k for k in node.children if type(k) is Node and k.tag in BLOCK and not k.gone]


def kept_nodes(root: Node) -> tuple[set[int], set[int]]:
    """Orders of the subtrees that make the main text, and of those within them that do not."""
    nodes = measure(root)
    core = max(nodes, key=lambda n: (n.total, -n.order))
    if core.total <= 0:
        return {0}, set()
    while core.parent is not None and core.parent.block.density >= core.density:
        core = core.parent.block
    path, node = [core], core.parent
    while node is not None:
        path.append(node)
        node = node.parent
    threshold, kept = min([core.density, *(n.density for n in path[1:-1] if n.tag in BLOCK)]), {core.order}
    usual = max(threshold, core.total / max(len(blocks_below(core)), 1))
    for below, node in zip(path, path[1:]):
        children = blocks_below(node)
        place = children.index(below) if below in children else len(children)
        # a block without blocks is held against those of the core
        kept |= {k.order for i, k in enumerate(children) if k is not below and (k.density >= (threshold if blocks_below(k) else usual) or k.tag in HEADINGS and i < place and mostly_text(k))}
        kept |= {k.children[0].order for k in children[:place] if k.tag == "header"}
    lists = {n.order for n in nodes if n.tag in BLOCK and n not in path and not mostly_text(n) and n.density < threshold}
    return kept, lists


def mostly_text(node: Node) -> bool:
    return node.link_chars < LINKS * node.chars or not node.chars


def main_text(page: str) -> str:
    """Blocks of the main text, one a line, in page order."""
    if not page.strip():
        return ""
    # a page whose whole content has such a name is read without regard to names
    return text_of(parsed(page)) or text_of(parsed(page, by_name=False))


def text_of(root: Node) -> str:
    kept, lists = kept_nodes(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if words := "".join(line).split():
            blocks.append(" ".join(words))
        line.clear()

    todo: list[tuple] = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if type(item) is str:
            if inside:
                line.append(html.unescape(item))
            continue
        if item is None or item.tag == "gap" or item.gone:
            flush()
            continue
        inside = (inside or item.order in kept) and item.order not in lists
        if item.tag in BLOCK:
            flush()
            todo.append((None, False))
        todo += [(c, inside) for c in reversed(item.children)]
    flush()
    return "\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """One row for each row of pages (page_id, url, html)."""
    schema = arrow_schema(COLUMNS)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            texts = [main_text(x) if x else "" for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, ddl(COLUMNS))

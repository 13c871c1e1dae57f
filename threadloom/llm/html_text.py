"""Main text of web pages by composite text density.

A page becomes a tree. Its density is characters per tag, adjusted for links (Sun, Song and
Liao, 2011): C/T * log(C/LC * T/LT) to the base ln(LC/(C-LC) * C + LCb/Cb * C + e), where C
and T count a node's characters and tags, LC and LT those inside links and b is the body. The
sums of its children's densities are compared over all nodes; from the node of the largest
sum, the smallest density on the path up to the body is the threshold, and the highest
ancestor-or-self whose density reaches it and whose sum is half of the largest is the main
subtree. Within it, and before densities are counted, parts that are never article text are
left out: by element (scripts, styles, navigation, footers and the like), and forms and what
words in class, id and role mark. A form or marked part stays, and is judged by its density, if
it has more text outside links than what is around it and in no such part, and most of the text
of article and main elements, or of the page if there are none: it is a wrapper of the page.

Defined results: a null page is empty; text of a page without tags is taken as a whole; every
page is read whole in linear time, whatever its errors (a tag whose quotes leave it without an
end has the next > as its end, and so have all after it; without any >, the rest is text); a page without text gives the empty
string; repeated rows repeat; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("script style textarea title noscript template iframe xmp noembed noframes nav footer aside button select input option label dialog menu svg math canvas object applet audio video head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open p, and which open elements a new one of the same kind ends.
BLOCKS = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

#: Words of class, id and role that mark what is not the article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"comments?|commentlist|replies|reply|respond|disqus|discussion|sidebar\w*|side|aside|widgets?|related|recommend\w*|share|sharing|social|"
    r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|footer\w*|topbar|toolbar|copyright|disclaimer|skip|search|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
HEADERS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
_OPENING = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "link", "doubtful", "own", "in_article")

    def __init__(self, name: str, parent: Node | None, dropped: bool, link: bool):
        self.name, self.parent, self.dropped, self.link = name, parent, dropped, link
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.doubtful, self.own = False, 0
        #: Headers in an article hold its title; others are the page's.
        self.in_article = name in ("article", "main") or parent is not None and parent.in_article


def _unwanted(name: str, attributes: str, within: Node) -> bool:
    if name in DROPPED:
        return True
    if name == "header":
        return not within.in_article
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _doubtful(name: str, attributes: str, within: Node) -> bool:
    """Forms and marked parts; an article or main is marked only within another."""
    if name == "form":
        return True
    if not attributes or name in ("html", "body") or name in ("article", "main") and not within.in_article:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            value = m[2] or m[3] or m[4] or ""
            if MARKED.search(value) or HEADERS.search(value) and not within.in_article:
                return True
    return False


def settle(nodes: list[Node]) -> None:
    """Counts the text of nodes, and drops the doubtful ones that are no wrappers of the page."""
    for node in nodes:
        node.own = 0 if node.dropped else sum(len(_SPACE.sub("", html.unescape(c))) for c in node.children if isinstance(c, str))
    if not any(n.doubtful and not n.dropped for n in nodes):
        return
    place = {id(n): i for i, n in enumerate(nodes)}
    up = [place[id(n.parent)] if n.parent else 0 for n in nodes]
    plain = [0 if n.link else n.own for n in nodes]  # text outside links
    total, named = sum(plain), [False] * len(nodes)
    held, direct, bar = [0] * len(nodes), plain[:], [0] * len(nodes)  # nearest doubtful node, its text that no other has
    for i, n in enumerate(nodes):
        named[i] = n.name in ("article", "main") or i > 0 and named[up[i]]
        held[i] = i if n.doubtful or not i else held[up[i]]
        if held[i] != i:
            direct[held[i]] += plain[i]
    for i, n in enumerate(nodes):
        if n.doubtful and i:
            bar[i] = max(bar[held[up[i]]], direct[held[up[i]]])
    told = [p if m else 0 for p, m in zip(plain, named)]
    most, gone = sum(told) / 2, [False] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        inside = 0 if i and named[up[i]] else told[i]  # parts of an article don't hold it
        gone[i] = nodes[i].doubtful and not (plain[i] > bar[i] and (inside > most if most else 2 * plain[i] > total))
        if i:
            told[up[i]] += told[i]
            plain[up[i]] += 0 if gone[i] else plain[i]
    for i, n in enumerate(nodes):
        n.dropped = n.dropped or gone[i] or i > 0 and nodes[up[i]].dropped


class _Tags:
    """Comments, declarations and tags of a page one after another, each place of it looked at
    a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Where the > is that ends the tag whose attributes start here, or -1."""
        start = at
        while self.quotes:
            m = _QUOTE_OR_END.search(self.page, at)
            if not m:
                self.quotes = False  # from here on quotes hide no >
            elif m[0] == ">":
                return m.start()
            else:
                at = self.page.find(m[0], m.end()) + 1 if m.start() < self.last[m[0]] else m.end()
        return self.page.find(">", start)

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """Start, end, slash, name and attributes of the next one; a name only for tags."""
        m = _OPENING.search(self.page, at)
        if not m:
            return len(self.page), -1, "", "", ""
        if m[2]:
            end = self.end(m.end())
            return (m.start(), end + 1, m[1], m[2].lower(), self.page[m.end() : end]) if end >= 0 else (len(self.page), -1, "", "", "")
        mark = "-->" if m[0] == "<!--" else ">"
        end = self.page.find(mark, m.end())
        return m.start(), len(self.page) if end < 0 else end + len(mark), "", "", ""


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes, parents first."""
    root = Node("", None, False, False)
    nodes, at, tags = [root], 0, _Tags(page)
    # Open elements from the root down, and their places: by name, and of those that are no inline elements.
    stack, places, blocks = [root], defaultdict(list), [0]

    def close(place: int) -> None:
        while len(stack) > place:
            places[stack.pop().name].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    while True:
        start, end, slash, name, attributes = tags.next(at)
        if start > at:
            stack[-1].children.append(page[at:start])
        if end < 0:
            return root, nodes
        at = end
        if not name:
            continue
        if slash:
            if places[name]:
                close(places[name][-1])
            continue
        if name in BLOCKS and stack[blocks[-1]].name == "p":
            close(blocks[-1])
        if name in CLOSES:
            ends, bounds = CLOSES[name]
            bound = max((places[b][-1] for b in bounds if places[b]), default=0)
            over = [places[e][k] for e in ends.split() if (k := bisect_right(places[e], bound)) < len(places[e])]
            if over:
                close(min(over))
        here = stack[-1]
        node = Node(name, here, here.dropped or _unwanted(name, attributes, here), here.link or name == "a")
        node.doubtful = not node.dropped and _doubtful(name, attributes, here)
        here.children.append(node)
        nodes.append(node)
        if name in RAW and not attributes.endswith("/"):
            m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = m.end() if m else len(page)
        elif name not in VOID and not attributes.endswith("/"):
            places[name].append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append(node)


def main_node(root: Node, nodes: list[Node]) -> Node:
    """The root of the main subtree."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        node.chars += node.own
        if node.link:
            node.link_chars += node.own
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.name == "a")
    body = next((n for n in nodes if n.name == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        if node.dropped or not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if node.name not in INLINE:  # marks within a paragraph are no blocks of their own
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = c / t * max(math.log(c / lc * t / lt), 0.0) / max(base, 1e-9)
        if node.parent:
            node.parent.total += node.density
    best = max((n for n in nodes if not n.dropped and n.chars), key=lambda n: n.total, default=root)
    path = [best]
    while path[-1] is not body and path[-1].parent:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    return next((n for n in reversed(path) if n.density >= threshold and n.total >= best.total * 0.5), best)


def text_of_tree(top: Node) -> str:
    """Blocks in page order, white space within each turned into single spaces, joined by a space."""
    blocks: list[str] = []
    run: list[str] = []
    stack: list[tuple[Node | str | None, bool]] = [(top, False)]
    while stack:
        item, done = stack.pop()
        if isinstance(item, str):
            run.append(item)
            continue
        if not done and item.dropped and item is not top:
            if item.name not in INLINE:
                run.append("\0")
            continue
        if item.name not in INLINE:
            run.append("\0")
        if not done:
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))
    for part in "".join(run).split("\0"):
        block = _SPACE.sub(" ", html.unescape(part)).strip()
        if block:
            blocks.append(block)
    return " ".join(blocks)


def extract(page: str | None) -> str:
    if not page:
        return ""
    root, nodes = parse(page.replace("\0", ""))
    settle(nodes)
    return text_of_tree(main_node(root, nodes))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [extract(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(run, "page_id long, url string, text string, n_chars long")

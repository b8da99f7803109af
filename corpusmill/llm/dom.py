"""A small tolerant HTML reader: one pass of a regular expression, a tree of block elements, text of inline ones."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes object annotation annotation-xml".split())  # read to their end tag, without text
HIDDEN = frozenset("head select option optgroup datalist button canvas audio video map".split())  # what a browser shows as a control, or only if it can't show the element
INLINE = frozenset(
    "math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose mfenced merror a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var output meter progress picture".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}, "option": {"select"}}


class Node:
    """A block element. items: its own text and its child nodes, in order; links: characters of its own text in <a>."""

    __slots__ = ("tag", "attributes", "parent", "items", "links", "inline", "hidden")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.items: list[str | Node] = []
        self.links = self.inline = 0
        self.hidden = tag in HIDDEN or parent is not None and parent.hidden

    def children(self) -> list[Node]:
        return [x for x in self.items if not isinstance(x, str)]


def attribute_text(attributes: str) -> str:
    """Values of the attributes that say what an element is for, lower-cased."""
    return " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)).lower() if attributes else ""


def parse(html: str) -> Node:
    """The tree under a root node. Unclosed, stray and crossing tags are taken as browsers mostly do."""
    root = node = Node("#root", "", None)
    open_: list[tuple[str, Node | None]] = []  # elements; inline ones have no node
    opened: Counter[str] = Counter()  # of open_, by tag
    anchors = at = 0
    lower = None

    def text(piece: str) -> None:
        if piece and not node.hidden:
            piece = unescape(piece) if "&" in piece else piece
            node.items.append(piece)
            if anchors:
                node.links += len(piece)

    def close(k: int) -> None:
        """Ends the open elements from the k-th on."""
        nonlocal node, anchors
        for tag, own in reversed(open_[k:]):
            opened[tag] -= 1
            if own is not None:
                node = own.parent
            elif tag == "a":
                anchors -= 1
        del open_[k:]

    def shut(tags: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        """Ends the innermost open element of these tags, unless one of scope is further in."""
        if not any(map(opened.__getitem__, tags)):
            return
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in tags:
                while k and open_[k - 1][0] in tags and open_[k][0] != open_[k - 1][0]:
                    k -= 1  # a row ends with its cells
                close(k)
                return
            if open_[k][0] in scope:
                return

    while True:
        m = _MARK.search(html, at)
        if m is None:
            text(html[at:])
            return root
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                if tag == "p":
                    node.items.append(Node("p", "", node))
                continue
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    # an inline end tag does not end blocks opened since
                    if tag in INLINE and any(own is not None for _, own in open_[k + 1 :]):
                        if tag == "a":
                            anchors -= 1
                        opened[tag] -= 1
                        del open_[k]
                    else:
                        close(k)
                    break
                if tag not in INLINE and open_[k][0] in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                if lower is None:
                    lower = html.lower()
                    if len(lower) != len(html):  # a few capitals grow when lower-cased
                        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
                end = lower.find(f"</{tag}", at)
                close_at = html.find(">", end) if end >= 0 else -1
                at = close_at + 1 if close_at >= 0 else len(html)
            continue
        if tag == "br" or tag == "wbr":
            text(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                shut({"p"}, {"table", "button"})
                node.items.append(Node("hr", "", node))
            continue
        if tag in INLINE:
            if not m[3].endswith("/"):
                if tag == "a":
                    shut({"a"}, {"table", "td", "th"})
                    anchors += 1
                node.inline += 1
                opened[tag] += 1
                open_.append((tag, None))
            continue
        if tag in _CLOSES_P:
            shut({"p"}, {"table", "td", "th", "button", "object"})
        if tag in _CLOSED_BY:
            shut(_CLOSED_BY[tag], _SCOPE[tag])
        child = Node(tag, m[3], node)
        node.items.append(child)
        if not m[3].endswith("/") or tag != "svg":
            node = child
            opened[tag] += 1
            open_.append((tag, child))

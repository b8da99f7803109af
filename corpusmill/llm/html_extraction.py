"""Main text of web pages: boosted trees judge DOM elements, a decoding over the tree makes the judgements agree.

For every block element the trees give the odds that its subtree holds main text. An element that holds some must have
ancestors that do, and a child (or own text) that does. Of all choices that obey this, the decoding takes the likeliest:
for each element, from the leaves up, the best total with it in and with it out; then, from the root down, the choices.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.boosting import Boosted
from corpusmill.llm.dom import Node, attribute_text, parse
from corpusmill.llm.html_training import Maker

PAGES, SEED = 1500, 11  #: made pages that the trees are fitted on

#: Words in attributes, by what they hint at.
_HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topnav",
    "header": "header masthead branding logo topbar",
    "footer": "footer colophon copyright legal bottom",
    "side": "sidebar aside widget related recommended trending archive tags tag author",
    "notice": "cookie cookies notice alert gdpr consent announcement warning banner paywall message modal popup overlay",
    "ad": "ad ads advert advertisement adsbox sponsored sponsor promo promotion offer partner",
    "form": "search newsletter subscribe login signup form poll register",
    "comments": "comment comments respond reply replies discussion disqus review reviews",
    "share": "share sharing social follow meta byline",
    "main": "content article post entry main story text body page",
}
_HINT_OF = {w: k for k, (_, words) in enumerate(_HINTS.items()) for w in words.split()}
_TAGS = "nav header footer aside form article main section div ul ol li p table tr td blockquote pre figure figcaption body dl dd fieldset details address".split()
_TAG_OF = {t: k for k, t in enumerate(_TAGS)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z]+")
_NUMBERS = 28
_OFF_TAGS, _MAIN_TAGS, _MAIN = frozenset("nav footer aside form".split()), frozenset("article main".split()), len(_HINTS) - 1
WIDTH = _NUMBERS + 2 * len(_HINTS) + 2 * len(_TAGS) + 1


@lru_cache(maxsize=4096)
def hints_of(word: str) -> tuple[int, ...]:
    """What an attribute's word hints at: the longest hint word that it is or, from five letters on, begins with."""
    fits = [h for h in _HINT_OF if word == h or len(h) >= 5 and word.startswith(h)]
    return (_HINT_OF[max(fits, key=len)],) if fits else ()


class Page:
    """A parsed page's block elements in document order, their parents and the features that the trees read."""

    def __init__(self, html: str | None):
        self.nodes: list[Node] = []
        self.up: list[int] = []
        stack = [(parse(html or ""), -1)]
        while stack:
            node, up = stack.pop()
            if node.hidden:
                continue
            at = len(self.nodes)
            self.nodes.append(node)
            self.up.append(up)
            stack.extend((c, at) for c in reversed(node.children()))

    def features(self) -> np.ndarray:
        nodes, up, n = self.nodes, self.up, len(self.nodes)
        own = [sum(len(x) for x in v.items if isinstance(x, str) and not x.isspace()) for v in nodes]
        kids: list[list[int]] = [[] for _ in nodes]
        chars, links, tags, blocks, heads, listed = own.copy(), [v.links for v in nodes], [1 + v.inline for v in nodes], [int(o > 0) for o in own], [int(v.tag in _HEADINGS) for v in nodes], [int(v.tag == "li") for v in nodes]
        stops = [sum(x.count(".") + x.count("!") + x.count("?") + x.count(",") for x in v.items if isinstance(x, str)) for v in nodes]
        most = own.copy()
        for i in range(n - 1, 0, -1):
            u = up[i]
            kids[u].append(i)
            for a in (chars, links, tags, blocks, heads, listed, stops):
                a[u] += a[i]
            most[u] = max(most[u], most[i])
        total, starts, depth, at = max(1, chars[0]), [0] * n, [0] * n, 0
        hints: list[list[bool]] = []
        for i, v in enumerate(nodes):
            starts[i] = at
            at += own[i]
            mine = [False] * len(_HINTS)
            if v.attributes:
                for w in _SPLIT.split(attribute_text(v.attributes)):
                    for k in hints_of(w):
                        mine[k] = True
            hints.append(mine)
        out = np.zeros((n, WIDTH), np.float32)
        inherited = [[False] * len(_HINTS)] * n
        above = np.zeros((n, len(_TAGS)), np.float32)
        off, main = [v.tag in _OFF_TAGS or any(h[:_MAIN]) for v, h in zip(nodes, hints)], [v.tag in _MAIN_TAGS or h[_MAIN] for v, h in zip(nodes, hints)]
        off_above, main_above = [0] * n, [0] * n
        place = [0] * n
        for k in kids:
            k.reverse()
            for j, i in enumerate(k):
                place[i] = j
        same = [Counter(nodes[i].tag for i in k) for k in kids]
        log = math.log1p
        for i, v in enumerate(nodes):
            u = up[i]
            if u >= 0:
                depth[i] = depth[u] + 1
                inherited[i] = [a or b for a, b in zip(inherited[u], hints[u])]
                above[i] = above[u]
                off_above[i], main_above[i] = off_above[u] + off[u], main_above[u] + main[u]
                t = _TAG_OF.get(nodes[u].tag)
                if t is not None:
                    above[i, t] = 1
            sib = kids[u] if u >= 0 else [i]
            j = place[i]
            before, after = sib[j - 1] if j else -1, sib[j + 1] if j + 1 < len(sib) else -1
            c = chars[i]
            alike = same[u][v.tag] if u >= 0 else 1
            out[i, :_NUMBERS] = (
                depth[i], len(kids[i]), log(c), log(own[i]), c / total, starts[i] / total, (starts[i] + c) / total, links[i] / max(1, c), tags[i] / max(1, c), stops[i] / max(1, c), c / max(1, blocks[i]),
                log(most[i]), heads[i], listed[i], j, len(sib), alike / len(sib), c / max(1, chars[u]) if u >= 0 else 1, log(chars[before]) if before >= 0 else -1, log(chars[after]) if after >= 0 else -1,
                links[before] / max(1, chars[before]) if before >= 0 else -1, links[after] / max(1, chars[after]) if after >= 0 else -1, v.tag in _HEADINGS, v.tag == "h1", off[i], off_above[i], main[i], main_above[i],
            )
            k = _NUMBERS
            out[i, k : k + len(_HINTS)] = hints[i]
            out[i, k + len(_HINTS) : k + 2 * len(_HINTS)] = inherited[i]
            k += 2 * len(_HINTS)
            t = _TAG_OF.get(v.tag)
            if t is not None:
                out[i, k + t] = 1
            out[i, -1] = v.inline
        out[:, -1 - len(_TAGS) : -1] = above
        return out

    def decode(self, odds: np.ndarray) -> list[bool]:
        """For each element whether it holds main text: the likeliest choice in which parents and children agree."""
        n, up = len(self.nodes), self.up
        yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
        texts = [any(isinstance(x, str) and not x.isspace() for x in v.items) for v in self.nodes]
        total_out, with_, without = no.copy(), [0.0] * n, [0.0] * n
        inside, nearest = [0.0] * n, [-math.inf] * n  # of the children: the best sum of free choices, the best gain of one
        for i in range(n - 1, -1, -1):
            # in: own odds, children free, but one in at least unless it has text of its own
            need = 0.0 if texts[i] or nearest[i] >= 0 else nearest[i]
            with_[i] = yes[i] + inside[i] + need
            without[i] = total_out[i]
            u = up[i]
            if u >= 0:
                total_out[u] += without[i]
                inside[u] += max(with_[i], without[i])
                nearest[u] = max(nearest[u], with_[i] - without[i])
        out = [False] * n
        out[0] = n > 0 and with_[0] > without[0]
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            kids[up[i]].append(i)
        for i in range(n):
            if out[i] and kids[i]:
                gains = [with_[k] - without[k] for k in kids[i]]
                for k, g in zip(kids[i], gains):
                    out[k] = g > 0
                if not texts[i] and max(gains) <= 0 and max(gains) > -math.inf:
                    out[kids[i][gains.index(max(gains))]] = True
        return out

    def text(self, chosen: list[bool]) -> str:
        """Blocks of the chosen elements in page order. A block is text between the borders of block elements."""
        keep = {id(v) for v, c in zip(self.nodes, chosen) if c}
        blocks: list[str] = []
        run: list[str] = []

        def flush() -> None:
            block = " ".join("".join(run).split())
            if block:
                blocks.append(block)
            run.clear()

        stack: list[tuple[Node, int]] = [(self.nodes[0], 0)] if self.nodes and id(self.nodes[0]) in keep else []
        while stack:
            node, k = stack.pop()
            while k < len(node.items):
                item = node.items[k]
                k += 1
                if isinstance(item, str):
                    run.append(item)
                else:
                    flush()
                    if id(item) in keep:
                        stack.append((node, k))
                        node, k = item, 0
            flush()
        return "\n\n".join(blocks)


def _labels(page: Page) -> tuple[list[int], list[bool]]:
    """Labels of a made page's elements, 1 if main text lies in them; and which elements have any text."""
    n = len(page.nodes)
    off = [False] * n
    for i, v in enumerate(page.nodes):
        off[i] = "data-off" in v.attributes or page.up[i] >= 0 and off[page.up[i]]
    own = [any(isinstance(x, str) and not x.isspace() for x in v.items) for v in page.nodes]
    label, some = [int(own[i] and not off[i]) for i in range(n)], own.copy()
    for i in range(n - 1, 0, -1):
        u = page.up[i]
        label[u] |= label[i]
        some[u] |= some[i]
    return label, some


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """Trees fitted on made pages: about 30 elements each, whatever the input's size. The same on every run."""
    maker, xs, ys = Maker(seed), [], []
    for _ in range(pages):
        page = Page(maker.page())
        label, some = _labels(page)
        for v in page.nodes:
            v.attributes = v.attributes.replace("data-off", "")
        take = np.array(some)
        xs.append(page.features()[take])
        ys.append(np.array(label, float)[take])
    return Boosted.fit(np.concatenate(xs), np.concatenate(ys))


def extract(htmls: list[str | None], model: Boosted) -> list[str]:
    """Main texts of whole pages."""
    pages = [Page(h) for h in htmls]
    if not pages:
        return []
    odds = model.raw(np.concatenate([p.features() for p in pages]))
    out, at = [], 0
    for p in pages:
        out.append(p.text(p.decode(odds[at : at + len(p.nodes)])))
        at += len(p.nodes)
    return out


def extract_pages(pages: DataFrame, made: int = PAGES, seed: int = SEED) -> DataFrame:
    """(page_id, url, html, ...) -> page_id, url, text, n_chars, a row for each row.

    Null html, and html without main text, gives the empty text. Repeated rows stay, nulls in page_id and url pass
    through, other columns are not read. An empty table gives no rows. No shuffle: a page is read, judged and decoded
    where it lies.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trained(made, seed))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                texts = extract(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

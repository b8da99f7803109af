import itertools
import random

import numpy as np
import pytest

from corpusmill.llm.boosting import Boosted
from corpusmill.llm.dom import parse
from corpusmill.llm.html_extraction import Page, _labels, extract, extract_pages, hints_of, trained
from corpusmill.llm.html_training import Maker

P = "Rain fell over the harbour while the boats came in, and nobody on the quay spoke of the storm."


def shape(node):
    return [x if isinstance(x, str) else (x.tag, shape(x)) for x in node.items]


@pytest.mark.parametrize(
    "html, tree",
    [
        ("", []),
        ("a &amp; b", ["a & b"]),
        ("<p>a<p>b", [("p", ["a"]), ("p", ["b"])]),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>", [("ul", [("li", ["x"]), ("li", ["y", ("ul", [("li", ["z"])])])])]),
        ("<p><b>a<br><p>c</b>d", [("p", ["a", " "]), ("p", ["c", "d"])]),
        ("x<script>if (a</b) '</p>'</script>y<!-- <p>no -->z", ["x", "y", "z"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", [("table", [("tr", [("td", ["a"]), ("td", ["b"])]), ("tr", [("td", ["c"])])]), "d"]),
        ("<div title='a>b'>c</div></div></span>", [("div", ["c"])]),
        ("<style>p{</style", []),
        ("1 < 2 <", ["1 < 2 <"]),
    ],
)
def test_reader(html, tree):
    assert shape(parse(html)) == tree


def test_made_pages_are_read_back(spark):
    model, maker, exact = trained(), Maker(4711), 0
    for _ in range(150):
        page = Page(maker.page())
        label, _ = _labels(page)
        for v in page.nodes:
            v.attributes = v.attributes.replace("data-off", "")
        exact += page.text(page.decode(model.raw(page.features()))) == page.text([bool(x) for x in label])
    assert exact >= 0.88 * 150


SITE = "<html><body><header><h1>Site Name</h1><nav><a href=/>Home</a><a href=/a>About</a></nav></header><div class='cookie-banner'>We use cookies here. Accept all.</div>{}<aside class='sidebar'><h3>Related</h3><ul><li><a href=/x>Another storm</a></li></ul></aside><footer><p>Copyright 2024</p></footer></body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (SITE.format(f"<article><h1>The Storm</h1><p>{P}</p><p>{P}\n <i>{P}</i></p></article><section class='comments'><h2>Comments</h2><div class='comment'><p>I was there that night too!</p></div></section>"), f"The Storm\n\n{P}\n\n{P} {P}"),
        (f"<div id='header'>My site</div><div id='menu'><ul><li><a href=#>A</a><li><a href=#>B</a></ul></div><div id='content'><h2>Title &eacute;</h2><p>{P}<p>{P}</div><div id='footer'>All rights reserved. Contact us.</div>", f"Title é\n\n{P}\n\n{P}"),
        (f"<article><h1>T</h1><p>{P}</p><form action=/s><label>Email</label><input><button>Go</button><p>Sign up for our letters.</p></form><p>{P}</p><div class='advert'>Buy shoes now, they are cheap and good.</div><p>{P}</p></article>", f"T\n\n{P}\n\n{P}\n\n{P}"),
        (f"<article><h1>T</h1><p>{P}</p></article><ol class='commentlist'><li>Bob: I disagree with all of this text.</li><li>Ann: me too.</li></ol>", f"T\n\n{P}"),
        (f"<div role='alert'>Please update your browser.</div><div class='post'><h1>T t</h1><p>{P}</p></div>", f"T t\n\n{P}"),
    ],
)
def test_pages_made_by_hand(html, text):
    assert extract([html], trained()) == [text]


@pytest.mark.parametrize("seed", range(25))
def test_decoding_is_the_likeliest_consistent_choice(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 8)
    up = [-1] + [rng.randrange(i) for i in range(1, n)]
    kids = {i: [k for k in range(n) if up[k] == i] for i in range(n)}
    page = Page("")
    page.up = up
    page.nodes = [type("N", (), {"items": ["t"] if not kids[i] or rng.random() < 0.5 else []})() for i in range(n)]
    odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
    text = [bool(v.items) for v in page.nodes]

    def fine(c):
        return all((not c[i] or up[i] < 0 or c[up[i]]) and (not c[i] or text[i] or any(c[k] for k in kids[i])) for i in range(n))

    def worth(c):
        return sum(-np.logaddexp(0, -o) if x else -np.logaddexp(0, o) for x, o in zip(c, odds))

    got = page.decode(odds)
    assert fine(got)
    assert worth(got) == pytest.approx(max(worth(c) for c in itertools.product([False, True], repeat=n) if fine(c)))


def test_boosting_learns_a_rule_of_two_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = Boosted.fit(x[:2000], y[:2000])
    assert ((model.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_attribute_words():
    assert hints_of("commentlist") == hints_of("comments") != () and hints_of("ad") != () and hints_of("address") == hints_of("adult") == ()


def test_query_on_nulls_repeats_clashes_and_an_empty_table(spark):
    long = "<article>" + f"<p>{P}</p>" * 3000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "v", long, 3), (3, "v", long, 3), (None, "w", "<nav><a>menu</a></nav>", 4), (5, "x", "<div>" * 3000 + P, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract_pages(pages).collect()
    assert sorted((r.page_id or 0) for r in got) == [0, 1, 2, 3, 3, 5]
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[1] == {r.page_id: r.text for r in got}[2] == ""
    assert {r.text for r in got if r.page_id == 3} == {"\n\n".join([P] * 3000)}
    assert extract_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize("size", [150, 199, 200, 250])
def test_share_of_siblings_alike_is_exact_at_every_size(size):
    page = Page("<article>" + f"<p>{P}</p>" * (size - 1) + "<aside>Read on</aside></article>")
    share = dict(zip([v.tag for v in page.nodes], page.features()[:, 16].tolist()))
    assert share["p"] == pytest.approx((size - 1) / size) and share["aside"] == pytest.approx(1 / size)

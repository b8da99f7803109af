import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.url_filter import RULES, Mining, RuleIndex, document_of, mine, url_tokens, url_verdicts

PAGES = "page_id long, url string, verdict int"
LABELS = "doc_id long, quality int, toxic int"


def plain(url):
    """Host, path and fixed rule as the contract words them."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=None)


URLS = [
    None, "", "no scheme", "http://", "://x.com/", "https://Example.COM/en/1?q=/fr/#a", "https://www.example.com/en/1", "http://a.www.example.com/en/",
    "http://notexample.com/en/1", "http://example.com/EN/1", "http://x.net/fr/2", "http://net/es/", "http://x.net/es?x", "http://x.net?/es/", "http://x.net#/es/", "http://com",
    "http://com/", "http://a://b.com/x", "HTTP://É.Com/en/\nx?y", "http://x.com:80/", "http://u@x.com/", "  http://x.com/ ", "http://x.org/de/5", "http://x.com/" + "a/" * 5000,
]


def test_hosts_paths_and_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(URLS)] + [(None, "http://x.com/", 1), (5, URLS[5], 0)], PAGES)
    got = url_verdicts(pages, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, fit = plain(URLS[r.page_id] if r.page_id is not None else "http://x.com/")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fit and fit[0], fit[1] if fit else "allow")
    assert url_verdicts(pages.limit(0), spark.createDataFrame([(1, 0, 0)], LABELS)).collect() == []


def urls(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        spam = rng.random() < 0.2
        name = "win.example.org" if spam else rng.choice(["a.example.org", "b.example.org", "news.example.org"])
        url = f"https://{name}/{rng.choice(['de', 'it'])}/{i}" + rng.choice(["", "?ref=x", ".html"])
        rows.append((i, url, int(rng.random() < (0.95 if spam else 0.05))))
    return rows


def test_mined_rules_are_those_of_all_token_sets(spark):
    m = Mining(min_support=0.05, min_confidence=0.6, min_lower_bound=0.0)
    rows = urls(400)
    rules, item_of = mine(spark.createDataFrame(rows, "page_id long, url string, bad int").select("url", "bad"), m)
    sets = [(set(url_tokens(u)), b) for _, u, b in rows]
    where = {t: frozenset(i for i, (s, _) in enumerate(sets) if t in s) for t in set().union(*(s for s, _ in sets))}
    assert item_of == {t: min((x for x in where if where[x] == w), key=lambda x: (len(x), x)) for t, w in where.items() if len(w) >= 0.05 * len(rows)}
    assert item_of["host:org"] == item_of["host:example.org"] == "host:org"
    sets = [({item_of[t] for t in s if t in item_of}, b) for s, b in sets]
    want = {}
    for k in (1, 2):
        for a in combinations(sorted(set(item_of.values())), k):
            covers = [b for s, b in sets if s.issuperset(a)]
            if covers and sum(covers) >= 0.05 * len(rows) and sum(covers) / len(covers) >= 0.6:
                if not any(set(x) < set(a) and c >= sum(covers) / len(covers) for x, (c, _) in want.items()):
                    want[a] = (sum(covers) / len(covers), len(covers))
    assert {a: (pytest.approx(c), n) for a, c, n in rules if len(a) <= 2} == want
    assert ("host:win.example.org",) in want


def test_all_parts_of_a_url_count(spark):
    deep = "https://" + ".".join("abcdefgh") + "/" + "/".join(f"p{i}x" for i in range(40)) + "/{}/?" + "&".join(f"k{i}=1" for i in range(30))
    tokens = url_tokens(deep.format("z"))
    assert {"host:h", "host:a.b.c.d.e.f.g.h", "path39:p0x", "path40:z", "query:k29"} <= set(tokens)
    rows = [(deep.format("spam" if i % 3 == 0 else "fine"), int(i % 3 == 0)) for i in range(150)] + [(None, 1), ("no scheme", 1)]
    rules, item_of = mine(spark.createDataFrame(rows, "url string, bad int"))
    assert [r[0] for r in rules] == [("path40:spam",)] and len(set(item_of.values())) == 3
    assert RuleIndex(rules, item_of).best(url_tokens(deep.format("spam"))) and not RuleIndex(rules, item_of).best(tokens)
    assert mine(spark.createDataFrame([], "url string, bad int")) == ([], {})


def test_unlabelled_urls_follow_the_mined_rules(spark):
    rows = urls(600)
    pages = spark.createDataFrame([(i, u, 0) for i, u, _ in rows], PAGES)
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows if i % 2] + [(None, 0, 0), (7, None, None)], LABELS)
    got = {r.page_id: r for r in url_verdicts(pages, labels, Mining(min_support=0.02)).collect()}
    for i, u, _ in rows:
        assert got[i].verdict == ("block" if "win.example" in u else "allow") and got[i].rule is None
        assert (got[i].mined_rule is not None) == ("win.example" in u)


def test_index_finds_what_comparing_all_rules_finds():
    rng = random.Random(0)
    tokens = [f"t{i}" for i in range(12)]
    rules = [(tuple(sorted(rng.sample(tokens, rng.randrange(1, 4)))), rng.random(), rng.randrange(5, 99)) for _ in range(60)]
    index = RuleIndex(rules)
    for _ in range(300):
        have = rng.sample(tokens, rng.randrange(0, 7))
        assert index.best(have) == max(((c, a) for a, c, _ in rules if set(a) <= set(have)), default=None)


def test_document_numbers(spark):
    rows = [("https://x.org/en/559#top", 559), ("http://x.org/de/64/", 64), ("http://x.org/a/8085.html", 8085), ("http://x.org/1/b", None), ("http://x.org?/5", None), (None, None), ("http://x.org/" + "9" * 30, None)]
    got = spark.createDataFrame([(u,) for u, _ in rows], "url string").select(document_of(F.col("url")).alias("d")).collect()
    assert [r.d for r in got] == [d for _, d in rows]

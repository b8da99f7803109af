import random
import zlib
from hashlib import sha256

import pytest

from corpusmill.llm import manifest
from corpusmill.llm.common import Stash, placed
from corpusmill.llm.manifest import folded, manifest_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def levels(row):
    out = [row]
    while len(row) > 1:
        row = [h("".join(row[k : k + 16])) for k in range(0, len(row), 16)]
        out.append(row)
    return out


def plain(rows):
    """The contract, one document after the other."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: levels([leaf(r, r[1]) for r in by[s]]) for s in names}
    crown = levels([trees[s][-1][0] for s in names])
    out = []
    for p, s in enumerate(names):
        for i, r in enumerate(by[s]):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            digest, proof = leaf(r, text), ""
            for tree, at in ((trees[s], i), (crown, p)):
                for level in tree[:-1]:
                    run = level[at // 16 * 16 :][:16]
                    k = at % 16
                    proof += "".join(run[:k] + run[k + 1 :])
                    digest = h("".join(run[:k] + [digest] + run[k + 1 :]))
                    at //= 16
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], crown[-1][0], h(proof), digest, digest == crown[-1][0]))
    return sorted(out, key=repr)


def told(spark, rows):
    return sorted((tuple(r) for r in manifest_audit(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2, 1], [16, 17, 1], [256, 257, 40], [1] * 40 + [5]])
def test_roots_proofs_and_folds_against_the_plain_tree(spark, sizes):
    rows = [(i * 7 % 997, f"Text {i} ÄÖ" * (i % 3), "de", f"s{g}", i) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(3).shuffle(rows)
    got = told(spark, rows)
    assert got == plain(rows)
    assert {r[-1] for r in got} <= {True, False}


def test_a_hot_source_is_cut_into_ranges_and_comes_out_whole(spark):
    rows = [(i, f"Body {i}", "en", "hot", None) for i in range(4500)] + [(i, "x", "en", f"cold{i % 30}", 1) for i in range(300)]
    assert told(spark, rows) == plain(rows)


def test_nulls_empty_and_long_texts_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (1, "", None, "", 0), (1, "", None, "", 0), (1, "B", None, "", 0), (2, "A" * 300_000, "en", None, -5), (3, "ünïcode 😀", "fr", "ß", 9), (-4, "N", "fr", "ß", 9)]
    assert told(spark, rows) == plain(rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest_audit(empty).collect() == []
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(20)]
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as leaf", "2 as pos", "3 as grp", "4 as root", "5 as total")
    assert sorted((tuple(r) for r in manifest_audit(more).collect()), key=repr) == plain(rows)


def test_a_changed_digest_leads_to_another_root():
    near = b"\1" * 32 * 15
    assert folded(b"\0" * 32, [(3, near)]) != folded(b"\2" * 32, [(3, near)])


def test_open_parents_are_handed_on_and_combined_again(spark, monkeypatch):
    rows = [(i, f"Body {i}", "en", f"s{i % 3}", None) for i in range(900)]
    thin = manifest.leaves(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("source", "grp")
    stash = Stash(spark, "test")
    ranked, _ = stash.put(placed(thin, "grp", ["doc_id", "leaf"], stash))
    scattered = ranked.repartition(7, "leaf")  # no task holds a whole run of siblings
    want = {(r.grp, r.level, r.idx, r.digest) for r in manifest.nodes(ranked, stash).collect()}
    assert {(r.grp, r.level, r.idx, r.digest) for r in manifest.nodes(scattered, stash).collect()} == want

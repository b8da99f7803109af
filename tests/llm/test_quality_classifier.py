import random
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import quality_classifier
from corpusmill.llm.quality_classifier import Network, Settings, WordVectors, _add_contexts, index_vectors, keep_likely, pooled, quality_scores, word_hashes, word_vectors

SMALL = Settings(min_share=1 / 512, dims=32, epochs=60)
DOCS = "doc_id long, text string, lang string, score double"


def corpus(n=240, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice("rain boat quay storm harbour sea night wind light stone".split()) for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + rng.choice(["###", "$$$"]) for w in words), "en", 1.0))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.mark.parametrize("chars", [1 << 17, 40])
def test_word_hashes_tell_words_apart_as_a_regular_expression_does(monkeypatch, chars):
    monkeypatch.setattr(quality_classifier, "_CHARS", chars)
    quality_classifier._powers.cache_clear()
    rng, of_word = random.Random(3), {}
    for _ in range(300):
        text = "".join(rng.choice(["ab", "ba", "a", "_", "é", "日", "𝒜b", "😀", "-", "$$", "...", " ", " ", "\n", "\u2003", "7", "x" * 9]) for _ in range(rng.randrange(60)))
        words, hashes = re.findall(r"\w+|[^\w\s]+", text), word_hashes(text).tolist()
        if chars > len(text) or max(map(len, re.findall(r"\S+", text)), default=0) < chars:
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes):
                assert of_word.setdefault(w, h) == h
    assert len(set(of_word.values())) == len(of_word) > 500
    assert len(word_hashes("x" * (3 * chars))) == 3
    quality_classifier._powers.cache_clear()


def index_vector(h, s):
    """The index vector of a hash, bit by bit."""
    v = np.zeros(s.dims, np.int64)
    for k in range(s.nonzero):
        byte = int(h) >> 8 * k & 255
        v[byte & s.dims - 1] += -1 if byte & 128 else 1
    return v


def contexts(words, s):
    """The sum of index vectors around each place of a document."""
    return [sum((index_vector(words[j], s) for j in range(max(0, i - s.window), min(len(words), i + s.window + 1)) if j != i), np.zeros(s.dims, np.int64)) for i in range(len(words))]


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_context_sums_match_a_plain_count(monkeypatch, block):
    monkeypatch.setattr(quality_classifier, "_BLOCK", block)
    s, rng = Settings(dims=8, nonzero=3, window=2), np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 16, dtype=np.uint64)
    docs = [np.array([1, 2, 3, 1, 5]), np.array([7]), np.array([2, 2]), np.array([9, 1, 1, 9])]
    total, want = np.zeros((9, 8), np.int64), np.zeros((9, 8), np.int64)
    _add_contexts(total, [(hashes[d], np.where(d < 9, d, -1).astype(np.int32)) for d in docs], s)
    for d in docs:
        for w, v in zip(d, contexts(hashes[d], s)):
            if w < 9:
                want[w] += v
    assert (total == want).all()
    assert all((index_vector(h, s) == [sum(int(g) for p, g in zip(at, sign) if p == i) for i in range(8)]).all() for h in hashes for at, sign in [[x[:, 0] for x in index_vectors(np.array([h]), s)]])


def test_every_frequent_word_has_its_own_vector(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"] * 5 + [f"w{k}" for k in range(12)] + [f"x{rng.randrange(10**6)}"] * 6) for _ in range(50)), "en", 1.0) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    counts, total, where = {}, 0, {}
    for _, t, *_ in rows:
        h = word_hashes(t)
        for w, v in zip(h.tolist(), contexts(h, SMALL)):
            counts[w] = counts.get(w, 0) + 1
            where[w] = where.get(w, 0) + v
            total += 1
    monkeypatch.setattr(quality_classifier, "_SEGMENT", 300)
    found = word_vectors(docs.repartition(3), SMALL)
    often = sorted(w for w, n in counts.items() if n >= total / 512)
    assert found.hashes.tolist() == often and 4 < len(often) < 512 and len(found.vectors) == len(often) + 1
    want = np.array([where[w] / counts[w] for w in often]) - found.mean
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(found.vectors[:-1], want, atol=1e-5) and not found.vectors[-1].any()


def test_word_vectors_do_not_depend_on_the_partitions(spark):
    rows, _ = corpus(60)
    docs = spark.createDataFrame(rows, DOCS)
    a, b = word_vectors(docs.coalesce(1), SMALL), word_vectors(docs.repartition(7), SMALL)
    assert all(np.array_equal(x, y) for x, y in zip((a.hashes, a.vectors, a.mean), (b.hashes, b.vectors, b.mean)))
    empty = word_vectors(docs.limit(0), SMALL)
    assert len(empty.hashes) == 0 and empty.vectors.tolist() == [[0.0] * 32]


def test_pooling_in_blocks_equals_pooling_at_once():
    rng, s = np.random.default_rng(0), Settings(dims=8)
    hashes = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    words = WordVectors(np.sort(hashes[:40]), np.vstack([rng.normal(size=(40, 8)), np.zeros((1, 8))]).astype(np.float32), rng.normal(size=8))
    ids = hashes[rng.integers(0, 50, 40000)]
    rows = quality_classifier.rows_of(ids, words.hashes)
    own = np.array(contexts(ids, s)) / np.array([[min(i, 2) + min(len(ids) - 1 - i, 2)] for i in range(len(ids))]) - words.mean
    v = np.where((rows >= 0)[:, None], words.vectors[rows], own / np.linalg.norm(own, axis=1, keepdims=True))
    got = pooled(ids, rows, words, s)
    assert (rows < 0).any() and np.allclose(got[:8], v.mean(0), atol=1e-4) and np.allclose(got[8:16], (v[:-1] * v[1:]).mean(0), atol=1e-4)
    assert pooled(ids[:0], rows[:0], words, s).tolist() == [0.0] * 18 + [1.0]


def test_held_out_accuracy_and_the_shape_of_rows(spark):
    rows, labels = corpus()
    extra = [(1000, None, None, None), (1001, "", None, None), (None, "rain and sea.", None, None), (3, rows[3][1], "en", 1.0)]
    docs = spark.createDataFrame(rows + extra, DOCS).repartition(3)
    labels = spark.createDataFrame([*labels, (None, 1, 0), (2000, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels, SMALL)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in found if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in found if r.held_out} == {r.doc_id for r in held}
    scored = [r for r in held if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in scored) >= 0.95 * len(scored)
    kept = keep_likely(docs, labels, SMALL)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((r.doc_id or -1) if r.doc_id is not None else -1 for r in found if r.predicted)


def test_held_out_labels_do_not_reach_the_scores(spark):
    rows, labels = corpus(120)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, DOCS).coalesce(2)
    a, b = ({r.doc_id: r.score for r in quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), SMALL).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("quality, score", [(None, 0.5), (1, 1.0)])
def test_without_both_labels_the_score_is_their_share(spark, quality, score):
    docs = spark.createDataFrame([(1, "a b", "x", 0.0), (2, "c", "x", 0.0), (3, "c", "x", 0.0)], DOCS)
    labels = spark.createDataFrame([(i, quality, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_scores(docs, labels, SMALL).collect()} == {score}
    assert quality_scores(docs.limit(0), labels, SMALL).collect() == []


def test_a_very_long_text_is_scored_whole(spark):
    rows, labels = corpus(60)
    long = [(900, " ".join(f"w{i}" for i in range(60_000)) + " rain" * 40_000, None, None), (901, "storm " * 100_000, None, None)]
    got = quality_scores(spark.createDataFrame(rows + long, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), SMALL).collect()
    assert {r.doc_id for r in got} >= {900, 901} and len(got) == 62


def test_temperature_softens_an_overconfident_network():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 40)), rng.integers(0, 2, 200).astype(float)
    net = Network.fit(x, y, Settings(epochs=300))  # learns noise by heart
    assert net.temperature > 1.5

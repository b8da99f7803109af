import random
from itertools import combinations

import pytest
import xxhash

from corpusmill.llm.simhash import _signed, _within, covering_masks, fingerprint, keep_one_of_each, near_pairs, simhash_groups
from corpusmill.llm.common import Stash

SCHEMA = "doc_id long, text string"


def plain(text):
    """The fingerprint as the contract words it, bit by bit."""
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """Smallest id reachable, by brute force over all pairs."""
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {i: top(i) for i in prints}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "a b c d É è a b c d", "x" * 70 + " y z " * 50, "nbsp joined w x"])
def test_fingerprint_is_the_majority_of_the_shingle_hashes(text):
    assert fingerprint(text) == plain(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_families_keep_every_pair_within_the_radius_together(radius):
    rng = random.Random(radius)
    for level in range(3):
        masks = covering_masks(radius, level)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            flips = rng.sample(range(64), radius)
            assert any(not any(m >> i & 1 for i in flips) for m in masks)


def test_four_levels_leave_few_free_positions():
    free = max(64 - (a | b | c | d).bit_count() for a in covering_masks(3, 0)[:4] for b in covering_masks(3, 1)[:4] for c in covering_masks(3, 2)[:4] for d in covering_masks(3, 3))
    assert free <= 12  # at most 2^12 distinct fingerprints in the largest last bucket


@pytest.mark.parametrize("bucket", [4096, 5])
def test_links_connect_what_brute_force_connects(spark, bucket):
    rng = random.Random(7)
    prints = {}
    for i in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints[len(prints)] = x
    fps = spark.createDataFrame([(_signed(x),) for x in set(prints.values())], "fp long")
    links = [(a % 2**64, b % 2**64) for a, b in near_pairs(fps, Stash(spark, "t"), bucket=bucket).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    values = sorted(set(prints.values()))
    brute, got = groups(dict(zip(values, values))), {v: v for v in values}
    for _ in range(len(values)):
        before = dict(got)
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
        if got == before:
            break
    assert len({frozenset(v for v in values if got[v] == r) for r in set(got.values())}) == len(set(brute.values()))


def test_groups_match_brute_force_with_nulls_ties_and_repeats(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "hi", "hi", "HI"]
    for _ in range(12):
        words = [rng.choice("the a of and to in is it on as".split()) + str(rng.randrange(99)) for _ in range(300)]
        texts += [" ".join(words), " ".join(words).upper(), " ".join(words[:-1] + ["other"]), " ".join(words) + " tail"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "HI")]
    got = simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    want = groups({i: plain(t) for i, t in rows})
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{plain(t):016x}", want[i]) for i, t in rows)


def test_empty_table_and_clashing_columns(spark):
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([(2, "a b", 1, 1, "f"), (1, "a b", 2, 2, "g"), (None, "c", 3, 3, "h"), (None, "c", 3, 3, "h")], "doc_id long, text string, fp int, component_id int, fingerprint string")
    assert sorted(((r.doc_id or -1), r.component_id) for r in keep_one_of_each(odd).collect()) == [(-1, 3), (1, 2)]
    assert {(r.doc_id, r.component_id) for r in simhash_groups(odd).collect()} == {(1, 1), (2, 1), (None, None)}


def test_within_is_a_spanning_forest():
    import numpy as np

    x = np.arange(600, dtype=np.int64)
    links = list(_within(x, 3))
    assert len(links) == 599


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(9)
    words = [[rng.choice("the a of and to in is it on as".split()) + str(rng.randrange(99)) for _ in range(300)] for _ in range(4)]
    a, b, c, d = (" ".join(w) for w in words)
    near = lambda t: t + " tail"
    assert all((fingerprint(t) ^ fingerprint(near(t))).bit_count() <= 3 for t in (a, c))
    rows = [(5, a, "x"), (3, near(a), "y"), (5, b, "z"), (5, b, "z"), (None, c, "u"), (None, near(c), "v"), (None, c, "u"), (7, d, None), (8, None, None), (9, "", None)]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string").repartition(3)).collect()
    assert len(kept) == 5 and {(r.doc_id, r.text) for r in kept} >= {(3, near(a)), (5, b), (7, d), (8, None)}
    assert [r.text in (c, near(c)) for r in kept if r.doc_id is None] == [True]


def test_a_very_long_text_has_the_fingerprint_of_a_plain_count():
    text = " ".join(f"w{i % 977} é{i}" for i in range(30_000))
    assert fingerprint(text) == plain(text)

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from corpusmill.llm.packing import Packing, pack, pack_documents, step_groups
from corpusmill.llm.tokens import WordEncoder

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encoder_gives_the_ids_of_the_library():
    rng, encoder = random.Random(2), WordEncoder(most=50)
    letters = "aBÉéßÄ 'sred.,#0123 \n\tĀɏŉİ²½ªÿ÷×<|>'\x1c  é"
    texts = ["", "a<|endoftext|>b", "x <|startoftext|> y", "it's ok's 's", "naïve ﬁ Å", "ΑΣ ΑΣ.", "日本 語"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(3000)]
    for text in texts:
        assert encoder.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_of_another_vocabulary():
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = WordEncoder("byte_bpe_50k.json")
    for text in ("", "Hello  World\n", "naïve café"):
        assert encoder.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_every_token_lies_in_one_piece_and_no_sequence_is_padded(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 30, 300, 500, 511, 512, 513, 2000, 4096, 4097, 9000]) + rng.randrange(40) for _ in range(rng.randrange(1, 200))]
    sequences, rest = pack(lengths)
    assert rest == []
    covered = defaultdict(list)
    for s in sequences:
        total = sum(n for *_, n in s)
        assert total & total - 1 == 0 and 1 <= total <= 4096
        for doc, start, n in s:
            covered[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(covered[doc]):
            assert start == at and k > 0
            at += k
        assert at == n


def test_gaps_take_whole_shorter_documents_first():
    sequences, _ = pack([3000, 700, 396])
    assert sequences == [[(0, 0, 3000), (1, 0, 700), (2, 0, 396)]]
    sequences, rest = pack([3000, 500], last=False)
    assert sequences == [] and rest == [(0, 0, 3000), (1, 0, 500)]


def test_short_documents_stay_in_short_windows():
    sequences, _ = pack([256] * 8)
    assert [sum(n for *_, n in s) for s in sequences] == [512] * 4


def test_step_groups_are_full_and_even():
    rng = random.Random(0)
    costs = [rng.randrange(1, 1000) for _ in range(160)]
    groups = step_groups(costs, 16)
    sums = defaultdict(int)
    for c, g in zip(costs, groups):
        sums[g] += c
    assert sorted(groups.count(g) for g in set(groups)) == [16] * 10
    assert max(sums.values()) < 1.1 * min(sums.values())


@pytest.mark.parametrize("window", [1 << 21, 900])
def test_query_round_trip(spark, window):
    rng = random.Random(9)
    texts = [None, "", "short", "The same.", "The same.", *(" ".join(rng.choice("rain boat quay storm harbour".split()) for _ in range(rng.choice([5, 400, 3000]))) for _ in range(40)), "long word " * 20_000]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    pieces = pack_documents(docs, Packing(window_tokens=window), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, text, _ in rows:
        parts = sorted(by_doc[doc_id], key=lambda p: p.start)
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        assert [i for p in parts for i in p.ids] == ids and {p.doc_tokens for p in parts} == {len(ids)}
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at & at - 1 == 0 and at <= 4096 and {p.tier for p in parts} == {at} and len({p.step_group for p in parts}) == 1
    assert pack_documents(docs.limit(0)).collect() == []


def test_step_groups_are_full_across_flushes(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("rain boat quay storm harbour".split()) for _ in range(rng.randrange(1, 900)))) for i in range(300)]
    pieces = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), Packing(window_tokens=3000, step_tokens=8192)).collect()
    groups = defaultdict(set)
    for p in pieces:
        groups[p.tier, p.step_group].add(p.sequence_id)
    under = defaultdict(int)
    for (tier, group), members in groups.items():
        assert len(members) <= 8192 // tier
        under[tier, group >> 33] += len(members) < 8192 // tier
    assert max(under.values()) == 1 and len(groups) > 20


def test_tiers_are_checked():
    with pytest.raises(ValueError):
        Packing(tiers=(512, 1000))

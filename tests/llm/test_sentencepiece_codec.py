import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from corpusmill.llm.sentencepiece_codec import _UNIGRAM, Codec, decode_documents, encode_documents

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
CODEC = Codec()
LETTERS = "abcdefthe   \n\tÀé日本😀.,0123ingTHE_-()"


@pytest.fixture(scope="module")
def codec():
    return Codec(most=200)


def test_ids_are_those_of_the_library_and_come_back(codec):
    rng = random.Random(1)
    texts = ["", " ", "   two  spaces ", "tab\there", "éñ", "a" * 300] + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(4000)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == LIBRARY.encode(text), repr(text)
        assert codec.decode(ids) == text


def test_decoding_is_that_of_the_library(codec):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice(range(3, 3000)) for _ in range(rng.randrange(8))]
        valid = [i for i in ids if not 131 <= i < 259]  # bytes that are no UTF-8 are replaced one way or another
        assert codec.decode(valid) == LIBRARY.decode(valid)


def test_viterbi_finds_the_best_sum_of_scores():
    """The unigram reading against all segmentations."""
    codec = Codec()
    codec.kind = _UNIGRAM
    for text in ("▁there", "▁station", "▁whéther", "▁ingoin"):
        cut = [[text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)))] for n in range(len(text)) for cuts in combinations(range(1, len(text)), n)]
        best = max(sum(codec.score[codec.usable[p]] for p in parts) for parts in cut if all(p in codec.usable for p in parts))
        assert sum(codec.score[i] for i in codec.viterbi(text)) == best


def test_stretches_give_what_the_whole_text_gives(codec):
    text = "  The quick  brown\nfox, don't   stop -- 日本語,é"
    whole = codec.normalize(text)
    assert "".join(codec.stretches(whole)) == whole and len(codec.stretches(whole)) > 8
    assert codec.viterbi(whole) == codec.encode(text) == LIBRARY.encode(text)


def test_both_ways_of_scoring_merges_give_the_library_s_ids():
    rng, by_scores = random.Random(3), Codec(wide=0)
    for text in ["a" * 700, "=" * 70, "aaaaa", "ab" * 400, "x" + "   " * 9] + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(80))) for _ in range(1500)]:
        assert by_scores.encode(text) == LIBRARY.encode(text) == Codec.encode(CODEC, text), repr(text)


def test_merge_orders_are_scores_that_decide():
    """The best sum over all segmentations, where a piece counts its merges, each more than all later ones together."""
    def merges(word, at):
        i = CODEC.usable[word]
        if len(word) == 1:
            return []
        k = CODEC._merged(word)[1]
        return sorted([(-CODEC.score[i], at), *merges(word[:k], at), *merges(word[k:], at + k)])

    never = [(float("inf"), 0)]  # a merge more is better than none
    for text in ("▁thereby", "▁stations", "▁ingoing", "aaaaaaa", "▁anlyouin"):
        cuts = [(0, *c, len(text)) for n in range(len(text)) for c in combinations(range(1, len(text)), n)]
        cuts = [c for c in cuts if all(text[a:b] in CODEC.usable for a, b in zip(c, c[1:]))]
        best = min(cuts, key=lambda c: sorted(m for a, b in zip(c, c[1:]) for m in merges(text[a:b], a)) + never)
        assert CODEC.viterbi(text) == [CODEC.usable[text[a:b]] for a, b in zip(best, best[1:])]


def test_query_on_nulls_repeats_clashes_and_an_empty_table(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a ▁ b", 3), (4, "same", 4), (4, "same", 4), (None, "long words 日 " * 5000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = encode_documents(docs, with_ids=True)
    for r in found.collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = LIBRARY.encode(text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.restored == ("▁" not in text)
    back = {r.doc_id: r.text for r in decode_documents(found).collect()}
    assert back[None] == rows[-1][1] and back[1] == back[2] == "" and back[3] == "a   b"
    assert encode_documents(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, [3, None, -4, 10**6], "x"), (1, [], "x"), (None, None, "x")], "doc_id long, ids array<int>, text string")
    assert sorted((r.doc_id or 0, r.text) for r in decode_documents(odd).collect()) == [(0, ""), (1, ""), (1, CODEC.text[3] if 3 not in CODEC.special else "\x00")]
    assert decode_documents(odd.limit(0)).collect() == []

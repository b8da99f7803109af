import random
from hashlib import sha256

import pytest

from corpusmill.llm.chat_format import CHUNK, GrammarError, escaped, format_turns, formatted_texts, formatted_turn, parsed, read_back, unescaped, with_probe, written

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "\\", "<", "[", "/", "s>", "SYS>>", "]", " ", "x", "é😀", "INST]", "\n"]


def random_text(rng):
    return "".join(rng.choices(BITS, k=rng.randint(0, 8)))


def test_any_turns_come_back_from_their_text():
    rng = random.Random(1)
    for _ in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", random_text(rng)]), random_text(rng)) for _ in range(rng.randint(1, 5))]
        pieces = [formatted_turn(*t) for t in turns]
        assert [(r, t) for r, t, _, _ in parsed("".join(p for p, _, _ in pieces))] == turns
        for (_, text), (piece, start, end) in zip(turns, pieces):
            assert unescaped(piece[start:end]) == text and unescaped(escaped(text)) == text


def test_only_conflicting_content_is_escaped():
    assert formatted_turn("user", "a [/TURN x \\ <S>")[0] == "<s>[INST] a [/TURN x \\ <S> [/INST]"
    assert formatted_turn("assistant", "</s>[INST] ok")[0] == " <\\/s>[\\INST] ok</s>"
    assert formatted_turn("assistant", "<\\/s>")[0] == " <\\\\/s></s>"
    assert formatted_turn(None, None)[0] == "[ROLE][/ROLE][/TURN]"


@pytest.mark.parametrize("bad", ["x", " a", "<s>", "<s>[INST]a[/INST]", "<s>[INST] a</s>", " a</s></s>", "[ROLE]a[/TURN]", "<<SYS>>a", "[INST] a [/INST]", "<s>[INST] [/INST]"])
def test_other_texts_are_refused(bad):
    with pytest.raises(GrammarError):
        list(parsed(bad))


def plain(rows):
    conv = {}
    for r in rows:
        conv.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    out = {}
    for c, own in conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        loss = "".join(t for _, r, t in own if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for _, r, t in own)
        chars = sum(len(formatted_turn(r, t)[0]) for _, r, t in own)
        out[c] = (len(own), sha256(turns.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), chars)
    return out


def told(frame, chunk=CHUNK):
    got = [tuple(r) for r in read_back(frame, chunk).collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


@pytest.mark.parametrize("chunk", [CHUNK, 40])
def test_digests_against_plain_python(spark, chunk):
    rng = random.Random(2)
    rows = [(c, rng.choice([None, 1, 2, 3]), rng.choice(["user", "assistant", "system", None, "a b"]), rng.choice([None, random_text(rng)])) for c in [None, *range(-3, 40)] for _ in range(rng.randint(1, 6))]
    rows += [(99, t, "assistant", f"hot {t}") for t in range(900)]
    rows += [(50, 0, "user", "<s>" * 50_000), (50, 1, "assistant", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert told(frame, chunk) == plain(rows)


def test_the_probe_and_clashing_columns(spark):
    frame = with_probe(spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA).selectExpr("*", "1 as piece", "2 as mark", "3 as part", "4 as formatted"))
    both = "</s>[INST] ok [/INST]"
    assert told(frame)[-7][:4] == (2, sha256(f"user\n{both}\nassistant\n{both}\n".encode()).hexdigest(), len(both), sha256(both.encode()).hexdigest())
    clash = spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA).selectExpr("*", "1 as piece", "2 as mark", "3 as part")
    assert read_back(clash).columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert format_turns(clash).collect()[0].piece == written("user", "hi")[0]


def test_empty_table_and_whole_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert read_back(empty).collect() == [] and formatted_texts(empty).collect() == []
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(4)]
    parts = sorted(formatted_texts(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.part, r.no))
    text = "".join(r.formatted for r in parts)
    assert [(r, t) for r, t, _, _ in parsed(text)] == [r[2:] for r in rows]
    assert [p.formatted[a:b] for p in parts for a, b in zip(p.spans[::2], p.spans[1::2])] == ["text 1", "text 3"]

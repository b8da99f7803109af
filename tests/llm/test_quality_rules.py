import random

import pytest

from corpusmill.llm.quality_rules import LineRules, _mark, clean_lines, judge, keep_good, line_fault, neighbours, quality_rules, shared_lines

SCHEMA = "doc_id long, text string"
SPACE = set(" \t\n\x0b\x0c\r")


def plain(text):
    """The base columns, word by word and window by window."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if set(x) - SPACE and x in lines[:i])
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Ünder", "x|", "a#", "$5", "and.", "b c", "naïve", "!", "<b>", "z" * 30]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "  ", "\r\n", " "]) for _ in range(rng.randrange(160)))


@pytest.mark.parametrize("text", [None, "", " \n\n", "one", "a a", "a a a", "a a a a", "x y z x y z", *map(sample, range(30))])
def test_base_columns_match_a_plain_count(text):
    assert judge(text)[:6] == plain(text)


PROSE = "Rain fell over the harbour while the boats came in, and nobody on the quay spoke of the storm."


@pytest.mark.parametrize(
    "line, fault",
    [
        (PROSE, None),
        ("", None),
        ("A short one.", None),
        ("Licensed under the Apache License, Version 2.0.", None),
        ("Home | News | Sport | Weather | Contact", "navigation"),
        ("Home | News", "stub"),
        ("We use cookies, see our privacy policy.", "boilerplate"),
        ("----------", "no_letters"),
        ("rain### fell&&& over$$$ the*** harbour%%% today", "symbols"),
        ("rain!! fell!! over!! the!! harbour!!", "punctuation"),
        ("BUY NOW THE BEST OF ALL DEALS", "shouting"),
        ("rain rain rain rain rain rain", "stutter"),
    ],
)
def test_line_rules(line, fault):
    assert line_fault(line) == fault


def test_cleaning_drops_failing_and_repeated_lines_only():
    text = f"{PROSE}\nHome | News | Sport | Weather | Contact\n\n{PROSE}\nEnd of it."
    assert clean_lines(text) == (f"{PROSE}\n\nEnd of it.", 9 + 19)


def test_verdict_follows_the_share_of_lost_words():
    good = "\n".join(f"Line {i} says that {' '.join(f'w{i}x{j}' for j in range(12))} is so." for i in range(8))
    menu = "\n".join(f"m{i} | n{i} | o{i} | p{i} | q{i}" for i in range(30))
    assert judge(good)[5:7] == (False, True)
    assert judge(f"{good}\n{menu}")[5:7] == (False, False)
    assert judge(f"{good}\n{menu}", LineRules(max_lost_share=0.99))[5:7] == (False, True)


def test_query_on_nulls_repeats_clashes_and_an_empty_table(spark):
    good = " ".join(f"w{i}" for i in range(80)) + "."
    rows = [(1, None, 5), (2, "", 5), (3, good, 5), (3, good, 5), (None, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality_rules(docs).collect())
    assert got == [(0, 80, False, True), (1, 0, True, False), (2, 0, True, False), (3, 80, False, True), (3, 80, False, True)]
    assert sorted(map(str, keep_good(docs).collect())) == sorted(map(str, docs.where("length(text) > 0").collect()))
    assert quality_rules(docs.limit(0)).collect() == [] and keep_good(docs.limit(0)).collect() == []


def test_very_long_text():
    words = [f"w{i % 50000}" for i in range(300_000)]
    assert judge(" ".join(words))[4] == 300_000


def test_failing_lines_are_gone_from_the_stage_s_output(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    stage = dict(pipeline.STAGES)["quality_rules"]
    good = "\n".join(f"Line {i} says that {' '.join(f'w{i}x{j}' for j in range(12))} is so." for i in range(8))
    mixed = f"{good}\nHome | News | Sport | Weather | Contact\nAll rights reserved.\n\n{good.splitlines()[0]}\nEnd of it."
    menu = "\n".join(f"m{i} | n{i} | o{i} | p{i} | q{i}" for i in range(30))
    rows = [(len(mixed), "x", mixed, 1), (None, None, mixed, None), (7, "y", good, 3), (9, "z", f"{good}\n{menu}", 4)]
    got = stage(spark, spark.createDataFrame(rows, "n_chars long, lang string, text string, doc_id long"), "").collect()
    clean = f"{good}\n\nEnd of it."
    assert [tuple(r) for r in got] == [(len(clean), "x", clean, 1), (len(clean), None, clean, None), (7, "y", good, 3)]


@pytest.mark.parametrize("line", ["JavaScript is a programming language that many people learn first.", "He asked her to sign in at the desk before going upstairs.", "She read more books that year than ever before."])
def test_prose_with_words_of_the_phrases_stays(line):
    assert line_fault(line) is None


def test_lines_that_many_documents_share_go_in_any_language(spark):
    own = lambda i, k: f"Satz {i} sagt, dass {' '.join(f'w{i}x{k}x{j}' for j in range(10))} so ist."
    site = [(i, "\n".join([own(i, 0), own(i, 1), "Alle Rechte vorbehalten", *(own(i, k) for k in range(2, 6))])) for i in range(40)]
    copies = [(100 + i, "\n".join(own(999, k) for k in range(7))) for i in range(60)]
    passage = [(300 + i, "\n".join([own(i + 50, 0), "Erste Zeile der Stelle", "Zweite Zeile der Stelle", *(own(i + 50, k) for k in range(1, 6))])) for i in range(40)]
    docs = spark.createDataFrame(site + copies + passage, SCHEMA)
    assert shared_lines(docs) == {_mark("Alle Rechte vorbehalten")}
    got = {r.doc_id: r.text for r in keep_good(docs).collect()}
    assert len(got) == 140 and all("Alle Rechte" not in t for t in got.values())
    assert got[100] == copies[0][1] and got[300] == passage[0][1]
    few = spark.createDataFrame(site[:19], SCHEMA)
    assert shared_lines(few) == frozenset() and shared_lines(docs.limit(0)) == frozenset()
    assert all(r.n_lost_words == 3 * (r.doc_id < 40) for r in quality_rules(docs).collect())


def test_neighbours_of_long_and_repeated_lines():
    text = "a b\n\n" + "x " * 30 + "\na b\n" + "y" * 100_000
    assert [m[0] for m in neighbours(text)] == [_mark("a b"), _mark("y" * 100_000)] and next(neighbours(text))[1] == _mark("y" * 100_000)
    assert list(neighbours("Yes.\nOf course!\n“So it is.”")) == []
    assert list(neighbours(None)) == [] and list(neighbours(" \n\t")) == []

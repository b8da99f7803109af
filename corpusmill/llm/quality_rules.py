"""Line-first quality rules: judge every line, drop the failing ones, reject texts that lose too much.

Boilerplate is told by the corpus itself, in any language: a short line that ends like no sentence and that many documents hold, each
beside other lines. Short sentences recur in prose, and copies and shared passages keep a line's neighbours, so they make none. A line that is to a large part made of a few fixed phrases is
boilerplate as well.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Phrases of site furniture, sought in lower-cased lines of at most `furniture_words` words.
FURNITURE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "use of cookies",
    "javascript", "lorem ipsum", "click here", "read more", "sign in", "sign up", "log in", "subscribe", "newsletter",
    "share this", "skip to content", "back to top", "follow us", "previous page", "next page",
)

BARS = "|»›•·>/"
_BARS = re.compile(rf"(?<!\S)[{BARS}](?!\S)")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_TAILS = re.compile(r"[^\s#*$%&|<>][#*$%&|<>]{2,}[.,;:!?]*(?!\S)")
_SENTENCE = re.compile(r"[.!?…][\"'»”’)\]]*$")
_ENDS = re.compile(r"[.!?…:;,\"'»”’)\]]$")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules. Shares are of the line's words; a share counts only from `share_words` words on.

    A line of at most furniture_words words without a sentence's end is shared if shared_documents documents hold it, and a part of shared_part of all, and
    neither the line before it nor the one after it is the same in over shared_neighbour of them.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    bar_share: float = 0.2
    symbol_share: float = 0.2
    exclaim_share: float = 0.3
    stutter_share: float = 0.4
    upper_share: float = 0.7
    share_words: int = 5
    furniture_words: int = 20
    furniture_share: float = 0.25
    shared_documents: int = 20
    shared_part: float = 1 / 2000
    shared_neighbour: float = 0.25
    stub_words: int = 3
    max_lost_share: float = 0.3


NONE: frozenset[int] = frozenset()


def _mark(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def line_fault(line: str, rules: LineRules = LineRules(), shared: frozenset[int] = NONE) -> str | None:
    """The rule that a line fails, or None. Lines without a word fail none. shared: marks of the lines that many documents hold."""
    words = line.encode().split()
    n = len(words)
    if not n:
        return None
    if not any(c.isalnum() for c in line):
        return "no_letters"
    if n <= rules.furniture_words:
        low = line.lower()
        if any(map(low.__contains__, FURNITURE)) and sum(low.count(p) * (p.count(" ") + 1) for p in FURNITURE) >= rules.furniture_share * n:
            return "boilerplate"
        if shared and not _SENTENCE.search(line.rstrip(SPACE)) and _mark(line) in shared:
            return "boilerplate"
    if n < rules.share_words:
        return "stub" if n <= rules.stub_words and len(_BARS.findall(line)) >= 1 and not _ENDS.search(line.rstrip(SPACE)) else None
    if any(map(line.__contains__, BARS)) and len(_BARS.findall(line)) >= rules.bar_share * n:
        return "navigation"
    if _SYMBOL.search(line) and len(_TAILS.findall(line)) >= rules.symbol_share * n:
        return "symbols"
    if "!!" in line and line.count("!!") >= rules.exclaim_share * n:
        return "punctuation"
    if sum(map(str.isupper, line.split())) >= rules.upper_share * n:
        return "shouting"
    if len(set(words)) <= n - rules.stutter_share * n and sum(map(eq, words, islice(words, 1, None))) >= rules.stutter_share * n:
        return "stutter"
    return None


def clean_lines(text: str | None, rules: LineRules = LineRules(), shared: frozenset[int] = NONE) -> tuple[str, int]:
    """The text without its failing lines and without lines equal to an earlier one; and the words that went."""
    seen: set[str] = set()
    lost, kept = 0, []
    for line in (text or "").split("\n"):
        if line.strip(SPACE):
            if line in seen or line_fault(line, rules, shared):
                lost += len(line.encode().split())
                continue
            seen.add(line)
        kept.append(line)
    return "\n".join(kept), lost


def _repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of `width` words that the text has twice or more, the first such window included."""
    n = len(words)
    if n <= width:
        return 0
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__  # a word's number is how many came before it
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    key = ids[: n - width + 1]
    for k in range(1, width):
        key = key * len(known) + ids[k : n - width + 1 + k]
        if len(known) > 1 << 20:  # keeps the product within 63 bits
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : k + len(key)] |= twice
    return int(covered.sum())


Verdict = tuple[int, int, int, int, int, bool, bool, int]


def judge_and_clean(text: str | None, rules: LineRules = LineRules(), shared: frozenset[int] = NONE) -> tuple[Verdict, str]:
    """The columns of `judge`, and the text without the lines that `clean_lines` drops, or as it was if base_failed."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    repeat = _repeat_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    clean, lost = (text, 0) if failed else clean_lines(text, rules, shared)
    return (n, chars, symbols, dup, repeat, failed, not failed and lost <= rules.max_lost_share * n, lost), clean


def judge(text: str | None, rules: LineRules = LineRules(), shared: frozenset[int] = NONE) -> Verdict:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words of a whole text."""
    return judge_and_clean(text, rules, shared)[0]


def neighbours(text: str | None, rules: LineRules = LineRules()) -> Iterator[tuple[int, int, int]]:
    """(mark, mark of the line before, mark of the line after) of each short line of a text that ends like no sentence, where it first stands.

    The last line stands before the first.
    """
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    seen: set[str] = set()
    for k, x in enumerate(lines):
        if x not in seen and not _SENTENCE.search(x.rstrip(SPACE)) and len(x.encode().split()) <= rules.furniture_words:
            seen.add(x)
            yield _mark(x), _mark(lines[k - 1]), _mark(lines[(k + 1) % len(lines)])


def shared_lines(docs: DataFrame, rules: LineRules = LineRules()) -> frozenset[int]:
    """(text, ...) -> marks of the shared lines: no more than a document's mean number of lines by shared_part, at any size.

    All documents are counted. Only hashes are shuffled, combined first; a line of a third of all documents is one number a task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in (b.column(0)[k : k + 256] for k in range(0, b.num_rows, 256)):
                found = [x for t in texts for x in neighbours(t.as_py(), rules)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 3)], ["line", "before", "after"])

    lines = docs.select("text").mapInArrow(run, "line long, before long, after long")
    sided = lines.select("line", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("other")), F.struct(F.lit(1).alias("side"), F.col("after").alias("other")))).alias("x"))
    pairs = sided.groupBy("line", "x.side", "x.other").agg(F.count("*").alias("c"))
    sides = pairs.groupBy("line", "side").agg(F.sum("c").alias("n"), F.max("c").alias("top")).where(F.col("n") >= rules.shared_documents)
    told = sides.groupBy("line").agg(F.max("n").alias("n"), F.max("top").alias("top")).where(F.col("top") <= rules.shared_neighbour * F.col("n"))
    total = docs.agg(F.count("*").alias("total"))  # one row
    return frozenset(r.line for r in told.join(F.broadcast(total)).where(F.col("n") >= rules.shared_part * F.col("total")).select("line").collect())


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long"


def quality_rules(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(doc_id, text, ...) -> doc_id and the columns of `judge`, a row for each row.

    Null text: no words, base_failed. Repeated rows stay; nulls in doc_id pass through; other columns, whatever
    their names, are not read. An empty table gives no rows. Lines are counted over all texts first; then each text is judged where it is read.
    """
    kinds = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.bool_()) for c in COLUMNS.split(", ")])
    shared = shared_lines(docs, rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t.as_py(), rules, shared) for t in b.column(1)]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, kinds))], ["doc_id", *kinds.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def keep_good(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows whose text is kept, with all their columns, whatever their names; failing and repeated lines are gone from text.

    Null, empty and short texts go (base_failed); a null doc_id is judged like any other; repeated rows all stay or all go.
    A long column n_chars, if there, follows the new text. An empty table gives no rows. Lines are counted over all texts; judging,
    cleaning and filtering is one more pass, and no text is shuffled.
    """
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None
    shared = shared_lines(docs, rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [judge_and_clean(t.as_py(), rules, shared) for t in b.column(at)]
            b = b.filter(pa.array([v[6] for v, _ in judged], pa.bool_()))
            old, new = b.column(at).to_pylist(), [clean for v, clean in judged if v[6]]
            columns = list(b.columns)
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                columns[size] = pa.array([n if x == y else len(y) for n, x, y in zip(columns[size].to_pylist(), old, new)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)

"""Chat formatting by a grammar that is read back: what does not come back as it was is escaped until it does.

A formatted conversation is its turns' pieces, one after the other:

    user        <s>[INST] text [/INST]
    assistant   (space)text</s>
    system      <<SYS>>text<</SYS>>
    any other   [ROLE]role[/ROLE]text[/TURN]

`parsed` reads such a text in one pass without choices: it goes from one control string to the next and refuses one out of
place. A piece is first written with its text as it is, and parsed. If the turn that comes back is another one, or none, its
contents conflict with the grammar and are escaped: a control string gets a backslash after its first character, one more if it has some.
Parsing takes one away again. Since every piece closes what it opens, and no control string begins with the end of
another, pieces that come back alone come back side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Stash, turn_mark
from corpusmill.operators.folds import walked

#: What follows the first character of a control string.
_ANGLE, _SQUARE = r"/?s>|</?SYS>>", r"/?INST\]|/?ROLE\]|/TURN\]"
_CONTROL = re.compile(rf"<(?:{_ANGLE})|\[(?:{_SQUARE})")
_BARE = re.compile(rf"<(?=\\*(?:{_ANGLE}))|\[(?=\\*(?:{_SQUARE}))")
_ESCAPED = re.compile(rf"<\\(?=\\*(?:{_ANGLE}))|\[\\(?=\\*(?:{_SQUARE}))")

CHUNK = 1 << 18
Turn = tuple[str, str]


class GrammarError(ValueError):
    """A text that is no formatted conversation."""


def escaped(text: str) -> str:
    """The text with a backslash more in each of its control strings, whether they have some or none."""
    return _BARE.sub(r"\g<0>\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text) if "\\" in text else text


def written(role: str, text: str) -> tuple[str, int]:
    """A turn's piece, and where in it the text begins."""
    if role == "user":
        return f"<s>[INST] {text} [/INST]", 10
    if role == "assistant":
        return f" {text}</s>", 1
    if role == "system":
        return f"<<SYS>>{text}<</SYS>>", 7
    return f"[ROLE]{role}[/ROLE]{text}[/TURN]", 13 + len(role)


def parsed(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted conversation; the text is unescaped, its span is not."""
    marks = _CONTROL.finditer(formatted)
    at, size = 0, len(formatted)

    def expect(mark: str, where: int | None = None) -> int:
        """The end of the next control string, which must be this one, and begin there."""
        nonlocal at
        m = next(marks, None)
        if m is None or m[0] != mark or where not in (None, m.start()):
            raise GrammarError(f"{mark} expected from character {at} on")
        at = m.end()
        return m.start()

    while at < size:
        if formatted.startswith("<s>", at):
            expect("<s>", at)
            expect("[INST]", at)
            start, close = at + 1, expect("[/INST]")
            if formatted[start - 1] != " " or close <= start or formatted[close - 1] != " ":
                raise GrammarError("spaces expected around a user's text")
            yield "user", unescaped(formatted[start : close - 1]), start, close - 1
        elif formatted[at] == " ":
            start, close = at + 1, expect("</s>")
            yield "assistant", unescaped(formatted[start:close]), start, close
        elif formatted.startswith("<<SYS>>", at):
            expect("<<SYS>>", at)
            start, close = at, expect("<</SYS>>")
            yield "system", unescaped(formatted[start:close]), start, close
        else:
            expect("[ROLE]", at)
            start, close = at, expect("[/ROLE]")
            role = unescaped(formatted[start:close])
            start, close = at, expect("[/TURN]")
            yield role, unescaped(formatted[start:close]), start, close


def formatted_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn's piece that parses to just this turn, and the span of its text there, still escaped."""
    role, text = role or "", text or ""
    as_role, as_text = role, text
    for _ in range(2):
        piece, start = written(as_role, as_text)
        try:
            back = [(r, t) for r, t, _, _ in parsed(piece)]
        except GrammarError:
            back = []
        if back == [(role, text)]:
            return piece, start, start + len(as_text)
        # the grammar's own role names are compared as they are written; any other role and all texts can be escaped
        as_role, as_text = role if role in ("user", "assistant", "system") else escaped(role), escaped(text)
    raise GrammarError(f"a turn of role {role!r} does not come back")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> conv_id, turn, piece, loss_start, loss_end: a row for each row, where it is read.

    A conversation's formatted text is its pieces in order of turn. The loss mask is an assistant's text, as code points of the
    piece (both ends 0 for others). Null role and text are empty. Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, starts, ends = [], [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                piece, start, end = formatted_turn(role, text)
                on = role == "assistant"
                pieces.append(piece)
                starts.append(start if on else 0)
                ends.append(end if on else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["conv_id", "turn", "piece", "loss_start", "loss_end"])

    kind = lambda c: turns.schema[c].dataType.simpleString()
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind('conv_id')}, turn {kind('turn')}, piece string, loss_start long, loss_end long")


class _Reader:
    """Digests of a conversation, read back from its formatted text as it comes."""

    def __init__(self):
        self.turns, self.loss, self.n, self.on, self.chars = sha256(), sha256(), 0, 0, 0

    def take(self, formatted: str, spans: list[int]) -> None:
        for role, text, _, _ in parsed(formatted):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        for start, end in zip(spans[::2], spans[1::2]):
            under = unescaped(formatted[start:end])
            self.loss.update(under.encode("utf-8", "surrogatepass"))
            self.on += len(under)
        self.chars += len(formatted)

    def told(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.on, self.loss.hexdigest(), self.chars


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TEXT = "conv_id long, part long, no long, formatted string, spans array<long>"
_TEXT_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))


def formatted_texts(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> conv_id, part, no, formatted, spans: conversations' texts in order of (part, no), with the loss mask.

    Turns go by turn, null first, equal ones by a digest of role and text. Rows are dealt to ranges of this order and joined there,
    so a conversation is one row unless its range ends or the text exceeds `chunk` characters, and a long one is cut like any
    others. spans holds starts and ends of the mask in code points of the row's text. A task holds one row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, held, spans, size, no, full = None, None, [], [], 0, 0, 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, spans, size, no, full
            out.append((conv, part, no, "".join(held), spans))
            held, spans, size, no, full = [], [], 0, no + 1, full + size

        def batch() -> pa.RecordBatch:
            nonlocal full
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            full = 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TEXT_KINDS)], ["conv_id", "part", "no", "formatted", "spans"])

        for b in batches:
            for c, p, piece, start, end in zip(*(x.to_pylist() for x in b.columns)):
                if held and (c != conv or size > chunk):
                    close()
                    if full > chunk or len(out) >= 1024:
                        yield batch()
                conv, part = c, p
                if end:
                    spans += [size + start, size + end]
                held.append(piece)
                size += len(piece)
        if held:
            close()
        yield batch()

    order = ["conv_id", "turn", "mark"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("mark", turn_mark(F.col("role"), F.col("text")))
    pieces = format_turns(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    return pieces.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "piece", "loss_start", "loss_end").mapInArrow(run, _TEXT)


def read_back(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, told from the formatted texts alone.

    A range tells of the conversations that lie within it. Those at its borders, which other ranges may share, and those of
    more than `chunk` characters are handed on and read by one task each, a chunk at a time, as their digests need.

    Null role and text are empty, a null conv_id is a conversation of its own, repeated rows are turns. Other columns, whatever
    their names, are not read. An empty table gives no rows.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), *_TEXT_KINDS[1:])
    names = ["conv_id", *(d.split()[0] for d in DIGESTS.split(", ")), "part", "no", "formatted", "spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        seen, size, on = 0, 0, False  # conversations begun; on: the one at hand is handed on

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def hand_on() -> None:
            out.extend((r[0], *[None] * 5, *r[1:]) for r in held)
            held.clear()

        conv = None
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns)):
                if not seen or row[0] != conv:
                    seen += 1
                    if held:  # neither the first nor the last of the range, and whole
                        reader = _Reader()
                        for r in held:
                            reader.take(r[3], r[4])
                        out.append((conv, *reader.told(), *[None] * 4))
                        held.clear()
                    size, on = 0, False
                conv = row[0]
                held.append(row)
                size += len(row[3])
                on = on or seen == 1 or size > chunk
                if on:
                    hand_on()
                if len(out) >= 1024 or on:
                    yield batch()
        hand_on()
        yield batch()

    def digested(ordered: Iterator[tuple]) -> Iterator[tuple]:
        reader = _Reader()
        for _, _, _, formatted, spans in ordered:
            reader.take(formatted, spans)
        yield reader.told()

    stash = Stash(turns.sparkSession, "chats")
    told, _ = stash.put(formatted_texts(turns, chunk).mapInArrow(run, f"conv_id long, {DIGESTS}, part long, no long, formatted string, spans array<long>"))
    rest = walked(told.where("part is not null").select("conv_id", "part", "no", "formatted", "spans"), ["conv_id"], ["part", "no"], digested, f"conv_id long, {DIGESTS}", give=1024)
    return told.where("part is null").select("conv_id", *names[1:6]).unionByName(rest)


#: The conversation that the query adds: its texts hold the grammar's own control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)

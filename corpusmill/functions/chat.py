"""Column functions over `messages`, an array<struct<role, content>>: texts, flags and byte-token counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import let

MESSAGES = "array<struct<role:string,content:string>>"

#: The chat markup, and the byte tokenizer's ids beyond the 256 bytes.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BOS_ID, EOS_ID = 256, 257


def roles(m: Column) -> Column:
    return F.transform(m, lambda x: x["role"])


def _contents(m: Column) -> Column:
    return F.transform(m, lambda x: x["content"])


def has_assistant(m: Column) -> Column:
    """The condition that makes a conversation an example."""
    return F.coalesce(F.exists(m, lambda x: x["role"] == "assistant"), F.lit(False))


def prompt_text(m: Column) -> Column:
    """Contents before the first assistant turn, joined by newlines (all of them without such a turn)."""
    first = F.array_position(roles(m), "assistant")
    n = F.when(first > 0, first - 1).otherwise(F.size(m)).cast("int")
    return F.array_join(_contents(F.slice(m, F.lit(1), n)), "\n")


def response_text(m: Column) -> Column:
    """All assistant contents, joined by newlines."""
    return F.array_join(_contents(F.filter(m, lambda x: x["role"] == "assistant")), "\n")


def joined_text(m: Column) -> Column:
    return F.array_join(_contents(m), "\n")


def side_chars(m: Column, assistant: bool) -> Column:
    """Characters of the assistant's contents, or of all others, joined by spaces."""
    side = F.filter(m, lambda x: (x["role"] == "assistant") if assistant else (x["role"] != "assistant"))
    return F.length(F.array_join(_contents(side), " "))


def answer_prefix(m: Column, words: int = 2) -> Column:
    """The first words of the first assistant turn, lower-cased; `<empty>` if there are none."""
    first = F.get(_contents(F.filter(m, lambda x: x["role"] == "assistant")), 0)
    found = F.slice(F.regexp_extract_all(F.lower(first), F.lit("[a-z0-9']+"), F.lit(0)), 1, words)
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise("<empty>")


def exact_match_prompt(m: Column) -> Column:
    """Messages before the last assistant turn as `role: content` lines."""
    flags = F.transform(m, lambda x: (x["role"] == "assistant").cast("int"))
    last = F.size(m) - F.array_position(F.reverse(flags), 1).cast("int") + 1
    n = F.when(F.array_contains(flags, 1), last - 1).otherwise(F.size(m))
    return F.array_join(F.transform(F.slice(m, F.lit(1), n.cast("int")), lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")


def last_answer(m: Column) -> Column:
    return F.element_at(_contents(F.filter(m, lambda x: x["role"] == "assistant")), -1)


def empty_target(m: Column) -> Column:
    return ~response_text(m).rlike(r"(?U)\S")


def system_not_first(m: Column) -> Column:
    return F.exists(F.slice(m, F.lit(2), F.greatest(F.size(m), F.lit(1))), lambda x: x["role"] == "system")


def consecutive_same_role(m: Column) -> Column:
    """Two user turns or two assistant turns in a row."""
    pairs = F.arrays_zip(roles(F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))).alias("a"), roles(F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0)))).alias("b"))
    return F.exists(pairs, lambda p: (p["a"] == p["b"]) & p["a"].isin("user", "assistant"))


def trailing_user_turn(m: Column) -> Column:
    return F.coalesce(F.try_element_at(roles(m), F.lit(-1)) == "user", F.lit(False))


def rendered(m: Column, generate: bool = False) -> Column:
    """The chat as marked-up text; generate adds the header of an assistant turn to come."""
    body = F.array_join(F.transform(m, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["content"], F.lit(CLOSE + "\n"))), "")
    return F.concat(body, F.lit(OPEN + "assistant\n")) if generate else body


def _total(m: Column, size) -> Column:
    return F.aggregate(m, F.lit(0).cast("long"), lambda acc, x: acc + size(x))


def total_tokens(m: Column) -> Column:
    """Byte tokens of the rendered chat and the end id."""
    fixed = len(OPEN) + 1 + len(CLOSE) + 1
    return _total(m, lambda x: F.octet_length(x["role"]) + F.octet_length(x["content"]) + fixed) + 1


def sequence_length(m: Column) -> Column:
    """Input tokens of a training row: all but the last."""
    return total_tokens(m) - 1


def supervised_tokens(m: Column) -> Column:
    """Targets with weight: assistant contents with their end marks, and the end id."""
    return _total(m, lambda x: F.when(x["role"] == "assistant", F.octet_length(x["content"]) + len(CLOSE) + 1).otherwise(0)) + 1


def supervised_tail(m: Column) -> Column:
    """Length of the run of supervised targets at the end."""
    last = F.try_element_at(m, F.lit(-1))
    return F.coalesce(F.when(last["role"] == "assistant", F.octet_length(last["content"]) + len(CLOSE) + 1), F.lit(0)).cast("long") + 1


def prompt_truncated_away(m: Column, limit: Column | int) -> Column:
    """Cut to the limit, every target left is supervised: nothing of the prompt remains."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    left = F.least(total_tokens(m), limit) - 1
    return (sequence_length(m) > limit) & (supervised_tail(m) >= left) & (left >= 1)


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes of a text as numbers."""
    # as Latin-1 a byte is a character, and a split by nothing walks once (substring would walk from the start each time)
    chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(chars, lambda c: F.ascii(c)))


def byte_text(ids: Column) -> Column:
    """The text of byte ids; ids beyond the bytes are left out, bytes that are no UTF-8 are replaced."""
    chars = F.array_join(F.transform(F.filter(ids, lambda i: i.between(0, 255)), lambda i: F.char(i)), "")
    return F.call_function("make_valid_utf8", F.encode(chars, "ISO-8859-1").cast("string"))


def segments(m: Column) -> Column:
    """array<struct<text, on>>: the rendered chat in pieces that are encoded one by one; on: supervised."""
    piece = lambda text, on: F.struct(text.alias("text"), F.lit(on).alias("on"))
    end = F.lit(CLOSE + "\n")

    def of(x: Column) -> Column:
        head = piece(F.concat(F.lit(OPEN), x["role"], F.lit("\n")), 0)
        return F.when(x["role"] == "assistant", F.array(head, piece(x["content"], 1), piece(end, 1))).otherwise(F.array(head, piece(F.concat(x["content"], end), 0)))

    return F.flatten(F.transform(m, of))


def byte_ids_of_all(texts: Column) -> Column:
    return F.transform(texts, byte_ids)


def tokens_and_mask(m: Column, encode: Callable[[Column], Column] = byte_ids_of_all, end_id: int = EOS_ID) -> Column:
    """array<struct<id, on>>: ids of the rendered chat and the end id, and 1 where a token is supervised.

    encode: array<string> -> array<array<int>>, by default bytes.
    """

    def marked(parts: Column) -> Column:
        ids = encode(F.transform(parts, lambda p: p["text"]))
        return F.flatten(F.zip_with(ids, parts, lambda x, p: F.transform(x, lambda i: F.struct(i.alias("id"), p["on"].alias("on")))))

    return F.concat(marked(segments(m)), F.array(F.struct(F.lit(end_id).alias("id"), F.lit(1).alias("on"))))


def supervised_datum(m: Column, limit: int, encode: Callable[[Column], Column] = byte_ids_of_all, end_id: int = EOS_ID) -> Column:
    """struct(input_tokens, target_tokens, weights): the last `limit` tokens, shifted by one; a target's own mask weighs it."""

    def shifted(kept: Column) -> Column:
        n = F.size(kept) - 1
        return F.struct(
            F.transform(F.slice(kept, F.lit(1), n), lambda t: t["id"]).alias("input_tokens"),
            F.transform(F.slice(kept, F.lit(2), n), lambda t: t["id"]).alias("target_tokens"),
            F.transform(F.slice(kept, F.lit(2), n), lambda t: t["on"].cast("double")).alias("weights"),
        )

    return let(let(tokens_and_mask(m, encode, end_id), lambda t: F.slice(t, F.greatest(F.size(t) - limit + 1, F.lit(1)), F.lit(limit))), shifted)


def datum_holds(d: Column) -> Column:
    """Whether a datum's three arrays are equally long."""
    n = F.size(d["input_tokens"])
    return F.coalesce((n == F.size(d["target_tokens"])) & (n == F.size(d["weights"])), F.lit(False))


def checked_datum(d: Column) -> Column:
    """The datum; a row whose arrays differ in length fails the job."""
    return F.when(datum_holds(d), d).otherwise(F.raise_error(F.lit("a datum's arrays differ in length")))


def completion_datum(prompt: Column, completion: Column, signal: Column | None = None) -> Column:
    """struct(input_tokens, target_tokens, weights) of a prompt (begin id, bytes, end id) and a completion (bytes, end id).

    Targets in the completion weigh 1, or the signal (an advantage).
    """
    head, tail = F.concat(F.array(F.lit(BOS_ID)), byte_ids(prompt), F.array(F.lit(EOS_ID))), F.concat(byte_ids(completion), F.array(F.lit(EOS_ID)))
    weight = F.lit(1.0) if signal is None else signal.cast("double")

    def datum(whole: Column) -> Column:
        n = F.size(whole) - 1
        return F.struct(
            F.slice(whole, F.lit(1), n).alias("input_tokens"), F.slice(whole, F.lit(2), n).alias("target_tokens"),
            F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i >= F.octet_length(prompt) + 2, weight).otherwise(0.0)).alias("weights"),
        )

    return let(F.concat(head, tail), datum)

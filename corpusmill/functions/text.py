"""Text functions: normal forms, shingles, personal-data patterns, redaction, unicode hazards."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType


def normalized(text: Column) -> Column:
    """Lower case, ß as ss, white space to single spaces, trimmed: JVM-side, exact for text already in NFKC form."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


@pandas_udf(StringType())
def normalized_exact(texts: pd.Series) -> pd.Series:
    """NFKC, case folding, white space to single spaces."""
    return texts.map(lambda t: t if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


#: Characters that NFKC leaves alone and whose case folding is their lower case (ß apart); others send a text to Python.
_SIMPLE = r"[\x00-\x1b\x20-\x7f¡-§©«¬®°±¶·»¿À-ÖØ-öø-ÿ–—‘’“”„•€]*"


def normalized_all(text: Column) -> Column:
    """The exact normal form of any text: JVM-side for texts of simple characters, and in Arrow batches for the others only."""
    exact = normalized_exact(F.when(~text.rlike(rf"\A{_SIMPLE}\z"), text))  # null for a simple text
    return F.coalesce(exact, normalized(text))


@pandas_udf(BooleanType())
def _not_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t is not None and not unicodedata.is_normalized("NFC", t))


def not_nfc(text: Column | str) -> Column:
    """Whether a text is not in normal form C. Only texts with a character beyond U+02FF, the first of which may change, go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    return _not_nfc(F.when(text.rlike(r"[^\x00-\u02ff]"), text))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often and deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles(norm: Column, k: int = 5) -> Column:
    """Distinct k-character windows of a normalised text; a shorter text is its own window, an empty one has none."""

    def windows(t: Column) -> Column:
        # one pass: a look-ahead matches at every position (substring would walk from the start each time)
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))
        return F.when(F.length(t) > k, found).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    return let(norm, windows)


#: Kinds of personal data and secrets, in the order in which they are redacted.
PII_PATTERNS: dict[str, str] = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "api_key": r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_\-]{16,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b",
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "credit_card": r"\b(?:\d[ \-]?){12,18}\d\b",
    "ssn": r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "phone": r"(?<![\d\-])(?:\+\d{1,3}[ \-]?)?(?:\(\d{3}\)|\d{3})[ \-]\d{3}[ \-]\d{4}(?![\d\-])",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
}

#: The same kinds as RE2, and so DuckDB, reads them. Word borders and digits are those of ASCII (Java's own \b is not, before
#: 19); without look-around the neighbours of a phone number belong to its match, so of two numbers with one character between the first counts.
_BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NUMBERS = ("credit_card", "ssn", "phone", "ipv4")
ASCII_PATTERNS: dict[str, str] = {k: (p.replace(r"\b", r"(?=\d)(?<!\w)", 1) if k in _NUMBERS else p).replace(r"\b", _BORDER) for k, p in PII_PATTERNS.items()} | {
    "phone": r"(\A|[^\d\-])(?:\+\d{1,3}[ \-]?)?(?:\(\d{3}\)|\d{3})[ \-]\d{3}[ \-]\d{4}([^\d\-]|\z)",
}


def pattern_and_mark(kind: str, ascii: bool = False) -> tuple[str, str]:
    """A kind's pattern for Spark's functions and what replaces a match."""
    mark = f"[REDACTED:{kind}]"
    if ascii:
        return ASCII_PATTERNS[kind], f"$1{mark}$2" if kind == "phone" else mark
    return "(?U)" + PII_PATTERNS[kind], mark


def luhn_ok(match: Column) -> Column:
    """13 to 19 digits that pass the mod-10 check; other characters are skipped."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def _redact_cards(text: Column, ascii: bool) -> Column:
    """Runs that pass the check are replaced; failing runs and the text between the runs stay as they are."""
    pattern, _ = pattern_and_mark("credit_card", ascii)

    def joined(t: Column, found: Column) -> Column:
        card = lambda i: F.when(luhn_ok(F.get(found, i)), F.lit("[REDACTED:credit_card]")).otherwise(F.get(found, i))
        # the n-th run follows the n-th gap; the last gap has none
        return F.array_join(F.transform(F.split(t, pattern, -1), lambda gap, i: F.concat(gap, F.coalesce(card(i), F.lit("")))), "")

    def mend(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.exists(found, luhn_ok), joined(t, found)).otherwise(t))

    return let(text, mend)


#: For the kinds that need one of some literals these; the other kinds need a run of digits.
LITERALS: dict[str, tuple[str, ...]] = {
    "private_key": ("-----BEGIN",), "aws_access_key": ("AKIA", "ASIA"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "api_key": ("sk-",), "jwt": ("eyJ",), "email": ("@",),
}
DIGITS = r"(?U)\d[\d .()\-]{5}"


def _literals(text: Column) -> dict[str, Column]:
    """For each kind that needs one of some literals whether the text holds it, sought in its bytes; the other kinds need a run of digits.

    Marks hold neither, nor a part that could complete one, so what the text lacks at first no replacement brings.
    """
    return {k: reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in literals)) for k, literals in LITERALS.items()}


def _swapped(kind: str, there: Column, ascii: bool) -> Callable[[Column], Column]:
    def swap(x: Column) -> Column:
        new = _redact_cards(x, ascii) if kind == "credit_card" else F.regexp_replace(x, *pattern_and_mark(kind, ascii))
        return F.when(there, new).otherwise(x)

    return swap


def _told(text: Column) -> Column:
    """struct(text, and a flag for each kind): anchors are sought once, however often they are asked for."""
    digits = let(text.rlike(DIGITS), lambda d: F.struct(*(d.alias(k) for k in _NUMBERS)))
    own = [c.alias(k) for k, c in _literals(text).items()]
    return F.struct(text.alias("text"), *own, digits.alias("digits"))


def _there(told: Column, kind: str) -> Column:
    return told["digits"][kind] if kind in _NUMBERS else told[kind]


def _replaced(told: Column, ascii: bool = False) -> Column:
    """The text with each kind replaced in turn; a kind's pattern runs only where its anchor is."""
    now = told["text"]
    for kind in PII_PATTERNS:
        now = let(now, _swapped(kind, _there(told, kind), ascii))
    return now


def _suspect(text: Column) -> Column:
    return reduce(Column.__or__, _literals(text).values()) | text.rlike(DIGITS)


def redacted(text: Column, ascii: bool = False) -> Column:
    """Each kind in turn is replaced by [REDACTED:kind]; a later kind sees the text that earlier ones left.

    Word borders and digits are Unicode's, as in Python; with ascii they are RE2's, as SQL engines tell them (ASCII_PATTERNS).
    Texts without any anchor of a kind, nearly all in most corpora, are only searched for these.
    """
    return F.when(_suspect(text), let(_told(text), lambda told: _replaced(told, ascii))).otherwise(text)


def has_pii(text: Column) -> Column:
    """Whether redaction replaces anything: the first kind that does so matches in the text as it is, so nothing needs to be replaced."""
    has = lambda kind: text.rlike(pattern_and_mark(kind)[0])
    card = F.exists(F.regexp_extract_all(text, F.lit(pattern_and_mark("credit_card")[0]), F.lit(0)), luhn_ok)
    numbers = text.rlike(DIGITS) & reduce(Column.__or__, (card if kind == "credit_card" else has(kind) for kind in _NUMBERS))
    return reduce(Column.__or__, (there & has(kind) for kind, there in _literals(text).items())) | numbers


def marks(text: Column) -> Column:
    """map<kind, marks> of the kinds whose marks a text holds, whoever put them there."""

    def counted(t: Column) -> Column:
        entries = F.array(*(F.struct(F.lit(k).alias("key"), F.regexp_count(t, F.lit(rf"\[REDACTED:{k}\]")).alias("value")) for k in PII_PATTERNS))
        return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))

    return let(text, lambda t: F.when(F.contains(t, F.lit("[REDACTED:")), counted(t)).when(t.isNotNull(), F.create_map().cast("map<string,int>")))


def pii_counts(text: Column) -> Column:
    """map<kind, matches> of the kinds that redaction finds, counted in the redacted text beyond marks it had before."""
    count = lambda t, k: F.regexp_count(t, F.lit(rf"\[REDACTED:{k}\]"))

    def counted(told: Column) -> Column:
        def of(after: Column) -> Column:
            entries = F.array(*(F.struct(F.lit(k).alias("key"), F.when(_there(told, k), count(after, k) - count(told["text"], k)).otherwise(0).alias("value")) for k in PII_PATTERNS))
            return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))

        return let(_replaced(told), of)

    none = F.create_map().cast("map<string,int>")
    return F.when(_suspect(text), let(_told(text), counted)).when(text.isNotNull(), none)


def luhn_ok_py(match: str) -> bool:
    """The same check in plain Python."""
    digits = [int(c) for c in match if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


@pandas_udf(StringType())
def redacted_exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """`redacted` by Python's own regular expressions, in Arrow batches."""
    patterns = {k: re.compile(p) for k, p in PII_PATTERNS.items()}

    def one(text: str | None) -> str | None:
        for kind, p in patterns.items() if text else ():
            mark = f"[REDACTED:{kind}]"
            text = p.sub(lambda m: mark if kind != "credit_card" or luhn_ok_py(m[0]) else m[0], text)
        return text

    for texts in batches:
        yield texts.map(one)


#: Hazards in text, as Java character classes.
HAZARDS: dict[str, str] = {
    "control_characters": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
    "zero_width_characters": r"[\u200b-\u200d\u2060\ufeff]",
    "bidi_override": r"[\u202a-\u202e\u2066-\u2069]",
    "replacement_character": r"\ufffd",
}


def hazard(text: Column, name: str) -> Column:
    return text.rlike(HAZARDS[name])


def lone_surrogate_escape(raw_json: Column) -> Column:
    """An unpaired \\uD800..\\uDFFF escape in a raw JSON line. Readers replace it, so it must be sought before parsing."""
    bare = F.regexp_replace(raw_json, r"\\\\", "")
    paired = F.regexp_replace(bare, r"(?i)\\ud[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2}", "")
    return paired.rlike(r"(?i)\\ud[89a-f][0-9a-f]{2}")


def squeezed_lower(text: Column) -> Column:
    """Lower case with single spaces, for exact-match comparison."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))

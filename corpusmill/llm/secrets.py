"""Secret scan: fixed patterns, and runs of characters that a byte-pair vocabulary spends too many tokens on.

Prose and identifiers made of words take over two characters a token, random strings (letters alone or with digits) fewer.
A run counts as dense when its characters per token stay under `max_chars_per_token`, and it is neither a digest of a
known length nor an identifier (UUID, number, alphabet, words or short codes joined by punctuation). What a fixed
pattern's span covers of a run is left to that span; the rest is judged by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "dense")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the same runs as [0-9a-f]+ of 32 or more characters
_WORDS = ("passw", "secret", "token", "api")

_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: Characters of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal.
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_JOINTS, _HUMPS = re.compile(r"[+/_=.-]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDLIKE = re.compile(r"[A-Za-z]?[a-z]*\d{0,4}|[A-Z]+\d{0,4}|\d+")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz" * 2


@dataclass(frozen=True)
class Density:
    """min_chars: the shortest run judged; max_chars_per_token: the ratio that a dense run stays under."""

    vocabulary: str = "byte_bpe_50k.tiktoken"
    min_chars: int = 20
    max_chars_per_token: float = 2.1


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """A tiktoken encoding of a public vocabulary file, by name or path."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def chars_per_token(run: str, density: Density = Density()) -> float:
    return len(run) / len(encoding(density.vocabulary).encode_ordinary(run))


def _is_word(part: str, density: Density) -> bool:
    """A number, a short code of letters and then digits, or words in one or several humps that the vocabulary knows."""
    humps = [h for h in _HUMPS.split(part) if h]
    if part.isdigit() or not all(map(_WORDLIKE.fullmatch, humps)):
        return part.isdigit()
    return len(part) <= 4 or len(part) >= 3 * len(humps) and chars_per_token(part, density) >= density.max_chars_per_token


def is_identifier(run: str, density: Density = Density()) -> bool:
    """A digest of a known length, a UUID, a stretch of the alphabet, or parts that each are a word, number or short code."""
    if len(run) in DIGEST_CHARS and _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or run.lower() in _ALPHABET:
        return True
    return all(_is_word(p, density) for p in _JOINTS.split(run) if p)


def _outside(start: int, end: int, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a stretch that no span of taken (sorted) covers."""
    for a, _, z in taken:
        if z > start and a < end:
            if a > start:
                yield start, a
            start = max(start, z)
    if start < end:
        yield start, end


def dense_spans(text: str, taken: list[tuple[int, int, int]], density: Density = Density()) -> list[tuple[int, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        for a, z in _outside(m.start(), m.end(), taken):
            run = text[a:z].strip(".-_/")
            if len(run) < density.min_chars or not any(map(str.isalpha, run)):
                continue
            if chars_per_token(run, density) < density.max_chars_per_token and not is_identifier(run, density):
                a = text.index(run, a, z)
                out.append((a, 3, a + len(run)))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def scan(text: str | None, density: Density = Density()) -> tuple[int, int, int, str, str, int]:
    """n_assign, n_access, n_hex, base_sha256, spans, n_dense of a whole text."""
    text = text or ""
    base = base_spans(text)
    dense = dense_spans(text, base, density)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + dense), len(dense)


COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_dense long"


def secret_scan(docs: DataFrame, density: Density = Density()) -> DataFrame:
    """(doc_id, text, ...) -> doc_id and the columns of `scan`, a row for each row.

    Null text scans as empty: no spans, the digest of the empty string. Repeated rows stay, null ids pass through,
    other columns are not read. An empty table gives no rows. Offsets are code points. No shuffle.
    """
    kinds = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in COLUMNS.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t.as_py(), density) for t in b.column(1)]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, kinds))], ["doc_id", *kinds.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def redact(text: str | None, density: Density = Density()) -> str | None:
    """The text with every span replaced by [SECRET:kind]; of spans that overlap, the first and longest names it."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for a, k, z in sorted(base + dense_spans(text, base, density), key=lambda s: (s[0], -s[2])):
        if a >= at:
            out += [text[at:a], f"[SECRET:{KINDS[k]}]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, density: Density = Density()) -> DataFrame:
    """All rows and columns, whatever their names, with spans in text replaced; a long column n_chars, if there, follows the new text.

    Null and empty texts and null ids stay as they are, repeated rows too. An empty table gives no rows. No shuffle.
    """
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [redact(t, density) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                columns[size] = pa.array([n if x == y else len(y) for n, x, y in zip(columns[size].to_pylist(), old, new)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)

"""Hierarchical multi-length packing of documents into token sequences.

Documents are routed to tiers of context sizes (powers of two). Whole windows of the longest tier are cut off long
documents; what remains goes to the smallest tier that holds it. Tiers are packed from the longest down: a window
starts with its tier's longest document and its gap is filled from shorter ones, the best fit first, and at last by a
cut that closes it exactly. What is left at a partition's end becomes windows of decreasing powers of two, so
no sequence is padded. Sequences of a tier are dealt to step groups of equal tokens and similar attention cost.

Everything happens in one pass over each partition: tokens wait only until `window_tokens` of them are there, no
row is shuffled, and a task that runs again gives the same pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusmill.llm.tokens import WordEncoder


@dataclass(frozen=True)
class Packing:
    """tiers: window sizes, powers of two, ascending; step_tokens: tokens of a step group."""

    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 2
    tiers: tuple[int, ...] = (512, 1024, 2048, 4096)
    step_tokens: int = 1 << 16
    window_tokens: int = 1 << 21

    def __post_init__(self):
        if not self.tiers or any(t < 1 or t & t - 1 for t in self.tiers) or list(self.tiers) != sorted(set(self.tiers)):
            raise ValueError("tiers are ascending powers of two")


Piece = tuple[int, int, int]  #: document's place in the buffer, start, length


class _Pool:
    """Remainders by length; lengths are at most the longest tier, so finding a fit takes few steps."""

    def __init__(self):
        self.at: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []

    def add(self, doc: int, start: int, length: int) -> None:
        if length not in self.at:
            self.at[length] = []
            insort(self.lengths, length)
        self.at[length].append((doc, start))

    def take(self, length: int) -> Piece:
        doc, start = self.at[length].pop()
        if not self.at[length]:
            del self.at[length]
            self.lengths.remove(length)
        return doc, start, length

    def longest(self, most: int) -> int:
        """The longest length up to `most` that is there, or 0."""
        i = bisect_right(self.lengths, most)
        return self.lengths[i - 1] if i else 0


def pack(lengths: list[int], settings: Packing = Packing(), last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences, each a list of pieces that fill a power of two; and, unless `last`, pieces left for later."""
    top, pool, sequences = settings.tiers[-1], _Pool(), []
    for doc, n in enumerate(lengths):
        whole = n - n % top
        sequences += [[(doc, k, top)] for k in range(0, whole, top)]
        if n % top:
            pool.add(doc, whole, n % top)
    open_, rest = [], []
    while pool.lengths:
        first = pool.take(pool.lengths[-1])
        size = next(t for t in settings.tiers if first[2] <= t)
        window, gap = [first], size - first[2]
        while gap and pool.lengths:
            if fit := pool.longest(gap):
                window.append(pool.take(fit))
                gap -= fit
            else:  # every document is longer than the gap: the shortest is cut
                doc, start, n = pool.take(pool.lengths[0])
                window.append((doc, start, gap))
                pool.add(doc, start + gap, n - gap)
                gap = 0
        if gap:
            open_ = window
        else:
            sequences.append(window)
    if open_ and not last:
        rest = open_
    elif open_:
        sequences += _powers(open_)
    return sequences, rest


def _powers(window: list[Piece]) -> list[list[Piece]]:
    """The pieces of an unfinished window, cut into windows of decreasing powers of two."""
    total, out = sum(n for *_, n in window), []
    waiting = window[::-1]
    while total:
        size = 1 << total.bit_length() - 1
        total -= size
        part = []
        while size:
            doc, start, n = waiting.pop()
            part.append((doc, start, min(n, size)))
            if n > size:
                waiting.append((doc, start + size, n - size))
            size -= part[-1][2]
        out.append(part)
    return out


def step_groups(costs: list[int], members: int) -> list[int]:
    """A group for each sequence: full groups of `members` (the last may have fewer), similar in total cost."""
    groups = -(-len(costs) // members)
    out = [0] * len(costs)
    for rank, i in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        turn, k = divmod(rank, groups)
        out[i] = k if turn % 2 == 0 else groups - 1 - k  # to and fro, so that costs even out
    return out


_FIELDS = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("tier", "int"), ("step_group", "long")]


def pack_documents(docs: DataFrame, settings: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (tokens of the sequence), step_group; with_ids adds the piece's ids as array<int>.

    A document is its token ids and the end id; null text is empty and so is the end id alone. Each id of each row lies in
    exactly one piece. Repeated rows are packed each by itself, null doc_ids pass through, other columns are not
    read. An empty table gives no rows. A piece's offset in its sequence is gapless from 0; sequence ids are the
    partition's number in the high bits and a count.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, high = WordEncoder(settings.vocabulary), TaskContext.get().partitionId() << 33
        end = np.array([settings.end_id], encoder.kind)
        ids: list = []  # doc_id, base of start, whole length, tokens still to place
        waiting: dict[int, list] = {}  # by size: sequences that do not fill a step group yet
        held = sequence = step = 0
        id_type = None

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal ids, held, sequence, step
            sequences, rest = pack([len(x[3]) for x in ids], settings, last)
            for s in sequences:
                waiting.setdefault(sum(n for *_, n in s), []).append([(ids[d][0], ids[d][1] + a, ids[d][2], ids[d][3][a : a + n]) for d, a, n in s])
            rows: list[list] = [[] for _ in range(len(_FIELDS) + 1 + with_ids)]
            for size, at in sorted(waiting.items()):
                members = max(1, settings.step_tokens // size)
                full = len(at) if last else len(at) - len(at) % members
                groups = step_groups([sum(len(x[3]) ** 2 for x in s) for s in at[:full]], members)
                for s, group in zip(at[:full], groups):
                    offset = 0
                    for doc_id, start, whole, tokens in s:
                        part = tokens.astype("<u4")
                        for column, value in zip(rows, (doc_id, start, len(part), zlib.crc32(part.tobytes()), whole, high | sequence, offset, size, high | step + group)):
                            column.append(value)
                        if with_ids:
                            rows[-1].append(part.astype(np.int32))
                        offset += len(part)
                    sequence += 1
                step += max(groups, default=-1) + 1
                waiting[size] = [[(*x[:3], x[3].copy()) for x in s] for s in at[full:]]
            ids = [(ids[d][0], ids[d][1] + a, ids[d][2], ids[d][3][a : a + n].copy()) for d, a, n in rest]
            held = sum(len(x[3]) for x in ids)
            kinds = [id_type, *(pa.int32() if t == "int" else pa.int64() for _, t in _FIELDS)] + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["doc_id", *(f for f, _ in _FIELDS)] + ["ids"] * with_ids)

        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = np.concatenate([encoder.encode(text.as_py() or ""), end])
                ids.append((doc_id, 0, len(tokens), tokens))
                held += len(tokens)
                if held >= settings.window_tokens:
                    yield flush(False)
        if ids or any(waiting.values()):
            yield flush(True)

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{f} {t}" for f, t in _FIELDS)] + ["ids array<int>"] * with_ids)
    return docs.select("doc_id", "text").mapInArrow(run, schema)

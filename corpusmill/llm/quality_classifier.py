"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated numpy network.

1. Word vectors cover all documents. A word is a run of word characters or of other visible characters; the bits of its
   64-bit hash say where its sparse index vector is +1 or -1. The context vector of a word is the sum of the
   index vectors around its occurrences. Every word that makes up at least `min_share` of all words has one, so
   there are at most 1 / min_share of them at any corpus size, and the table may be broadcast. Which words these are is
   told by exact counts. A rarer word takes the context of the occurrence at hand, which for a word seen once is the
   whole corpus's.
2. A document is pooled to the mean and the adjacent-pair product of its words' vectors, and length statistics.
3. A two-layer network is fitted on at most `max_labelled` labelled rows that are not held out, and its logit is
   divided by a temperature fitted on a validation part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Stash, held_out

_CHARS, _BASE = 1 << 17, 0x5851F42D4C957F2D  #: characters hashed at once; the base
_BLOCKS, _SALTS = 64, 256
_BLOCK = 1 << 18  #: words whose contexts are added at once
_SEGMENT = 1 << 21  #: words that a task counts at once
_SLACK = 8  #: a segment leaves out words under 1 / _SLACK of the least share, so no sum lacks more than that


@dataclass(frozen=True)
class Settings:
    """min_share: the least share of all words that gives a word a row of the table; max_labelled: the bound of the rows
    that are fitted; dims: a power of two up to 128; nonzero: at most 8."""

    min_share: float = 2.0**-16
    dims: int = 64
    nonzero: int = 2
    window: int = 2
    max_labelled: int = 8000
    hidden: int = 32
    epochs: int = 40
    threshold: float = 0.3
    seed: int = 17


@dataclass
class WordVectors:
    """hashes: sorted, of the words in the table; vectors: a unit row for each and a row of zeros; mean: of all contexts."""

    hashes: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray


@lru_cache(maxsize=2)
def _kinds(most: int) -> np.ndarray:
    """The class of each character below a code point: 0 white space, 1 of words, 2 other."""
    return np.fromiter((1 if c.isalnum() or c == "_" else 0 if c.isspace() else 2 for c in map(chr, range(most))), np.uint8, most)


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse."""
    powers = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(_CHARS, x, np.uint64)
        factors[0] = 1
        powers.append(np.multiply.accumulate(factors))
    return powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (a longest run of one class of characters, not white space), in order.

    A word's characters are digits of a number to an odd base, which prefix sums over the whole text give at once. Runs of
    over _CHARS characters count as several words.
    """
    power, inverse = _powers()
    codes, out, a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), [], 0
    kinds = _kinds(0x10000 if not len(codes) or codes.max() < 0x10000 else 0x110000)  # few texts need the large table
    while a < len(codes):
        c = codes[a : a + _CHARS]
        kind = kinds[c]
        if a + len(c) < len(codes) and len(gap := np.flatnonzero(kind == 0)):  # a cut goes through white space, if there is some
            c, kind = c[: gap[-1] + 1], kind[: gap[-1] + 1]
        a += len(c)
        digit = c * np.uint64(0x9E3779B97F4A7C15)
        digit ^= digit >> np.uint64(29)
        digit *= power[: len(c)]
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(digit, out=total[1:])
        start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        end = np.append(start[1:], len(c))
        word = kind[start] > 0
        start, end = start[word], end[word]
        h = (total[end] - total[start]) * inverse[start]
        for shift in (32, 29):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ h >> np.uint64(32))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def words_of(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and its row in a table of sorted hashes (-1: none)."""
    hashes = word_hashes(text)
    return hashes, rows_of(hashes, table)


def rows_of(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted table, or -1."""
    if not len(table):
        return np.full(len(hashes), -1, np.int32)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1).astype(np.int32)


def index_vectors(hashes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """nonzero x words: positions and signs of index vectors, a byte of the hash for each."""
    part = (hashes[None, :] >> (8 * np.arange(s.nonzero, dtype=np.uint64))[:, None]).astype(np.uint8)
    return (part & np.uint8(s.dims - 1)).astype(np.int64), 1 - 2 * (part >> np.uint8(7)).astype(np.int64)


def _add_contexts(total: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], s: Settings) -> None:
    """Adds to total (rows x dims) the index vectors within the window around each word with a row, document by document."""
    gap = np.full(s.window, -2, np.int32)  # keeps documents apart
    row = np.concatenate([x for _, r in parts for x in (r, gap)])
    hashes = np.concatenate([x for h, _ in parts for x in (h, gap.astype(np.uint64))])
    flat, n = total.reshape(-1), len(row)
    for a in range(0, n, _BLOCK):  # bounded scratch space, exact at the borders
        low, high = max(0, a - s.window), min(n, a + _BLOCK + s.window)
        at, sign = index_vectors(hashes[low:high], s)
        centre = a + np.flatnonzero(row[a : a + _BLOCK] >= 0)
        for d in (*range(-s.window, 0), *range(1, s.window + 1)):
            near = centre + d
            ok = (near >= 0) & (near < n)
            ok[ok] = row[near[ok]] >= -1
            cell, near = row[centre[ok]].astype(np.int64) * s.dims, near[ok] - low
            for k in range(s.nonzero):
                np.add.at(flat, cell + at[k, near], sign[k, near])


def frequent_words(docs: DataFrame, s: Settings, stash: Stash) -> tuple[np.ndarray, int]:
    """Hashes, sorted, of all words that may reach the least share (at most 8/7 / min_share), and the number of words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, n
            found, c = np.unique(np.concatenate(waiting), return_counts=True)
            keep = c * _SLACK >= n * s.min_share
            out = pa.RecordBatch.from_arrays([pa.array([None, *found[keep].view(np.int64).tolist()], pa.int64()), pa.array([n, *c[keep].tolist()], pa.int64())], ["word", "n"])
            waiting, n = [], 0
            return out

        for b in batches:
            for t in b.column(0):
                h = word_hashes(t.as_py() or "")
                for k in range(0, len(h), _SEGMENT):
                    waiting.append(h[k : k + _SEGMENT])
                    n += len(waiting[-1])
                    if n >= _SEGMENT:
                        yield flush()
        if n:
            yield flush()

    counts, path = stash.put(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where("word is null").first()
    n = total.n if total else 0
    found = [r.word for r in counts.where(F.col("word").isNotNull() & (F.col("n") >= (1 - 1 / _SLACK) * s.min_share * n)).select("word").collect()]
    stash.drop(path)
    return np.sort(np.array(found, np.int64).view(np.uint64)), n


def word_vectors(docs: DataFrame, s: Settings = Settings()) -> WordVectors:
    """(text, ...) -> the vectors of all words that reach the least share, from all rows."""
    table, n = frequent_words(docs, s, Stash(docs.sparkSession, "words"))
    sent = docs.sparkSession.sparkContext.broadcast(table)  # at most 8/7 / min_share numbers

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        total, seen = np.zeros((len(table), s.dims), np.int64), np.zeros(len(table) + 1, np.int64)
        waiting, n = [], 0

        def flush():
            nonlocal waiting, n
            if waiting:
                _add_contexts(total, waiting, s)
                np.add(seen, np.bincount(np.concatenate([r for _, r in waiting]) + 1, minlength=len(seen)), out=seen)
            waiting, n = [], 0

        for b in batches:
            for t in b.column(0):
                h, r = words_of(t.as_py() or "", table)
                if len(h):
                    waiting.append((h, r))
                    n += len(h)
                    if n >= _BLOCK:
                        flush()
        flush()
        task = TaskContext.get().partitionId()
        whole = np.concatenate([total, seen[1:, None]], axis=1)
        for k, part in enumerate(np.array_split(whole, _BLOCKS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([_pack(part)], pa.binary())], ["block", "task", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) == 1:
            return frame
        return pd.DataFrame({"block": frame["block"].iloc[:1], "task": frame["task"].iloc[:1], "sums": [_pack(sum(map(_unpack, frame["sums"])))]})

    parts = docs.select("text").mapInArrow(count, "block int, task int, sums binary")
    for keys in ([F.col("block"), F.pmod("task", F.lit(_SALTS))], [F.col("block")]):
        parts = parts.groupBy(*keys).applyInPandas(add, "block int, task int, sums binary")
    whole = np.zeros((len(table), s.dims + 1), np.int64)
    blocks = np.array_split(whole, _BLOCKS)
    for row in parts.collect():  # at most 8/7 / min_share x (dims + 1) cells
        blocks[row.block][:] = _unpack(row.sums).reshape(blocks[row.block].shape)
    total, seen = whole[:, :-1], whole[:, -1]
    mean = total.sum(0) / max(1, seen.sum())  # what all words share tells nothing
    often = seen >= s.min_share * n
    return WordVectors(table[often], np.vstack([_unit(total[often] / np.maximum(seen[often], 1)[:, None] - mean), np.zeros((1, s.dims))]).astype(np.float32), mean)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _pack(x: np.ndarray) -> bytes:
    """Signed sums as compressed 64-bit integers: most bytes are zero."""
    return zlib.compress(np.ascontiguousarray(x, np.int64).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.int64)


def _vectors(hashes: np.ndarray, rows: np.ndarray, a: int, z: int, words: WordVectors, s: Settings) -> np.ndarray:
    """Vectors of the words a to z of a document: from the table, or from the context of the occurrence."""
    out = words.vectors[rows[a:z]]  # a row of -1 is the last one, of zeros
    rare = np.flatnonzero(rows[a:z] < 0)
    if len(rare):
        low = max(0, a - s.window)
        at, sign = index_vectors(hashes[low : z + s.window], s)
        cells, signs, near = [], [], np.zeros(len(rare))
        for d in (*range(-s.window, 0), *range(1, s.window + 1)):
            j = rare + a + d
            ok = np.flatnonzero((j >= 0) & (j < len(hashes)))
            near[ok] += 1
            for k in range(s.nonzero):
                cells.append(ok * s.dims + at[k, j[ok] - low])
                signs.append(sign[k, j[ok] - low])
        own = np.bincount(np.concatenate(cells), np.concatenate(signs), len(rare) * s.dims).reshape(-1, s.dims)
        own -= np.maximum(near, 1)[:, None] * words.mean  # the sum less as many means: the direction of the mean less the mean
        out[rare] = own / np.maximum(np.sqrt(np.einsum("ij,ij->i", own, own)), 1e-9)[:, None]
    return out


def pooled(hashes: np.ndarray, rows: np.ndarray, words: WordVectors, s: Settings) -> np.ndarray:
    """2 x dims + 3 features of a document's words; all but the last of an empty text are 0."""
    n, dims = len(rows), s.dims
    out = np.zeros(2 * dims + 3, np.float32)
    if n:
        total, pairs, last = np.zeros(dims), np.zeros(dims), None
        for k in range(0, n, 1 << 14):
            v = _vectors(hashes, rows, k, min(n, k + (1 << 14)), words, s)
            total += v.sum(0)
            pairs += np.einsum("ij,ij->j", v[:-1], v[1:]) + (last * v[0] if last is not None else 0)
            last = v[-1]
        out[:dims], out[dims : 2 * dims] = total / n, pairs / max(1, n - 1)
        out[-3] = len(np.unique(hashes)) / n**0.8
        out[-2] = math.log1p(n) / 5
    out[-1] = n == 0
    return out


class Network:
    """Inputs -> standardised -> tanh layer -> logit / temperature -> probability."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.w = prior, None

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-(self.logit(x) / self.temperature).clip(-40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, s: Settings) -> Network:
        """A part of a fifth is left for the temperature. Without both labels: the share of label 1 as it is."""
        net = cls(float(y.mean()) if len(y) else 0.5)
        if len(y) < 10 or y.min() == y.max():
            return net
        rng = np.random.default_rng(s.seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        net.mean, net.scale = x[used].mean(0), x[used].std(0) + 1e-3
        weights = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / math.sqrt(s.hidden), s.hidden), np.zeros(1)]
        z = ((x - net.mean) / net.scale).clip(-8, 8)
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(s.epochs):
            for batch in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
                w1, b1, w2, b2 = weights
                hidden = np.tanh(z[batch] @ w1 + b1)
                error = (1 / (1 + np.exp(-(hidden @ w2 + b2).clip(-40, 40))) - y[batch]) / len(batch)
                back = np.outer(error, w2) * (1 - hidden**2)
                step += 1
                for i, g in enumerate((z[batch].T @ back + 1e-4 * w1, back.sum(0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    weights[i] = weights[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        net.w = weights
        raw = net.logit(x[held])
        tried = np.geomspace(0.25, 8, 60)
        net.temperature = float(min(tried, key=lambda t: float(np.mean(np.logaddexp(0, raw / t) - y[held] * raw / t))))
        return net


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[WordVectors, Network]:
    """Word vectors of all docs (doc_id, text, ...) and the network fitted on labels (doc_id, quality, ...).

    Labels of null or held-out ids, null qualities and ids with contrary qualities are left out; of the others, at
    most max_labelled ids are taken, in order of a hash of the id.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, s)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("other"))
    known = known.where("y = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled).select(F.col("doc_id").alias("labelled_id"), "y")
    sent = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pooled(*words_of(t.as_py() or "", sent.value.hashes), sent.value, s).tobytes() for t in b.column(2)], pa.binary())], ["labelled_id", "y", "x"])

    # at most max_labelled rows, so they may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id"))
    rows = sample.select(F.col("labelled_id").cast("long"), F.col("y").cast("int"), "text").mapInArrow(features, "labelled_id long, y int, x binary")
    rows = rows.groupBy("labelled_id").agg(F.min(F.struct("x", "y")).alias("r")).select("labelled_id", "r.*").collect()
    rows.sort(key=lambda r: r.labelled_id)
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], float).reshape(len(rows), 2 * s.dims + 3)
    return vectors, Network.fit(x, np.array([r.y for r in rows], float), s)


def _scores(texts: pa.Array, vectors: WordVectors, net: Network, s: Settings) -> np.ndarray:
    out = np.zeros(len(texts))
    for k in range(0, len(texts), 1024):
        x = [pooled(*words_of(t.as_py() or "", vectors.hashes), vectors, s) for t in texts[k : k + 1024]]
        out[k : k + 1024] = net.probability(np.array(x, float))
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row for each row.

    Null text scores as the empty text. held_out of a null doc_id is false. Rows repeat as they came; other columns
    are not read. With no usable labels every score is 0.5, with labels of one kind only, their share of ones. An
    empty table gives no rows.
    """
    vectors, net = train(docs, labels, s)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), *sent.value, s))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))


def keep_likely(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns, whatever their names, as they were.

    Null text scores as the empty text, a null doc_id is scored like any other. Repeated rows score alike, so all stay or
    all go. Without usable labels every row stays (score 0.5). An empty table gives no rows.
    """
    vectors, net = train(docs, labels, s)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), *sent.value, s) >= s.threshold))

    return docs.mapInArrow(run, docs.schema)

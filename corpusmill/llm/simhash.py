"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprint: 64 bits, each the majority over the XXH64 (seed 42) of a text's 3-word shingles, repeats included.

Search: every bit position gets a non-zero vector of radius + 1 bits. Table v (one for each of the
2^(radius+1) - 1 non-zero vectors) keys a fingerprint by the positions whose vector has an odd product with v.
At most `radius` differing positions span at most `radius` dimensions, so some v is orthogonal to all of them, and
in its table the pair has the same key: no pair within the radius is missed.

Distinct fingerprints only are searched; copies meet in their fingerprint's row. A bucket of more than `bucket`
fingerprints is not scanned whole: its rows are dealt again by a second covering family (and a third, and so on),
which keeps the guarantee and leaves ever fewer free positions, so the last level has a bounded bucket.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from corpusmill.llm.common import ASCII_LOWER, Stash
from corpusmill.llm.components import connected_components

SHINGLE, SEED, RADIUS, BUCKET, LEVELS = 3, 42, 3, 4096, 4
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash. Null and texts without a word: 0. Fewer words than a shingle: the whole sequence."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    a, b = starts.tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(a), _CHUNK):  # bounded scratch space for very long texts
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(a[k : k + _CHUNK], b[k : k + _CHUNK])), np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(a)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long: the 64 bits as a signed number, and the long columns of keep), a row for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *keep])

    return docs.select("doc_id", "text", *keep).mapInArrow(run, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long", *(f"{c} long" for c in keep)]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, level: int = 0, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks of a covering family; `level` picks an independent assignment of positions."""
    kinds = (1 << radius + 1) - 1
    vectors = [1 + i % kinds for i in range(bits)]
    random.Random(f"covering {level}").shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, kinds + 1)]


def _within(fps: np.ndarray, radius: int, block: int = 512) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs within the radius: as many links as connect the same members, no more."""
    x = fps.view(np.uint64)
    root = np.arange(len(x))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(0, len(x), block):
        near = np.bitwise_count(x[k : k + block, None] ^ x[None, k:]) <= radius
        for i, j in np.argwhere(np.triu(near, 1)).tolist() if near.any() else ():
            p, q = top(k + i), top(k + j)
            if p != q:
                root[max(p, q)] = min(p, q)
                yield k + i, k + j


def near_pairs(fps: DataFrame, stash: Stash, radius: int = RADIUS, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """Distinct fp -> links (a, b), each within the radius, that connect all fingerprints which pairs connect."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple[int, int]] = set()
            for members in b.column(0):
                x = np.unique(np.asarray(members.values, np.int64))
                out.update((int(x[i]), int(x[j])) for i, j in _within(x, radius))
            a, z = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    rows, found = fps.select("fp", F.lit(0).cast("long").alias("key")), []
    for level in range(levels):
        dealt = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(covering_masks(radius, level))]
        rows = rows.select("fp", "key", F.explode(F.array(*dealt)).alias("d")).select("fp", F.xxhash64("key", "d.i", "d.part").alias("key"))
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        last = level == levels - 1
        sized, _ = stash.put(rows.join(sizes, "key"))
        small = sized if last else sized.where(F.col("n") <= bucket)
        found.append(small.groupBy("key").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(scan, "a long, b long"))
        rows = sized.where(F.col("n") > bucket).select("fp", "key")
        if last or rows.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def simhash_groups(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fingerprint: 16 hex digits, component_id), a row for each row.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits, its own included.
    Null and wordless texts have fingerprint zero and link like any other. Rows with a null doc_id take part but
    never name a component, unless it has no other. Repeated rows stay. Columns besides doc_id and text are not read.
    An empty table gives no rows.
    """
    stash = Stash(docs.sparkSession, "simhash")
    prints, _ = stash.put(fingerprints(docs, shingle, seed))
    classes = _classes(prints, stash, radius, bucket)
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = classes.join(named, "root").select("fp", "component_id")
    return prints.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classes(prints: DataFrame, stash: Stash, radius: int, bucket: int) -> DataFrame:
    """(doc_id, fp, ...) -> fp, least (its smallest doc_id), root (the same for fingerprints that links connect)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_pairs(distinct.select("fp"), stash, radius, bucket), stash)
    return stash.put(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))[0]


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row of each component, with all its columns, whatever their names: the one with the smallest doc_id, a null one only
    if there is no other; of rows with one doc_id that with the smallest fingerprint, then that with the smallest hash.

    Null and wordless texts have fingerprint zero and link like any other; equal rows are one. An empty table gives no rows.
    What is settled by ids and hashes is settled first; texts are shuffled once, to the hashes of the rows that stay.
    """
    stash = Stash(docs.sparkSession, "simhash")
    columns = [F.col(f"`{c}`") if not isinstance(t, MapType) else F.to_json(F.col(f"`{c}`")) for c, t in ((f.name, f.dataType) for f in docs.schema)]
    one, two = (_free(docs, f"__row_{k}") for k in (1, 2))
    marked = docs.withColumns({one: F.xxhash64(F.lit(1), *columns), two: F.xxhash64(F.lit(2), *columns)})
    prints, _ = stash.put(fingerprints(marked, keep=(one, two)))
    classes = _classes(prints.select("doc_id", "fp"), stash, radius, bucket)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", one, two)).alias("r")
    kept = prints.join(classes, "fp").groupBy("root").agg(first).select(F.col(f"r.{one}").alias(one), F.col(f"r.{two}").alias(two))
    return marked.join(kept.hint("shuffle_hash"), [one, two], "left_semi").dropDuplicates([one, two]).drop(one, two)


def _free(docs: DataFrame, name: str) -> str:
    """The name, longer by underscores if a column has it."""
    while name in docs.columns:
        name += "_"
    return name

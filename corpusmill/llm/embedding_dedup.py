"""Near-duplicate vectors: sign hashing by random hyperplanes, exact cosines within buckets, connected components.

Equal vectors of a label form a class; only classes are compared. A table keys a class by the signs of its products with
some random hyperplanes; two vectors at cosine c share the key with probability (1 - arccos(c) / pi)^bits. A label of n
classes has LEAST_BITS bits at least and `SPARE` more than the logarithm of n, so that a bucket holds about a quarter of a class that has no
business there, at any size; its tables grow with the bits, so that a link at the threshold is missed in all of them with probability
`miss` at most, and one above less often.

A bucket larger than `block` is dealt to pairs of blocks, each its own task unit, so a hot bucket is compared whole
but nowhere at once. Tasks give link counts and a forest of links, never the pairs: a pair counts in the first table
that holds it together, which both signatures tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Stash
from corpusmill.llm.components import connected_components

THRESHOLD, MISS, BLOCK, SEED = 0.93, 3e-5, 4096, 29
LEAST_BITS, SPARE, FEW = 8, 2, 32


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by their largest part first, so none over- or underflows."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tables_for(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """How many tables of so many bits hold a pair at the threshold together but for the probability `miss`."""
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if alike >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-alike))


def signatures(x: np.ndarray, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    """Unit rows -> rows x tables sign patterns; the planes depend on seed, dimensions and bits. No bits: all alike."""
    out = np.zeros((len(x), tables), np.int32)
    planes = np.random.default_rng([seed, x.shape[1], bits]).normal(size=(x.shape[1], tables * bits)) if bits else None
    for k in range(0, len(x) if bits else 0, 4096):
        signs = (x[k : k + 4096] @ planes > 0).reshape(-1, tables, bits)
        out[k : k + 4096] = (signs << np.arange(bits)).sum(axis=2)
    return out


def _hashed(classes: DataFrame, threshold: float, miss: float, seed: int) -> DataFrame:
    """(class_no, label, members, embedding, bits) -> class_no, label, members, embedding, dims, parts: the key in each table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.asarray(v.values, np.float64) for v in b.column(3)]
            dims, bits = np.array([len(v) for v in values], np.int32), b.column(4).to_numpy()
            parts: list = [None] * len(values)
            for d, k in {*zip(dims.tolist(), bits.tolist())}:
                at = np.flatnonzero((dims == d) & (bits == k))
                for i, row in zip(at, signatures(unit_rows(np.stack([values[i] for i in at])), tables_for(k, threshold, miss), k, seed)):
                    parts[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(dims), pa.array(parts, pa.list_(pa.int32()))], ["class_no", "label", "members", "embedding", "dims", "parts"])

    kinds = dict(classes.dtypes)
    return classes.select("class_no", "label", "members", "embedding", "bits").mapInArrow(run, f"class_no long, label {kinds['label']}, members long, embedding {kinds['embedding']}, dims int, parts array<int>")


def _links(x: np.ndarray, y: np.ndarray | None, sx: np.ndarray, sy: np.ndarray, table: int, threshold: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs at the threshold that no earlier table holds together, some at a time. y None: pairs within x."""
    for k in range(0, len(x), step):
        cosines = x[k : k + step] @ (x if y is None else y).T
        a, b = np.nonzero(cosines >= threshold)
        a = a + k
        if y is None:
            a, b = a[a < b], b[a < b]
        for j in range(0, len(a), 1 << 18):
            i, z = a[j : j + (1 << 18)], b[j : j + (1 << 18)]
            new = ~(sx[i, :table] == sy[z, :table]).any(axis=1)
            yield i[new], z[new]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number that links reach from each row."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def _compare(threshold: float):
    """Sorted rows (key, i, j, t, side, class_no, members, embedding, parts) -> (a, b, n): link counts (b null) and forest links (n 0)."""

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(len(column), -1)

    def small(rows: pa.RecordBatch, runs: np.ndarray) -> Iterator[tuple[list, list, list]]:
        """Many whole buckets at once; runs: the bucket of each row. Pairs are those of neighbours at each distance in a bucket."""
        shapes = np.stack([pc.list_value_length(rows.column(c)).to_numpy(zero_copy_only=False) for c in ("embedding", "parts")], axis=1)
        for shape in np.unique(shapes, axis=0):
            mine = (shapes == shape).all(axis=1)
            part, run = rows.filter(pa.array(mine)), runs[mine]
            x, s, table = unit_rows(matrix(part.column("embedding"))), matrix(part.column("parts")), part.column("t").to_numpy()
            ids, at = np.unique(part.column("class_no").to_numpy(), return_inverse=True)
            weight, counts, links = part.column("members").to_numpy(), np.zeros(len(ids)), []
            for step in range(1, len(run)):
                a = np.flatnonzero(run[:-step] == run[step:])
                if not len(a):
                    break
                a = a[np.einsum("ij,ij->i", x[a], x[a + step]) >= threshold]
                new = ~((s[a] == s[a + step]) & (np.arange(s.shape[1]) < table[a, None])).any(axis=1)
                a = a[new]
                p, q = at[a], at[a + step]
                counts += np.bincount(p, weight[a + step], len(ids)) + np.bincount(q, weight[a], len(ids))
                links.append((p, q))
            if counts.any():
                low = _forest(len(ids), *(np.concatenate(e) for e in zip(*links)))
                linked, hung = np.flatnonzero(counts), np.flatnonzero(low != np.arange(len(ids)))
                yield [*ids[linked], *ids[hung]], [*[None] * len(linked), *ids[low[hung]]], [*counts[linked].astype(np.int64), *[0] * len(hung)]

    def unit(rows: list[pa.RecordBatch]) -> tuple[list, list, list]:
        whole = pa.Table.from_batches(rows)
        if whole.num_rows < 2:
            return [], [], []
        table, i, j = (whole.column(c)[0].as_py() for c in ("t", "i", "j"))
        side = whole.column("side").to_numpy()
        ids, weight = whole.column("class_no").to_numpy(), whole.column("members").to_numpy()
        x, s = unit_rows(matrix(whole.column("embedding"))), matrix(whole.column("parts"))
        p, q = np.flatnonzero(side == i), np.flatnonzero(side == j)
        counts, trees = np.zeros(len(ids)), []
        for a, b in _links(x[p], None if i == j else x[q], s[p], s[q], table, threshold):
            a, b = p[a], q[b]
            counts += np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
            low = _forest(len(ids), a, b)  # of so many pairs only what connects the same rows is held
            hung = np.flatnonzero(low != np.arange(len(ids)))
            trees.append((hung, low[hung]))
        if not counts.any():
            return [], [], []
        low = _forest(len(ids), *(np.concatenate(e) for e in zip(*trees)))
        linked, hung = np.flatnonzero(counts), np.flatnonzero(low != np.arange(len(ids)))
        return [*ids[linked], *ids[hung]], [*[None] * len(linked), *ids[low[hung]]], [*counts[linked].astype(np.int64), *[0] * len(hung)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        out: tuple[list, list, list] = ([], [], [])

        def give() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "n"])
            out = ([], [], [])
            return batch

        def close():
            for c, new in zip(out, unit(held)):
                c.extend(new)
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [b.num_rows]])
            # whole buckets of one block that are small go together; the first and last of a batch may have rows in others
            few = (ends - starts <= FEW) & (marks[1, starts] == marks[2, starts])
            few[[0, -1]] = False
            if few.any():
                runs = np.repeat(np.arange(len(starts)), ends - starts)
                rows = few[runs]
                for found in small(b.filter(pa.array(rows)), runs[rows]):
                    for c, new in zip(out, found):
                        c.extend(new)
            for start, end in zip(starts[~few].tolist(), ends[~few].tolist()):
                mark = tuple(marks[:, start].tolist())
                if mark != last and held:
                    close()
                last = mark
                held.append(b.slice(start, end - start))
            if len(out[0]) > 1 << 16:
                yield give()
        if held:
            close()
        yield give()

    return run


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(vec_id, embedding, label, ...) -> (vec_id, n_links, component_id, kept), a row for each row.

    Vectors link within a label at cosine >= threshold. Null labels and vectors that are null, empty, zero or hold a
    null or non-finite part link with nothing; vectors of different lengths don't link. n_links counts rows, so a
    repeated row is one more vector. component_id is the smallest vec_id reachable; a null vec_id takes part but names a component
    only if there is no other. Other columns are not read. An empty table gives no rows.
    """
    stash = Stash(vectors.sparkSession, "embeddings")
    rows = vectors.select("vec_id", "embedding", "label")
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    good, odd = rows.where(usable), rows.where(~usable)
    classes, _ = stash.put(good.groupBy("label", "embedding").agg(F.count("*").alias("members"), F.min("vec_id").alias("least")).withColumn("class_no", F.monotonically_increasing_id()))
    thin = classes.select("class_no", F.col("label"), F.size("embedding").alias("dims"))
    bits = F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2("n")) + SPARE).cast("int")
    sized = thin.join(thin.groupBy("label", "dims").agg(F.count("*").alias("n")), ["label", "dims"]).select("class_no", bits.alias("bits"))
    hashed, path = stash.put(_hashed(classes.join(sized, "class_no"), threshold, miss, seed))
    keys = hashed.select("class_no", "label", "dims", F.posexplode("parts").alias("t", "part")).select("class_no", "t", F.xxhash64("label", "dims", "t", "part").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    side = F.pmod(F.xxhash64("class_no", "key"), F.ceil(F.col("size") / block)).cast("int")
    dealt = keys.join(sizes, "key").select("class_no", "key", "t", side.alias("side"), (F.ceil(F.col("size") / block) - 1).cast("int").alias("top"))
    pairs = F.transform(F.sequence(F.lit(0), "top"), lambda k: F.struct(F.least(k, "side").alias("i"), F.greatest(k, "side").alias("j")))
    dealt = dealt.select("class_no", "key", "t", "side", F.explode(pairs).alias("p")).select("class_no", "key", "t", "side", "p.i", "p.j")
    units = dealt.join(hashed.select("class_no", "members", "embedding", "parts"), "class_no").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found, _ = stash.put(units.select("key", "i", "j", "t", "side", "class_no", "members", "embedding", "parts").mapInArrow(_compare(threshold), "a long, b long, n long"))
    stash.drop(path)
    counts = found.where("b is null").groupBy(F.col("a").alias("class_no")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b"), stash)
    rooted = classes.join(roots, classes.class_no == roots.node, "left").select("class_no", "label", "embedding", "members", "least", F.coalesce("root", "class_no").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = rooted.join(named, "root").join(counts, "class_no", "left").select("label", "embedding", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = good.join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = odd.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

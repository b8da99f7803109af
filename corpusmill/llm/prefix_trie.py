"""A trie of conversations by their first turns, with sums over subtrees by pointer jumping.

A prefix is known by a digest that adds up: each turn gives four 32-bit words, hashed from its depth and its role and text,
and a prefix is the sum of its turns' words. So prefixes of one conversation are running totals, which ranges of turns find
on their own (a long conversation is cut like any other rows), and a parent's digest is the child's less one turn.

Sums over subtrees take doubling rounds. Each node points to an ancestor and holds the sum over its descendants nearer than
that distance; a round adds the sums of the nodes that point to it, and lets its pointer jump to its ancestor's ancestor. After as many
rounds as the depth has binary digits all pointers are past the root. Sums are combined before they are shuffled, so a node
with many children is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Stash, placed, turn_mark
from corpusmill.operators.folds import walked

GROUP, HEADS = 5, 9  # conversations that share a first turns' source; shared turns are fewer than HEADS
WORDS, CHUNK = 4, 1 << 16
EMPTY = sha256(b"").hexdigest()


def _shared(conv: Column) -> Column:
    """How many first turns a conversation takes over."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


def rebuilt(turns: DataFrame, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) -> (conv_id, depth, mark, bytes) of the rebuilt conversations and (conv_id, size), their numbers of turns.

    A conversation c has the first h turns of conversation c - c % 5 (as many as there are), h = crc32(c as text) % 9, then its own
    turns after its first h. Only a turn's digest and size go on from here, never its text.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    thin, path = stash.put(turns.where("conv_id is not null").select("conv_id", "turn", turn_mark(F.col("role"), F.col("text")).alias("mark"), size.alias("bytes")))
    rows, _ = stash.put(placed(thin, "conv_id", ["turn", "mark"], stash))
    stash.drop(path)
    h = _shared(F.col("conv_id"))
    convs = rows.groupBy("conv_id").agg(F.max("total").alias("total")).select("conv_id", "total", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("source"), h.alias("h"))
    given = convs.select(F.col("conv_id").alias("source"), F.col("total").alias("there"))
    convs, _ = stash.put(convs.join(given, "source", "left").select("conv_id", "source", "h", "total", F.least(F.col("h").cast("long"), F.coalesce("there", F.lit(0))).alias("taken")))
    first = rows.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("source"), "pos", "mark", "bytes")
    head = first.join(convs.select("conv_id", "source", "h"), "source").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "mark", "bytes")
    tail = rows.where(F.col("pos") >= h).join(convs.select("conv_id", "taken"), "conv_id").select("conv_id", (F.col("taken") + F.col("pos") - h + 1).alias("depth"), "mark", "bytes")
    return head.unionByName(tail), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("size"))


def _term(k: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(k // 2), "mark", "depth"), 32 * (k % 2)).bitwiseAND(F.lit(0xFFFFFFFF))


def _packed(words: list[Column]) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(w.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for w in words)))


ROOT = b"\0" * 4 * WORDS


def prefixes(turns: DataFrame, stash: Stash) -> DataFrame:
    """(conv_id, depth, mark, bytes) -> conv_id, depth, bytes, node, parent: the digests of the prefix that a turn ends, and of the one before."""
    terms = [F.col(f"t{k}") for k in range(WORDS)]
    dealt = turns.repartitionByRange("conv_id", "depth").withColumn("__part", F.spark_partition_id())
    dealt, _ = stash.put(dealt.select("conv_id", "depth", "bytes", "__part", *(_term(k).alias(f"t{k}") for k in range(WORDS))))
    ranges = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that holds some of it
    totals = dealt.groupBy("conv_id", "__part").agg(*(F.sum(t).alias(f"s{k}") for k, t in enumerate(terms)))
    ahead = totals.select("conv_id", "__part", *(F.coalesce(F.sum(f"s{k}").over(ranges), F.lit(0)).alias(f"s{k}") for k in range(WORDS)))
    within = Window.partitionBy("conv_id", "__part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.select("*", *(F.sum(t).over(within).alias(f"w{k}") for k, t in enumerate(terms))).join(ahead, ["conv_id", "__part"])
    upto = [F.col(f"w{k}") + F.col(f"s{k}") for k in range(WORDS)]
    return rows.select("conv_id", "depth", "bytes", _packed(upto).alias("node"), _packed([u - t for u, t in zip(upto, terms)]).alias("parent"))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, conv_id) -> (node, first, ids): comma-joined ids of a node, some at a time."""
    node, first, ids, size = None, None, [], 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])

    for b in batches:
        for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (n != node or size > CHUNK):
                out.append((node, first, ",".join(ids)))
                ids, size = [], 0
                if len(out) >= 1024:
                    yield batch()
            if not ids:
                node, first = n, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        out.append((node, first, ",".join(ids)))
    yield batch()


def _digested(ordered: Iterator[tuple]) -> Iterator[tuple]:
    digest = None
    for _, _, ids in ordered:
        if digest is None:
            digest = sha256()
        else:
            digest.update(b",")
        digest.update(ids.encode())
    yield (digest.hexdigest(),)


def list_digests(ends: DataFrame) -> DataFrame:
    """(node, conv_id) -> node, ends_sha256: SHA-256 of a node's ids, ascending, joined by commas.

    Ids are sorted by ranges and joined there to texts of 64 KB; one task goes through a node's texts, as the digest needs, and
    holds one of them.
    """
    parts = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_chunks, "node binary, first long, ids string")
    return walked(parts, ["node"], ["first"], _digested, "node binary, ends_sha256 string", give=1024)


def rolled_up(nodes: DataFrame, sums: list[str], stash: Stash) -> DataFrame:
    """(node, parent, depth, sums...) -> node, sums...: the sums over each node's subtree, itself included, by doubling rounds."""
    now, path = stash.put(nodes.select("node", F.col("parent").alias("up"), F.col("depth").cast("long").alias("depth"), *sums))
    deepest, reach = now.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        added = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(*(F.sum(s).alias(f"__{s}") for s in sums))
        ancestors = now.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("__next"))
        higher = now.where(F.col("depth") >= 2 * reach).join(ancestors, "up").select("node", F.col("__next").alias("up"), "depth", *sums)
        rest = now.where(F.col("depth") < 2 * reach).select("node", F.lit(None).cast("binary").alias("up"), "depth", *sums)
        moved = higher.unionByName(rest).join(added, "node", "left")
        after, fresh = stash.put(moved.select("node", "up", "depth", *((F.col(s) + F.coalesce(f"__{s}", F.lit(0))).alias(s) for s in sums)))
        stash.drop(path)
        now, path, reach = after, fresh, 2 * reach
    return now.select("node", *sums)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    Turns go by turn, null first; equal ones by a digest of role and text. Null role and text are empty. Rows without conv_id
    belong to no conversation. Repeated rows are turns of their own. Other columns are not read. An empty table has no nodes, not even a root.
    """
    stash = Stash(turns.sparkSession, "trie")
    rows, sizes = rebuilt(turns.select("conv_id", "turn", "role", "text"), stash)
    marked, _ = stash.put(prefixes(rows, stash))
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "conv_id", "n_convs")
    found = marked.groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("parent", "depth", "bytes")), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    found, path = stash.put(found.unionByName(root))
    children = found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = found.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    told = found.join(children, "node", "left").join(above, "parent", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    told, _ = stash.put(told.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": saved}))
    stash.drop(path)
    sums = rolled_up(told, ["n_leaves", "saved_tokens"], stash)
    last = marked.join(sizes, "conv_id").where("depth = size").select("node", "conv_id").unionByName(sizes.where("size = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    ends = list_digests(last)
    out = told.drop("n_leaves", "saved_tokens").join(sums, "node").join(ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

"""A Merkle manifest of a dataset: a tree for each source, a tree of their roots, and a proof for every document.

Nodes are built from events. An event brings indexed child digests to a parent; a partial parent gathers them until it
has as many as the size of its level says, then becomes an event for its own parent. A task takes its events in order of
the documents, so what it leaves unfinished is the two borders of its stretch at each level. This frontier alone is
shuffled, by parent, and combined again, until nothing is open: as many rounds as the tree has levels, each of
fewer rows. No key ever gathers more than `ARITY` digests, however many documents a source holds.

Proofs go the other way: each node hands its children their siblings and its own path. Paths are kept for blocks of
ARITY^2 documents only; the two lowest levels are told from the block's own digests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Stash, placed

ARITY, PENDING = 16, 1 << 17
BLOCK = ARITY * ARITY
WIDTH = 32  # bytes of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot:int,near:binary>>"


def _leaf(**changed: Column) -> Column:
    """SHA-256 over the fields, each with its length in bytes; `-` stands for null."""
    told = (F.concat(F.octet_length(v), F.lit(":"), v) for v in (changed.get(f, F.col(f).cast("string")) for f in FIELDS))
    return F.unhex(F.sha2(F.concat(*(F.coalesce(v, F.lit("-")) for v in told)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and, where a document is tampered with, the leaf of the changed document (else null).

    Tampering lower-cases A-Z in the text of documents whose crc32(doc_id as text) is divisible by 5; a null doc_id is left alone.
    """
    upper = "".join(map(chr, range(65, 91)))
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select("doc_id", "source", _leaf().alias("leaf"), F.when(hit, _leaf(text=F.translate("text", upper, upper.lower()))).alias("tampered"))


def _height(total: int) -> int:
    h = 0
    while total > 1:
        total, h = -(-total // ARITY), h + 1
    return h


def _hash(digests: bytes) -> bytes:
    """The parent of concatenated digests, which are hashed as hex text."""
    return sha256(digests.hex().encode()).digest()


EVENT = "grp string, level int, idx long, total long, slots binary, digests binary"
NODE = EVENT + ", digest binary"


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events (EVENT: child digests of the parent idx at a level, and their slots) -> finished nodes, and open parents (digest null).

    Finished nodes are given from level 2 on, and where they are the top of their group. A task holds open parents only;
    beyond PENDING of them it hands them on as they are.
    """
    held: dict[tuple, dict[int, bytes]] = {}
    out: list[tuple] = []

    def give() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["grp", "level", "idx", "total", "slots", "digests", "digest"])
        out.clear()
        return batch

    for b in batches:
        for grp, level, idx, total, slots, digests in zip(*(c.to_pylist() for c in b.columns)):
            found = {s: digests[k * WIDTH : (k + 1) * WIDTH] for k, s in enumerate(slots)}
            if level == 0:  # a group of one
                out.append((grp, 0, 0, total, b"", b"", digests))
                continue
            while True:
                below = -(-total // ARITY ** (level - 1))  # nodes of the level underneath
                partial = held.setdefault((grp, level, idx, total), {})
                partial |= found
                if len(partial) < min(ARITY, below - ARITY * idx):
                    break
                del held[grp, level, idx, total]
                children = b"".join(partial[s] for s in range(len(partial)))
                digest, top = _hash(children), below <= ARITY
                if level > 1 or top:
                    out.append((grp, level, idx, total, b"", children, digest))
                if top:
                    break
                found, level, idx = {idx % ARITY: digest}, level + 1, idx // ARITY
            if len(held) > PENDING:
                out.extend((*k, bytes(p), b"".join(p.values()), None) for k, p in held.items())
                held.clear()
            if len(out) >= 4096:
                yield give()
    out.extend((*k, bytes(p), b"".join(p.values()), None) for k, p in held.items())
    if out:
        yield give()


def nodes(leaf_rows: DataFrame, stash: Stash) -> DataFrame:
    """(grp, pos, total, leaf) -> grp, level, idx, total, digests (of the children), digest, top: inner nodes from level 2 on, and the tops."""
    lone = F.col("total") == 1
    slot = F.unhex(F.lpad(F.hex(F.col("pos") % ARITY), 2, "0"))
    events = leaf_rows.select("grp", F.when(lone, 0).otherwise(1).alias("level"), F.floor(F.col("pos") / ARITY).alias("idx"), "total", slot.alias("slots"), F.col("leaf").alias("digests"))
    events = events.sortWithinPartitions("grp", "idx", "slots")
    rounds: list[DataFrame] = []
    while True:
        done, _ = stash.put(events.mapInArrow(_combine, NODE))
        rounds.append(done.where("digest is not null"))
        rest = done.where("digest is null")
        if rest.isEmpty():
            break
        events = rest.drop("digest").repartition("grp", "level", "idx")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.select("grp", "level", "idx", "total", "digests", "digest", (F.pow(F.lit(float(ARITY)), "level") >= F.col("total")).alias("top"))


def paths(tree: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """nodes -> grp, block, path, subroot[, root]: for each block of ARITY^2 leaves what lies beside the way from its node to the top.

    above (grp, path, root): the ways on from the tops. Groups of fewer levels have one block whose path starts at their top.
    """
    tops = tree.where("top").select("grp", "level", "idx", "digests", F.col("digest").alias("subroot"))
    if above is None:
        tops = tops.select("*", F.array().cast(PATH).alias("path"), F.col("subroot").alias("root"))
    else:
        tops = tops.join(above.select(F.col("grp").alias("__g"), "path", "root"), F.col("grp").eqNullSafe(F.col("__g"))).drop("__g")
    highest = tree.agg(F.max("level")).first()[0] or 0
    at = tops.where(F.col("level") == highest)
    for level in range(highest - 1, 1, -1):
        parent = at.select(F.col("grp").alias("__g"), F.col("idx").alias("__up"), F.col("digests").alias("__all"), "path", "subroot", "root")
        own = tree.where((F.col("level") == level) & ~F.col("top"))
        slot = (F.col("idx") % ARITY).cast("int")
        near = F.concat(F.substring("__all", F.lit(1), slot * WIDTH), F.substring("__all", slot * WIDTH + 1 + WIDTH, F.length("__all")))
        step = F.array(F.struct(slot.alias("slot"), near.alias("near")))
        down = own.join(parent, F.col("grp").eqNullSafe(F.col("__g")) & (F.floor(F.col("idx") / ARITY) == F.col("__up")))
        at = down.select("grp", "level", "idx", "digests", "subroot", F.concat(step, "path").alias("path"), "root").unionByName(tops.where(F.col("level") == level))
    low = tops.where("level < 2" if highest > 1 else f"level < {highest}")
    return at.unionByName(low).select("grp", F.col("idx").alias("block"), "path", "subroot", "root")


Step = tuple[int, bytes]  # a node's place among the children of its parent, and the others


def _steps(leaf: list[bytes]) -> Iterator[list[Step]]:
    """The ways from each leaf of a block to the block's own node, through at most two levels."""
    runs = [leaf[k : k + ARITY] for k in range(0, len(leaf), ARITY)]
    parents = [_hash(b"".join(run)) for run in runs]
    for k, run in enumerate(runs):
        for i in range(len(run)):
            near = b"".join(run[:i] + run[i + 1 :])
            yield [(i, near), (k, b"".join(parents[:k] + parents[k + 1 :]))]


def folded(digest: bytes, way: Iterable[Step]) -> bytes:
    """The root that a digest leads to along a way."""
    for slot, near in way:
        digest = _hash(near[: slot * WIDTH] + digest + near[slot * WIDTH :])
    return digest


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows (grp, block, pos, total, leaf, tampered, key, path, subroot, root), a block's path row (pos null) first -> (path row, leaf rows)."""
    head, rest = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[2] is None:
                if head is not None:
                    yield head, rest
                head, rest = row, []
            else:
                rest.append(row)
    if head is not None:
        yield head, rest


def _ways(head: tuple, rows: list[tuple]) -> Iterator[tuple[tuple, list[Step], list[Step]]]:
    """(row, steps within the block, steps above it) of each row of a block."""
    above = [(s["slot"], s["near"]) for s in head[7]]
    for row, own in zip(rows, _steps([r[4] for r in rows])):
        yield row, own[: _height(row[3])], above


def _together(leaf_rows: DataFrame, ways: DataFrame, key: str) -> DataFrame:
    """Leaves beside the path of their block, sorted."""
    kind = leaf_rows.schema[key].dataType.simpleString()
    block = F.floor(F.col("pos") / BLOCK)
    own = leaf_rows.select("grp", block.alias("block"), "pos", "total", "leaf", "tampered", F.col(key).alias("key"), F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"))
    head = ways.select("grp", "block", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("tampered"), F.lit(None).cast(kind).alias("key"), "path", "subroot", "root")
    return own.unionByName(head).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _path_of_each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, rows in _blocks(batches):
        got = [(row[6], [{"slot": s, "near": n} for s, n in own + above], head[9]) for row, own, above in _ways(head, rows)]
        keys, ways, roots = zip(*got)
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("near", pa.binary())]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ways, kind), pa.array(roots, pa.binary())], ["grp", "path", "root"])


COLUMNS = ("leaf", "subroot", "root", "proof_sha256", "folded_root")


def _proved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, rows in _blocks(batches):
        out, known = [], {}
        subroot, root = head[8].hex(), head[9].hex()
        tail = "".join(n.hex() for _, n in ((s["slot"], s["near"]) for s in head[7])).encode()
        for row, own, above in _ways(head, rows):
            proof = sha256(b"".join(n.hex().encode() for _, n in own) + tail).hexdigest()
            within = folded(row[5] or row[4], own)
            if within not in known:
                known[within] = folded(within, above).hex()
            out.append((row[6], row[4].hex(), subroot, root, proof, known[within], known[within] == root))
        ids, *texts, verified = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(t, pa.string()) for t in texts), pa.array(verified, pa.bool_())], ["doc_id", *COLUMNS, "verified"])


def manifest_audit(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, n_chars, text, ...) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row.

    folded_root is recomputed from the tampered leaf (see `leaves`), else the original one, and the original siblings; verified
    tells whether it equals the root. Null and empty sources are two sources; rows of a source with the same doc_id (null first) go
    by their leaf, so repeated rows are neighbours. Nulls anywhere are hashed as `-`. Texts are hashed where they are read and
    never shuffled; other columns, whatever their names, are not read. An empty table gives no rows.
    """
    stash = Stash(docs.sparkSession, "manifest")
    thin, path = stash.put(leaves(docs.select(*FIELDS)).withColumnRenamed("source", "grp"))
    ranked, _ = stash.put(placed(thin, "grp", ["doc_id", "leaf"], stash))
    stash.drop(path)
    tree = nodes(ranked, stash)
    tops = tree.where("top").select(F.lit(None).cast("string").alias("all"), F.col("grp").alias("source"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("tampered"))
    over, _ = stash.put(placed(tops, "all", ["source"], stash).withColumnRenamed("all", "grp"))
    ways = _together(over, paths(nodes(over, stash)), "source").mapInArrow(_path_of_each, f"grp string, path {PATH}, root binary")
    known, _ = stash.put(paths(tree, ways))
    return _together(ranked, known, "doc_id").mapInArrow(_proved, "doc_id long, " + ", ".join(f"{c} string" for c in COLUMNS) + ", verified boolean")

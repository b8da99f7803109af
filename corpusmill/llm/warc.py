"""WARC records and a Merkle fixity audit of replicas.

A record is a WARC/1.1 response built from a row, or read from files (`read_records`). An archive is the ordered list of its records,
each at an offset; a leaf is the SHA-256 of a record's place and bytes, an inner node that of its offset range and its
children; a node at level k covers `fanout`^k record numbers. Trees are grouped hashes, level by level, over all
archives at once.

The audit compares the roots of two replicas, then joins the children of mismatching nodes only, level by level, down to
the leaves: what is read back at each level is in proportion to the damage.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Stash

FANOUT, LEVELS, ARCHIVE_RECORDS, NAMELESS = 16, 3, 1024, 1 << 20


#: When a row without a date of its own was fetched.
DATE = "1970-01-01T00:00:00Z"


def record_id(url: Column, date: str = DATE) -> Column:
    """A record's identifier: a UUID made of the MD5 of its date and address, the same in every replica."""
    h = F.md5(F.concat(F.lit(f"{date} "), F.coalesce(url, F.lit(""))).cast("binary"))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def record_text(url: Column, body: Column, date: str = DATE) -> Column:
    """A response record's bytes, as text: header lines, an empty line, the body (text, or bytes as they are), two line ends."""
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("string")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), record_id(url, date), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"), F.coalesce(body.cast("string"), F.lit("")), F.lit("\r\n\r\n"))


def records(pages: DataFrame, per_archive: int = ARCHIVE_RECORDS) -> DataFrame:
    """(page_id, url, html, ...) -> archive, number, page_id, copies, length, offset, digest: one replica's record table.

    Page ids in a range of per_archive form an archive, its records ordered by page_id, then digest and url, and laid
    one after the other: offset counts bytes from the archive's start. Rows equal in id, url and html are one record
    with their number as copies. Rows with a null id form archives of their own, -1 to -NAMELESS by digest.
    """
    body = record_text(F.col("url"), F.col("html"))
    rows = pages.select("page_id", "url", F.octet_length(body).cast("long").alias("length"), F.sha2(body.cast("binary"), 256).alias("digest"))
    rows = rows.groupBy("page_id", "url", "length", "digest").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("archive", F.coalesce(F.floor(F.col("page_id") / per_archive).cast("long"), -1 - F.pmod(F.xxhash64("digest"), F.lit(NAMELESS))))
    order = Window.partitionBy("archive").orderBy("page_id", "digest", "url")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("archive", (F.row_number().over(order) - 1).cast("long").alias("number"), "page_id", "copies", "length", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "digest")


def leaves(records: DataFrame) -> DataFrame:
    """(archive, number, offset, length, digest, copies) -> archive, position, first, last, hash; first to last is the offset range."""
    leaf = F.sha2(F.concat_ws(":", F.lit("0"), "offset", "length", "digest", "copies"), 256)
    return records.select("archive", F.col("number").alias("position"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), leaf.alias("hash"))


def parents(nodes: DataFrame, level: int, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The nodes above: each hashes its level, its offset range and its children's positions and hashes in order.

    A node has at most fanout children; the root, at the last level, has all nodes of the level below.
    """
    children = F.sort_array(F.collect_list(F.struct("position", "hash")))
    told = F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["position"].cast("string"), c["hash"])), ",")
    ranges = nodes.groupBy("archive", _above(level, fanout, levels).alias("position")).agg(F.min("first").alias("first"), F.max("last").alias("last"), told.alias("told"))
    return ranges.select("archive", "position", "first", "last", F.sha2(F.concat_ws(":", F.lit(str(level)), "first", "last", "told"), 256).alias("hash"))


def _above(level: int, fanout: int, levels: int) -> Column:
    return F.lit(0).cast("long") if level == levels else F.floor(F.col("position") / fanout).cast("long")


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Two replicas' record tables -> a row for each record place where they differ.

    Columns: archive, number, left_offset, left_length, left_digest, right_offset, right_length, right_digest (null
    where that replica lacks the record) and fault: missing_left, missing_right, corrupt, moved (the same bytes at another
    offset) or copies_differ (the same bytes in the same place, another number of repeated rows). Equal replicas, two
    empty ones too, give no rows. A table without the column copies has one of each.
    """
    stash = Stash(left.sparkSession, "warc")
    tables = [stash.put(r.select("archive", "number", "offset", "length", "digest", F.coalesce("copies", F.lit(1)).alias("copies") if "copies" in r.columns else F.lit(1).alias("copies")))[0] for r in (left, right)]
    trees = [[leaves(r)] for r in tables]
    for tree in trees:
        for level in range(1, levels + 1):
            tree.append(stash.put(parents(tree[-1], level, fanout, levels))[0])
    bad = None
    for level in range(levels, -1, -1):
        a, b = (t[level].select("archive", "position", F.col("hash").alias(side)) for t, side in zip(trees, ("l", "r")))
        if bad is not None:
            a, b = (n.withColumn("up", _above(level + 1, fanout, levels)).join(bad, ["archive", "up"], "left_semi").drop("up") for n in (a, b))
        differ = a.join(b, ["archive", "position"], "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
        bad, _ = stash.put(differ.select("archive", F.col("position").alias("up")))
    places = bad.select("archive", F.col("up").alias("number"))
    both = places
    for r, side in zip(tables, ("left", "right")):
        own = r.join(places, ["archive", "number"], "left_semi").select("archive", "number", *(F.col(c).alias(f"{side}_{c}") for c in ("offset", "length", "digest")))
        both = both.join(own, ["archive", "number"], "left")
    same, place = F.col("left_digest") == F.col("right_digest"), F.col("left_offset") == F.col("right_offset")
    fault = F.when(F.col("left_digest").isNull(), "missing_left").when(F.col("right_digest").isNull(), "missing_right").when(~same, "corrupt").when(~place, "moved").otherwise("copies_differ")
    return both.withColumn("fault", fault)


def damaged(pages: DataFrame, per_archive: int = ARCHIVE_RECORDS) -> DataFrame:
    """The record table of a replica with planted damage, for an audit where no second copy exists.

    Of the pages whose id has an MD5 that begins with 00 to 03 (one in 64), those with a third digit under 8 have their
    first character, if it is < or a space, overwritten by ?, the others are lost; all other records stay in their places.
    """
    mark = F.md5(F.col("page_id").cast("string").cast("binary"))
    hit = F.coalesce(mark < "04", F.lit(False))
    lost = hit & (F.substring(mark, 3, 1) >= "8")
    broken = hit & ~lost & F.coalesce(F.substring("html", 1, 1).isin("<", " "), F.lit(False))
    html = F.when(broken, F.concat(F.lit("?"), F.substring("html", 2, 2147483647))).otherwise(F.col("html"))
    return records(pages.withColumn("html", html), per_archive).where(~lost)


def write_warc(out: BinaryIO, items: Iterator[tuple[str, bytes]], gzipped: bool = False) -> list[tuple[int, int]]:
    """Writes (url, body) response records one by one; the (offset, length) of each in the file."""
    at, places = 0, []
    for url, body in items:
        h = hashlib.md5(f"{DATE} {url}".encode()).hexdigest()
        name = f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        data = head + body + b"\r\n\r\n"
        data = gzip.compress(data, mtime=0) if gzipped else data
        out.write(data)
        places.append((at, len(data)))
        at += len(data)
    return places


#: What stands between two records: the end of one and the beginning of the next.
_BORDER = "\r\n\r\nWARC/1."


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """WARC files (plain, or gzip as a whole or by record), by any path that Spark reads -> a row for each record:
    file, type, url, headers (map, lower-cased names), body binary, whole (the body is as long as its header says).

    Files are split at the borders of records by Spark's text reader, so plain ones are read by many tasks. A body that holds
    such a border itself is put together again by its length, as far as its task's part of the file goes; a record that
    ends early has whole = false, and is not dropped. Empty files give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, bytes] | None = None
        border = _BORDER.encode()
        for b in batches:
            rows: list[tuple] = []
            for file, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and held[0] == file:
                    piece = held[1] + border + piece
                elif held:
                    rows.append(_parsed(*held))
                held = (file, piece)
                row = _parsed(file, piece)
                if row is None or row[-1]:
                    rows.append(row)
                    held = None
            yield _table(rows)
        if held:
            yield _table([_parsed(*held)])

    raw = spark.read.option("lineSep", _BORDER).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return raw.mapInArrow(run, "file string, type string, url string, headers map<string,string>, body binary, whole boolean")


def _parsed(file: str, piece: bytes) -> tuple | None:
    """file, type, url, headers, body, whole of a record without what marks its begin; None for what holds no record."""
    if not piece.strip():
        return None
    head, _, body = piece.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {name.strip().lower(): value.strip() for name, _, value in pairs if name.strip()}
    told = headers.get("content-length", "")
    size = int(told) if told.isdigit() else len(body)
    return file, headers.get("warc-type"), headers.get("warc-target-uri"), headers, body[:size], len(body) >= size


def _table(rows: list[tuple | None]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]
    columns = list(zip(*(r for r in rows if r))) or [()] * len(kinds)
    columns[3] = [list(h.items()) for h in columns[3]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "type", "url", "headers", "body", "whole"])


def write_records(pages: DataFrame, path: str, compression: str = "none", date: str = DATE) -> None:
    """(url, html, ...) -> WARC files of response records, a file for each partition; compression as Spark's text writer has it.

    html is text or binary; null url and html are empty; repeated rows are repeated records. Other columns are not read, an empty
    table gives files without records.
    """
    data = record_text(F.col("url"), F.col("html"), date).cast("binary")
    # the writer adds the last line end
    pages.select(F.substring(data, F.lit(1), F.length(data) - 1).cast("string").alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)


class _Unzipped:
    """Reads gzip members one after another, or plain bytes, with little held."""

    def __init__(self, source: BinaryIO, chunk: int = 1 << 16):
        self.source, self.chunk, self.held, self.inflate = source, chunk, b"", None
        start = source.read(2)
        self.raw, self.zipped = start, start == b"\x1f\x8b"

    def _more(self) -> bool:
        if not self.zipped:
            data, self.raw = self.raw or self.source.read(self.chunk), b""
            self.held += data
            return bool(data)
        while True:
            data, self.raw = self.raw or self.source.read(self.chunk), b""
            if not data:
                return False
            self.inflate = self.inflate or zlib.decompressobj(31)
            got = self.inflate.decompress(data)
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            if got:
                self.held += got
                return True

    def line(self) -> bytes:
        while b"\n" not in self.held and self._more():
            pass
        line, end, self.held = self.held.partition(b"\n")
        return line + end

    def take(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n:
            self.held = b""
            if not self._more():
                break
            parts.append(self.held)
            size += len(self.held)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]


def read_warc(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-cased names, body) of each record of a plain or member-gzipped file, one at a time.

    ValueError where a record does not start with WARC/ or its body ends early.
    """
    data = _Unzipped(source)
    while True:
        line = data.line()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        headers = {}
        while (line := data.line()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        if not line:
            raise ValueError("the file ends within a record")
        size = int(headers.get("content-length", 0))
        body = data.take(size)
        if len(body) < size:
            raise ValueError("the file ends within a record")
        yield headers, body


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

"""Small files and folders on whatever storage a path names, through Hadoop's file systems."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _at(spark, path)
    return files.exists(place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file; None where there is none."""
    place, files = _at(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all: a new file beside it is renamed over it."""
    own = _own(path, _bare(spark))
    if own:
        return _put(own, text)
    Files(spark).write(path, text)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a file or folder; the folder above the new place is made if need be."""
    place, files = _at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    files.mkdirs(target.getParent())
    return files.rename(place, target)


def delete(spark: SparkSession, path: str) -> bool:
    place, files = _at(spark, path)
    return files.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    place, files = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder; 0 where there is none."""
    place, files = _at(spark, path)
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


class Files:
    """Writes, moves and deletes of many files: the session's configuration is copied once, not once a file. Threads may share it."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._path, self._conf = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
        self._made, self._contexts = set(), {}
        self._over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def rename(self, path: str, to: str) -> bool:
        place, folder = self._path(path), to.rsplit("/", 1)[0]
        files = place.getFileSystem(self._conf)
        if folder not in self._made:
            files.mkdirs(self._path(folder))
            self._made.add(folder)
        return files.rename(place, self._path(to))

    def delete(self, path: str) -> bool:
        place = self._path(path)
        return place.getFileSystem(self._conf).delete(place, True)

    def write(self, path: str, text: str) -> None:
        """A file whole or not at all: a new one beside it is renamed over it."""
        place, fresh = self._path(path), self._path(f"{path}.{uuid.uuid4()}.new")
        files = place.getFileSystem(self._conf)
        stream = files.create(fresh, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._context(files.getUri())
        context.rename(context.makeQualified(fresh), context.makeQualified(place), self._over)

    def _context(self, uri):
        at = uri.toString()
        if at not in self._contexts:
            self._contexts[at] = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf)
        return self._contexts[at]


# Hadoop's local file system starts a process for each file that it makes, to set its rights, and Python reaches it by calls over a socket. Where a
# path lies on a local or mounted file system, which Spark's own writers take to be the same for driver and executors, Python's own calls do it in tasks.


def _bare(spark: SparkSession) -> bool:
    """Whether paths without a scheme are files of the local file system."""
    told = spark.conf.get("fs.defaultFS", None) or spark._jsc.hadoopConfiguration().get("fs.defaultFS")
    return told.startswith("file:")


def _own(path: str, bare: bool) -> str | None:
    """The path as Python's calls take it; None if it is relative or on any other storage."""
    told = re.fullmatch(r"file:(?://(?=/))?(/.*)", path, re.DOTALL)
    return told[1] if told else path if bare and path.startswith("/") else None


def _sum(own: str) -> str:
    """The file beside it in which Hadoop keeps its checksums."""
    folder, name = os.path.split(own.rstrip("/"))
    return f"{folder}/.{name}.crc"


def _put(own: str, text: str) -> None:
    fresh = f"{own}.{uuid.uuid4()}.new"
    os.makedirs(os.path.dirname(own), exist_ok=True)
    with open(fresh, "wb") as out:
        out.write(text.encode())
    with contextlib.suppress(FileNotFoundError):  # sums of what was there before
        os.remove(_sum(own))
    os.replace(fresh, own)


def _drop(own: str) -> None:
    """A file or folder that can't be deleted stays."""
    if os.path.isdir(own) and not os.path.islink(own):
        shutil.rmtree(own, ignore_errors=True)
        return
    for place in (own, _sum(own)):
        with contextlib.suppress(OSError):
            os.remove(place)


def _spread(rows: DataFrame, put: Callable[[DataFrame], DataFrame], near: Callable[[str, dict], None], far: Callable[[Files, dict], None], threads: int) -> None:
    """Rows (path, ...): tasks do what Python's own calls can; the driver's threads do the rest as its rows stream by."""
    spark, bare = rows.sparkSession, _bare(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for r in batch.to_pylist():
                own = _own(r["path"], bare)
                if own:
                    near(own, r)
                else:
                    left.append(r)
            yield pa.RecordBatch.from_pylist(left, batch.schema)

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest, files = put(rows.repartition(parts, "path").mapInArrow(run, rows.schema)), Files(spark)
    with ThreadPoolExecutor(threads) as pool:
        for chunk in _chunks(rest.toLocalIterator()):
            list(pool.map(lambda r: far(files, r), chunk))


def _chunks(rows: Iterator, size: int = 1024) -> Iterator[list]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def write_texts(rows: DataFrame, put: Callable[[DataFrame], DataFrame], threads: int = 16) -> None:
    """(path, text) -> a small file of each, whole or not at all. put writes what is read twice."""
    _spread(rows.select("path", "text"), put, lambda own, r: _put(own, r["text"]), lambda files, r: files.write(r["path"], r["text"]), threads)


def delete_all(rows: DataFrame, put: Callable[[DataFrame], DataFrame], threads: int = 16) -> None:
    """(path) -> deletes each file or folder; one that can't be deleted stays. put writes what is read twice."""

    def far(files: Files, row: dict) -> None:
        with contextlib.suppress(Exception):
            files.delete(row["path"])

    _spread(rows.select("path"), put, lambda own, _: _drop(own), far, threads)

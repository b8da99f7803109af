"""What the operators of this subpackage share: table access, written intermediates, text words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that `bytes.split()` takes as white space: \x20 and \x09-\x0D, the word separators of every contract here.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the setting is missing (tests on one machine) is a folder of the warehouse used instead.
    """
    return spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.corpusmill"


class Stash:
    """Written intermediates: each `put` cuts lineage with a Parquet table in the shared folder.

    A lost executor costs only the tasks that read the table again. `drop` removes tables that nothing reads
    any more; what a returned DataFrame still reads goes when the application ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        place, files = self._place(path)
        files.deleteOnExit(place)
        # the schema is given: an empty table may have no files with one
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        place, files = self._place(path)
        files.delete(place, True)

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())


def held_out(doc_id: Column | str) -> Column:
    """True for rows whose crc32(doc_id as text) mod 5 is 0; labels are learned from the others only."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def placed(rows: DataFrame, group: str, order: list[str], stash: Stash) -> DataFrame:
    """rows with pos, the 0-based place in `order` within the group, and total, the group's rows.

    Rows are dealt to ranges of group and order, so a hot group is cut as well; a range's rows keep their order in a growing
    number, from which a place follows by the counts of the ranges before.
    """
    dealt, _ = stash.put(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    spans = dealt.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)  # a row for each range that holds the group
    ahead = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), (ahead - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("total"))
    joined = dealt.join(spans, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return joined.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "total")


def turn_mark(role: Column, text: Column) -> Column:
    """SHA-256 of a turn's role and text (null: empty), which orders turns of the same number."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))

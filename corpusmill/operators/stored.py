"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources import shared


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of the warehouse only where that is unset, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.corpusmill"


def stored(rows: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The rows, written as Parquet and read again (by spark, if another session made them): computed once, and a lost executor costs no lineage.

    The table goes when the application ends.
    """
    spark = spark or rows.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    # the schema is given: an empty table may have no files with one
    return spark.read.schema(rows.schema).parquet(path)


class Scratch:
    """Tables written between the steps of one piece of work, dropped at its end: `with Scratch(spark) as put: a = put(rows)`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, rows: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def __exit__(self, *error) -> None:
        shared.delete(self.spark, self.base)

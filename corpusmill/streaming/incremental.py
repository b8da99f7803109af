"""Streaming forms: guards and near-duplicate checks against a fixed index, with Structured Streaming's checkpoints as cursors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import dedup, guards, runs


def read_json_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Files of JSON lines as they arrive, a bounded number in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def number_alerts(series: DataFrame, guard: guards.Guard = guards.Guard()) -> DataFrame:
    """Rows of a metrics stream that halt by themselves; no state."""
    return guards.number_guard(series, guard).where("reason is not null")


def windowed_loss(series: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """(run, at, loss) -> mean and largest loss of each run in event-time windows; the watermark bounds the state."""
    return series.withWatermark("at", late).groupBy("run", F.window("at", size).alias("w")).agg(F.avg("loss").alias("mean_loss"), F.max("loss").alias("max_loss"), F.count("*").alias("n")).select("run", F.col("w.start").alias("start"), "mean_loss", "max_loss", "n")


def against_index(index: DataFrame, sink: Callable[[DataFrame, int], None], threshold: float = dedup.THRESHOLD) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch (row_id, text) is compared with an index of sketches; ranked matches go to the sink."""

    def check(batch: DataFrame, batch_id: int) -> None:
        fresh = dedup.sketches(batch.select("row_id", text.normalized_all(F.col("text")).alias("norm")))
        sink(dedup.ranked_hits(dedup.similar(fresh, index, threshold)), batch_id)

    return check


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works off what is there and stops; a later call goes on where this one stopped, without gaps or repeats."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_until(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, should_stop: Callable[[], bool], poll: float = 0.2) -> None:
    """Goes on with a stream until should_stop says so, between batches, or the stream ends; a later run goes on from there."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    try:
        while query.isActive and not should_stop():
            query.awaitTermination(poll)
    finally:
        if query.isActive:
            query.stop()


def warning_of(budget: runs.Budget, on_warn: Callable[[str, str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over usage rows of whole runs: on_warn(run, limits) where a limit is first neared."""

    def warn(batch: DataFrame, batch_id: int) -> None:
        for r in runs.running_usage(batch, budget).where("warned <> ''").select("run", "warned").collect():  # one row a run and limit
            on_warn(str(r.run), r.warned)

    return warn

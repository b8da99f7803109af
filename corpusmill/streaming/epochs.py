"""A resumable reader of a rank's epochs: a stream whose offset is the cursor.

The source gives ranges of the rank's order, a batch at a time; what it hands to Spark is two numbers, whatever the batch's
rows. The rows are read from the order's table, which is laid out by rank and epoch and sorted by index, so a range reads its own
row groups. Structured Streaming keeps the cursor: a batch that fails is asked for again with the same range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from corpusmill.operators.sharding import Cursor, ShardSpec, reconciled

RANGES = "epoch int, first long, stop long"


class EpochReader(SimpleDataSourceStreamReader):
    """Ranges from a cursor on; offsets are cursors. A cursor of another topology is refused, or goes back to its epoch's start."""

    def __init__(self, options: dict[str, str]):
        whole = {k: int(options[k]) for k in ("world_size", "rank", "num_buckets", "rows", "epochs", "batch_rows")}
        self.rows, self.epochs, self.batch = whole["rows"], whole["epochs"], whole["batch_rows"]
        self.spec = ShardSpec(whole["world_size"], whole["rank"], whole["num_buckets"])
        self.allow = options.get("allow_reshard", "false") == "true"
        if self.batch < 1 or self.rows < 0 or self.epochs < 0:
            raise ValueError("need batch_rows >= 1, rows >= 0 and epochs >= 0")

    def _cursor(self, epoch: int, index: int) -> Cursor:
        return Cursor(epoch, index, self.spec.world_size, self.spec.rank, self.spec.num_buckets)

    def initialOffset(self) -> dict:
        return asdict(self._cursor(0, 0))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = reconciled(Cursor(**start), self.spec, self.allow)
        if at.epoch >= self.epochs or not self.rows:
            return iter(()), asdict(at)
        stop = min(self.rows, at.index + self.batch)
        after = self._cursor(at.epoch, stop) if stop < self.rows else self._cursor(at.epoch + 1, 0)
        return iter([(at.epoch, at.index, stop)] if stop > at.index else ()), asdict(after)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The ranges of a batch that was planned before. One of another topology has none: its epoch starts again anyway."""
        reconciled(Cursor(**start), self.spec, self.allow)
        a, z = Cursor(**start), Cursor(**end)
        if (a.world_size, a.rank, a.num_buckets) != (self.spec.world_size, self.spec.rank, self.spec.num_buckets):
            return iter(())
        stop = z.index if z.epoch == a.epoch else self.rows
        return iter([(a.epoch, a.index, stop)] if stop > a.index else ())


class EpochSource(DataSource):
    """`epoch_ranges`: options world_size, rank, num_buckets, rows (of the rank), epochs, batch_rows, allow_reshard."""

    @classmethod
    def name(cls) -> str:
        return "epoch_ranges"

    def schema(self) -> str:
        return RANGES

    def simpleStreamReader(self, schema) -> EpochReader:
        return EpochReader(self.options)


def write_order(order: DataFrame, path: str) -> None:
    """epoch_order's rows (rank, epoch, index, ...) as a table that ranges are read from."""
    order.repartitionByRange("rank", "epoch", "index").sortWithinPartitions("rank", "epoch", "index").write.mode("overwrite").partitionBy("rank", "epoch").parquet(path)


def follow(spark: SparkSession, path: str, spec: ShardSpec, each: Callable[[DataFrame, int], None], checkpoint: str, batch_rows: int, epochs: int, batches: int | None = None, allow_reshard: bool = False) -> int:
    """Reads the rank's epochs from the order at path, batch by batch, from where the checkpoint stands; each gets (rows, batch_id).

    Ends with the last epoch or after so many batches; a later call goes on there. Returns the batches read.
    """
    order = spark.read.parquet(path).where(F.col("rank") == spec.rank)
    rows = order.where("epoch = 0").count()
    spark.dataSource.register(EpochSource)
    told = {"world_size": spec.world_size, "rank": spec.rank, "num_buckets": spec.num_buckets, "rows": rows, "epochs": epochs, "batch_rows": batch_rows, "allow_reshard": str(allow_reshard).lower()}
    seen = 0

    def hand(ranges: DataFrame, batch_id: int) -> None:
        nonlocal seen
        for r in ranges.collect():  # one range
            seen += 1
            each(order.where((F.col("epoch") == r.epoch) & (F.col("index") >= r.first) & (F.col("index") < r.stop)), batch_id)

    while batches is None or seen < batches:
        before = seen
        stream = spark.readStream.format("epoch_ranges").options(**told).load()
        stream.writeStream.foreachBatch(hand).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if seen == before:
            break
    return seen

"""A near-duplicate index that grows by batches: rows kept under a prefix of their band keys, in runs that are merged by size.

A batch adds one run. A run holds its rows twice: `keys` (key, row_id) in folders by a hash prefix of the key, and `texts`
(row_id, norm, keys, n, marks) in folders by one of row_id, as many folders as keep each at about `fill` rows. A lookup opens the folders that its own
keys fall into, takes the rows that share a key, and reads only the folders of texts in which these lie. When `fan` runs of a level are there
they become one of the next level, so a row is written again as often as the logarithm of the rows says, and a lookup meets that many runs.

Which runs count is said by one small file that is replaced whole, after what it names is written: a batch that fails half way
leaves no trace, and one that runs again finds itself in the index and gives the matches it gave before.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import dedup
from corpusmill.operators.stored import Scratch
from corpusmill.sources import shared

HITS = "row_id long, match_id long, jaccard double, rank int"
_KEYS, _TEXTS = "key long, row_id long, part int", f"{dedup.SKETCH}, part int"


def _folder(value: Column, bits: int) -> Column:
    """The folder of a key: the first bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(value), 64 - bits).cast("int") if bits else F.lit(0)


def _text_key(digest: Column) -> Column:
    """Equal texts meet by a key of their own, beside those of the bands."""
    return F.xxhash64(F.lit(-1), digest)


class BandIndex:
    """Near duplicates among the rows added so far, as in an index of all texts in order of batch and row_id.

    A row whose normalised text is there has one match, the first row with that text, at 1. Any other row has all rows that
    are the first with their text and whose shingles are similar enough, the most similar first. Empty texts match none
    and are not kept; row ids are distinct.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = dedup.THRESHOLD, num_perm: int = dedup.NUM_PERM, bands: int = dedup.BANDS, k: int = dedup.SHINGLE, fill: int = 1 << 16, fan: int = 4):
        if not 0 < threshold <= 1 or num_perm % bands or fill < 1 or fan < 2:
            raise ValueError("need 0 < threshold <= 1, bands that divide num_perm, fill >= 1 and fan >= 2")
        self.spark, self.path, self.threshold, self.num_perm, self.bands, self.k, self.fill, self.fan = spark, path.rstrip("/"), threshold, num_perm, bands, k, fill, fan

    # the file that says what counts

    def _state(self) -> dict:
        told = shared.read_text(self.spark, f"{self.path}/index.json")
        return json.loads(told) if told else {"last": -1, "runs": [], "gone": []}

    def runs(self) -> list[dict]:
        """id, level, rows and bits of each run."""
        return self._state()["runs"]

    def _commit(self, state: dict, runs: list[dict], last: int) -> dict:
        """The new state; what the state before it had left behind is deleted, what this one leaves goes with the next."""
        kept = {r["id"] for r in runs}
        after = {"last": last, "runs": runs, "gone": [r["id"] for r in state["runs"] if r["id"] not in kept]}
        shared.replace_text(self.spark, f"{self.path}/index.json", json.dumps(after))
        for old in state["gone"]:
            shared.delete(self.spark, f"{self.path}/runs/{old}")
        return after

    # runs

    def _bits(self, rows: int) -> int:
        return max(0, math.ceil(math.log2(max(1, rows) * self.bands / self.fill)))

    def _write(self, texts: DataFrame, rows: int, level: int) -> dict:
        """Sketched rows as a run."""
        run = {"id": uuid.uuid4().hex, "level": level, "rows": rows, "bits": self._bits(rows)}
        keys = texts.select(F.explode("keys").alias("key"), "row_id").withColumn("part", _folder(F.col("key"), run["bits"]))
        kept = texts.withColumn("part", _folder(F.col("row_id"), run["bits"]))
        for name, table, order in (("keys", keys, "key"), ("texts", kept, "row_id")):
            table.repartition("part").sortWithinPartitions("part", order).write.partitionBy("part").parquet(f"{self.path}/runs/{run['id']}/{name}")
        return run

    def _read(self, run: dict, name: str) -> DataFrame:
        return self.spark.read.schema(_KEYS if name == "keys" else _TEXTS).parquet(f"{self.path}/runs/{run['id']}/{name}")

    def _opened(self, run: dict, name: str, asked: DataFrame, column: str) -> DataFrame:
        """Rows of a run in the folders that the asked values fall into; the list of folders is no longer than the run has."""
        if not run["bits"]:
            return self._read(run, name)
        parts = [r.part for r in asked.select(_folder(F.col(column), run["bits"]).alias("part")).distinct().collect()]
        return self._read(run, name).where(F.col("part").isin(parts))

    def merge(self) -> None:
        """Runs of a level that are `fan` or more become one of the next level."""
        state = self._state()
        level = 0
        while level <= max((r["level"] for r in state["runs"]), default=-1):
            full = [r for r in state["runs"] if r["level"] == level]
            if len(full) >= self.fan:
                texts = reduce(DataFrame.unionByName, (self._read(r, "texts").drop("part") for r in full))
                merged = self._write(texts, sum(r["rows"] for r in full), level + 1)
                state = self._commit(state, [r for r in state["runs"] if r not in full] + [merged], state["last"])
            level += 1

    # lookups

    def _sketched(self, texts: DataFrame) -> DataFrame:
        """(row_id, norm) -> a sketch with the text's own key before those of its bands, told apart by band."""
        banded = dedup.sketches(texts.select("row_id", "norm"), self.num_perm, self.bands, self.k)
        keys = F.concat(F.array(_text_key(dedup.digest("norm"))), F.transform("keys", lambda x, i: F.xxhash64(i, x)))
        return banded.select("row_id", "norm", keys.alias("keys"), "n", "marks")

    def _known(self, put: Scratch, keys: DataFrame, runs: list[dict]) -> DataFrame:
        """(key) -> key, row_id of the index's rows with such a key. Keys are distinct, so nothing is paired."""
        if not runs:
            return self.spark.createDataFrame([], "key long, row_id long")
        return put(reduce(DataFrame.unionByName, (self._opened(r, "keys", keys, "key").select("key", "row_id").join(keys, "key", "left_semi") for r in runs)))

    def _fetched(self, ids: DataFrame, runs: list[dict]) -> DataFrame:
        """(row_id) -> their sketches."""
        if not runs:
            return self.spark.createDataFrame([], _TEXTS).drop("part")
        return reduce(DataFrame.unionByName, (self._opened(r, "texts", ids, "row_id").drop("part").join(ids, "row_id", "left_semi") for r in runs))

    def _matches(self, put: Scratch, texts: DataFrame, runs: list[dict], among: bool) -> tuple[DataFrame, DataFrame]:
        """Hits (HITS) of rows (row_id, text) in the runs and, with among, in their own earlier rows; and the sketches of the new texts."""
        norm = text.normalized_all(F.col("text"))
        # empty texts go after the write: a filter before it makes each normal form twice
        rows = put(texts.select(F.col("row_id").cast("long").alias("row_id"), norm.alias("norm")).withColumn("digest", dedup.digest("norm"))).where("norm <> ''")
        keyed = rows.select("row_id", "digest", _text_key(F.col("digest")).alias("key"))
        there = self._known(put, keyed.select("key").distinct(), runs).groupBy("key").agg(F.min("row_id").alias("match_id"))
        firsts = keyed.groupBy("digest").agg(F.min("row_id").alias("first_id"))
        told = put(keyed.join(there, "key", "left").join(firsts, "digest").select("row_id", "digest", "first_id", "match_id"))
        known = told.where("match_id is not null")
        if among:
            known = known.unionByName(told.where("match_id is null and row_id > first_id").withColumn("match_id", F.col("first_id")))
        exact = known.select("row_id", "match_id", F.lit(1.0).alias("jaccard"), F.lit(1).alias("rank"))
        # equal new texts are asked once; of those that are not added every row gets the hits of the first
        asked = told.where("match_id is null and row_id = first_id").select("row_id")
        fresh = put(self._sketched(rows.join(asked, "row_id", "left_semi")))
        bare = lambda t: t.withColumn("keys", F.slice("keys", 2, self.bands))
        near = None if among else fresh.limit(0)  # without a right table rows would be compared with each other
        if runs:
            keys = put(fresh.select(F.explode(F.slice("keys", 2, self.bands)).alias("key")).distinct())
            near = bare(put(self._fetched(put(self._known(put, keys, runs).select("row_id").distinct()), runs)))
        hits = dedup.similar(bare(fresh), near, self.threshold, self.k, keep=put, both=among, written=True)
        ranked = dedup.ranked_hits(hits).select("left_id", F.col("right_id").alias("match_id"), "jaccard", "rank")
        if not among:
            ranked = ranked.join(told.where("match_id is null").select("row_id", F.col("first_id").alias("left_id")), "left_id").drop("left_id")
        else:
            ranked = ranked.withColumnRenamed("left_id", "row_id")
        return exact.unionByName(ranked.select(*exact.columns)), fresh

    def add(self, texts: DataFrame, batch_id: int) -> DataFrame:
        """(row_id, text) -> row_id, match_id, jaccard, rank among all rows before; then the rows are in the index.

        Batches come in order of their ids. One that is in the index already is not added again.
        """
        state, place = self._state(), f"{self.path}/hits/{batch_id}"
        if batch_id > state["last"]:
            with Scratch(self.spark) as put:
                hits, fresh = self._matches(put, texts, state["runs"], among=True)
                hits.write.mode("overwrite").parquet(place)
                rows = fresh.count()
                run = [self._write(fresh, rows, 0)] if rows else []
            self._commit(state, state["runs"] + run, batch_id)
            self.merge()
            for old in shared.names(self.spark, f"{self.path}/hits"):
                if old != str(batch_id):
                    shared.delete(self.spark, f"{self.path}/hits/{old}")
        elif not shared.exists(self.spark, place):
            raise ValueError(f"batch {batch_id} was added before batch {state['last']}; its hits are gone")
        return self.spark.read.schema(HITS).parquet(place)

    def query(self, texts: DataFrame, sink: Callable[[DataFrame], None]) -> None:
        """Hands the hits of rows (row_id, text) among all rows of the index to the sink; the index stays as it is."""
        with Scratch(self.spark) as put:
            sink(self._matches(put, texts, self.runs(), among=False)[0])

    def each(self, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that adds batches and hands their hits to the sink."""
        return lambda batch, batch_id: sink(self.add(batch, batch_id), batch_id)

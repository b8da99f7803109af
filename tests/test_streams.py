"""Streams against the batch operators: guards with state, cursors, sinks that replace."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusmill.operators import guards, sharding
from corpusmill.sources import files, shared
from corpusmill.streaming import epochs, guarded, incremental

SERIES = "run string, step long, loss double, grad_norm double"


def made(seed, runs=12, steps=70):
    rng = random.Random(seed)
    out = []
    for r in range(runs):
        for step in range(1, steps + 1):
            loss = rng.choice([1.0, 2.0, None, 1.5, 0.0 if r % 3 == 0 and step > 40 else 1.2, 9.0 if r % 4 == 1 else 1.1])
            out.append((f"r{r}", step, float("nan") if r == 5 and step == 30 else loss, 2000.0 if r == 7 and step == 21 else 1.0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_into_batches_gives_the_decisions_of_the_batch_operator(spark, tmp_path, seed):
    rng = random.Random(seed)
    guard = guards.Guard(window=6, min_steps=12, history=24, zero_patience=3, spike_patience=2)
    rows = made(seed)
    want = sorted(map(tuple, guards.first_trip(spark.createDataFrame(rows, SERIES), guard).collect()))
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for part in [*parts[:2], parts[0], *parts[2:]]:  # one comes again
        spark.createDataFrame(part, SERIES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SERIES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    incremental.run_available(guarded.guarded(stream, guard), lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "ck"))
    assert sorted(got) == want and want


def test_one_pass_gives_the_first_of_all_guards(spark):
    guard = guards.Guard(window=6, min_steps=12, history=24, zero_patience=3, spike_patience=2)
    series = spark.createDataFrame(made(9), SERIES)
    trips = guards.number_guard(series, guard).where("reason is not null").select("run", "step", "reason", F.lit(0).alias("rank"))
    finite = series.withColumn("loss", F.when(F.isnan("loss"), None).otherwise(F.col("loss")))
    for rank, (reason, found) in enumerate((("zero_loss", guards.zero_loss), ("loss_spike", guards.loss_spike), ("divergence", guards.divergence)), 1):
        trips = trips.unionByName(found(finite, guard).where("tripped").select("run", "step", F.lit(reason).alias("reason"), F.lit(rank).alias("rank")))
    firsts = trips.groupBy("run").agg(F.min(F.struct("step", "rank", "reason")).alias("t")).select("run", "t.step", "t.reason")
    assert sorted(map(tuple, firsts.collect())) == sorted(map(tuple, guards.first_trip(series, guard).collect()))


def test_a_cursor_stream_reads_each_row_of_each_epoch_once(spark, tmp_path):
    spec = sharding.ShardSpec(2, 1, num_buckets=16)
    rows = spark.range(90).withColumnRenamed("id", "key")
    epochs.write_order(sharding.epoch_order(rows, "key", spec, epochs=2), str(tmp_path / "order"))
    got = []
    each = lambda df, _: got.append([tuple(r) for r in df.select("epoch", "index", "key").orderBy("epoch", "index").collect()])
    follow = lambda s, n=None, **o: epochs.follow(spark, str(tmp_path / "order"), s, each, str(tmp_path / "ck"), 17, 2, n, **o)
    assert follow(spec, 2) == 2
    follow(spec)
    assert follow(spec) == 0
    seen = [r for batch in got for r in batch]
    want = [tuple(r) for r in sharding.epoch_order(rows, "key", spec, epochs=2).where("rank = 1").select("epoch", "index", "key").collect()]
    assert seen == sorted(want) and max(map(len, got)) == 17


def test_a_changed_world_is_refused_or_restarts_the_epoch():
    told = {"world_size": "2", "rank": "0", "num_buckets": "16", "rows": "10", "epochs": "2", "batch_rows": "4"}
    reader = epochs.EpochReader(told)
    ranges, at = reader.read(reader.initialOffset())
    assert list(ranges) == [(0, 0, 4)] and at["index"] == 4
    other = {**told, "world_size": "3"}
    with pytest.raises(sharding.ReshardError):
        epochs.EpochReader(other).read(at)
    allowed = epochs.EpochReader({**other, "allow_reshard": "true"})
    assert list(allowed.readBetweenOffsets(reader.initialOffset(), at)) == []
    ranges, after = allowed.read({**at, "epoch": 1})
    assert list(ranges) == [(1, 0, 4)] and (after["world_size"], after["index"]) == (3, 4)
    assert list(reader.readBetweenOffsets({**at, "index": 8}, {**at, "epoch": 1, "index": 0})) == [(0, 8, 10)]


def test_a_batch_that_runs_again_replaces_its_metrics(spark, tmp_path):
    sink = files.chosen_sink(run_dir=str(tmp_path))
    for batch, rows in ((6, [(1, 0.5)]), (7, [(2, 0.4), (3, None)]), (7, [(2, 0.4), (3, None)])):
        sink(spark.createDataFrame(rows, "step long, loss double"), batch)
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "metrics")).select("step", "loss").collect())) == [(1, 0.5), (2, 0.4), (3, None)]


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "a" / "x.json")
    assert shared.read_text(spark, path) is None and shared.size(spark, path) == 0
    for text in ("one", "zwei ä"):
        shared.replace_text(spark, path, text)
        assert shared.read_text(spark, path) == text
    assert [n for n in shared.names(spark, str(tmp_path / "a")) if not n.startswith(".")] == ["x.json"]
    assert shared.delete(spark, str(tmp_path / "a")) and not shared.exists(spark, path)


class Counted:
    """A state store in memory that counts the accesses to it."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.map.pop(key, None)

    def clear(self):
        self.calls += 1
        self.map.clear()


@pytest.mark.parametrize("seed, steps, batches", [(1, 60, 4), (2, 60, 4), (3, 1400, 4), (4, 1400, 9), (5, 1400, 40), (6, 513, 300)])
def test_rows_that_wait_cost_the_state_an_access_a_chunk(seed, steps, batches):
    rng = random.Random(seed)
    guard = guards.Guard(window=6, min_steps=12, history=24, divergence_factor=3.0)
    rows = [Row(run="r", step=i, loss=rng.choice([1.0, 1.5, None, 2.0]), grad_norm=rng.choice([None, 1.0])) for i in range(1, steps + 1)]
    if seed % 2:  # a run that trips
        rows[-40] = Row(run="r", step=rows[-40].step, loss=float("inf"), grad_norm=1.0)
    watch = guards.Watch(guard)
    want = next(((r.step, reason) for r in rows if (reason := watch.see(r.loss, r.grad_norm))), None)
    mixed = rng.sample(rows, len(rows)) + rng.sample(rows, 20)
    store, processor, got = Counted(), guarded.GuardProcessor(guard, 1), []
    processor.init(store)
    for part in [mixed[i::batches] for i in range(batches)]:
        got += [(r.step, r.reason) for r in processor.handleInputRows(("r",), iter(part), None)]
    assert got == ([want] if want else []) and bool(want) == bool(seed % 2)
    assert store.map == {} and store.calls <= batches * (2 + 2 * (steps // guarded.CHUNK + 1))

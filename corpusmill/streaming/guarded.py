"""Guards with state on a stream: each run's losses are watched as they come, and its first trip ends it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators.guards import Guard, Watch

#: The rows of up to CHUNK consecutive steps that wait, as one value.
CHUNK = 256
WAITING = "steps array<long>, waiting_losses array<double>, waiting_norms array<double>"
STATE = f"next long, over boolean, losses array<double>, seen long, zeros int, spikes int, later boolean, {WAITING}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GuardProcessor(StatefulProcessor):
    """One run: what its watch remembers, and rows that came before their turn.

    A run's steps are consecutive from `first` on. A step is judged when all before it were, so the order in which rows arrive, and
    where batches are cut, changes nothing; a step that comes again is ignored. Rows wait in chunks of steps, as each access to the
    state is a message to the JVM: those of the chunk whose turn it is beside the watch, those of later chunks in a map.
    """

    def __init__(self, guard: Guard, first: int):
        self.guard, self.first = guard, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("watch", STATE)
        self.waiting = handle.getMapState("waiting", "chunk long", WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        known = self.state.get()
        turn, over, later, watch, near = self.first, False, False, Watch(self.guard), {}
        if known is not None:
            turn, over, losses, seen, zeros, spikes, later, *kept = known
            watch.recall(losses, seen, zeros, spikes)
            near = _rows(kept)
        if over:
            return
        early: dict[int, dict[int, tuple]] = {}
        for r in rows:
            if r.step >= turn:
                early.setdefault(r.step // CHUNK, {}).setdefault(r.step, (r.loss, r.grad_norm))
        at, trip = turn // CHUNK, None
        near = early.pop(at, {}) | near
        while trip is None and turn in near:
            trip = watch.see(*near.pop(turn))
            turn += 1
            if trip is None and turn // CHUNK > at:
                at = turn // CHUNK
                near = early.pop(at, {}) | (self._taken(at) if later else {})
        if trip:
            if later:
                self.waiting.clear()
            self.state.update((turn, True, [], 0, 0, 0, False, [], [], []))
            yield Row(run=key[0], step=turn - 1, reason=trip)
            return
        for chunk, found in early.items():
            old = _rows(self.waiting.getValue((chunk,))) if later else {}
            if not found.keys() <= old.keys():
                self.waiting.updateValue((chunk,), _columns(found | old))
        self.state.update((turn, False, *watch.memory(), later or bool(early), *_columns(near)))

    def _taken(self, chunk: int) -> dict[int, tuple]:
        found = _rows(self.waiting.getValue((chunk,)))
        if found:
            self.waiting.removeKey((chunk,))
        return found

    def close(self) -> None:
        pass


def _rows(columns: Sequence[list] | None) -> dict[int, tuple]:
    """WAITING as step -> (loss, grad_norm)."""
    return {step: values for step, *values in zip(*columns)} if columns else {}


def _columns(rows: dict[int, tuple]) -> tuple[list, list, list]:
    return list(rows), [loss for loss, _ in rows.values()], [norm for _, norm in rows.values()]


def guarded(series: DataFrame, guard: Guard = Guard(), first: int = 1) -> DataFrame:
    """A stream of (run, step, loss, grad_norm) -> run, step, reason of each run's first trip, as guards.first_trip gives it for the whole series.

    Steps of a run are consecutive from `first` on. State by run is a ring of losses, streaks and the rows that wait for their
    turn, kept in RocksDB; a run that has tripped keeps a flag.
    """
    series.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = series.schema["run"].dataType.simpleString()
    rows = series.select("run", F.col("step").cast("long").alias("step"), F.col("loss").cast("double").alias("loss"), F.col("grad_norm").cast("double").alias("grad_norm"))
    return rows.groupBy("run").transformWithState(GuardProcessor(guard, first), f"run {kind}, step long, reason string", "Append", "None")

"""Guards over metric series: (run, step, loss, grad_norm) -> decisions. A run is an ordered series, gone through by one task."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.folds import walked


@dataclass(frozen=True)
class Guard:
    window: int = 20
    spike_factor: float = 5.0
    spike_patience: int = 3
    max_grad_norm: float | None = 1e3
    divergence_factor: float = 1.5
    min_steps: int = 20
    zero_patience: int = 5
    history: int = 512


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def number_guard(series: DataFrame, g: Guard = Guard()) -> DataFrame:
    """reason: non_finite_loss, non_finite_grad, grad_explosion or null, in this order of precedence."""
    explode = (F.col("grad_norm") > g.max_grad_norm) if g.max_grad_norm is not None else F.lit(False)
    reason = F.when(F.col("loss").isNotNull() & ~is_finite(F.col("loss")), "non_finite_loss").when(F.col("grad_norm").isNotNull() & ~is_finite(F.col("grad_norm")), "non_finite_grad").when(explode, "grad_explosion")
    return series.withColumn("reason", reason)


def _told(series: DataFrame) -> DataFrame:
    """The rows that the loss guards see: those with a loss."""
    return series.where(F.col("loss").isNotNull())


def _streak(rows: DataFrame, flag: Column, breaks: Column) -> DataFrame:
    """streak: how many rows with the flag since the last one that breaks; other rows leave it as it is."""
    by = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = rows.withColumn("__island", F.sum(breaks.cast("long")).over(by)).withColumn("__flag", flag.cast("long"))
    within = Window.partitionBy("run", "__island").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return island.withColumn("streak", F.sum("__flag").over(within)).drop("__island", "__flag")


def zero_loss(series: DataFrame, g: Guard = Guard()) -> DataFrame:
    """run, step, streak of losses that are exactly 0, tripped at the patience."""
    zero = F.col("loss") == 0.0
    return _streak(_told(series), zero, ~zero).select("run", "step", "streak", (F.col("streak") >= g.zero_patience).alias("tripped"))


def loss_spike(series: DataFrame, g: Guard = Guard()) -> DataFrame:
    """run, step, base (median of up to `window` losses before), spike, streak, tripped."""
    before = Window.partitionBy("run").orderBy("step").rowsBetween(-g.window, -1)
    rows = _told(series).withColumn("base", F.percentile("loss", F.lit(0.5)).over(before)).withColumn("__n", F.count("loss").over(before))
    judged = F.col("__n") >= max(3, g.window // 4)
    spike = judged & (F.col("base") > 0) & (F.col("loss") > g.spike_factor * F.col("base"))
    out = _streak(rows.withColumn("spike", F.coalesce(spike, F.lit(False))), F.col("spike"), judged & ~F.col("spike"))
    return out.select("run", "step", F.when(F.col("__n") >= max(3, g.window // 4), F.col("base")).alias("base"), "spike", "streak", (F.col("streak") >= g.spike_patience).alias("tripped"))


def divergence(series: DataFrame, g: Guard = Guard()) -> DataFrame:
    """run, step, early and late (medians of the first and last window of the history), tripped; null medians before there is enough."""
    by = Window.partitionBy("run").orderBy("step")
    rows = _told(series).withColumn("__k", F.row_number().over(by))
    first = F.percentile(F.when(F.col("__k") <= g.window, F.col("loss")), F.lit(0.5)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slid = F.percentile("loss", F.lit(0.5)).over(by.rowsBetween(1 - g.history, g.window - g.history))
    late = F.percentile("loss", F.lit(0.5)).over(by.rowsBetween(1 - g.window, 0))
    rows = rows.withColumns({"early": F.when(F.col("__k") <= g.history, first).otherwise(slid), "late": late})
    enough = F.col("__k") >= max(g.min_steps, 2 * g.window)
    return rows.select("run", "step", F.when(enough, F.col("early")).alias("early"), F.when(enough, F.col("late")).alias("late"), F.coalesce(enough & (F.col("early") > 0) & (F.col("late") > g.divergence_factor * F.col("early")), F.lit(False)).alias("tripped"))


class Watch:
    """All guards over one run, a step at a time. It remembers `history` losses and two streaks."""

    def __init__(self, guard: Guard = Guard()):
        self.guard, self.seen, self.zeros, self.spikes = guard, 0, 0, 0
        self.losses: deque[float] = deque(maxlen=max(guard.history, guard.window))

    def memory(self) -> tuple[list[float], int, int, int]:
        return list(self.losses), self.seen, self.zeros, self.spikes

    def recall(self, losses: list[float], seen: int, zeros: int, spikes: int) -> None:
        self.losses.extend(losses)
        self.seen, self.zeros, self.spikes = seen, zeros, spikes

    def see(self, loss: float | None, grad_norm: float | None) -> str | None:
        """The reason to halt at this step, or None; of several the one that is asked first."""
        g = self.guard
        if loss is not None and not math.isfinite(loss):
            return "non_finite_loss"
        if grad_norm is not None and not math.isfinite(grad_norm):
            return "non_finite_grad"
        if grad_norm is not None and g.max_grad_norm is not None and grad_norm > g.max_grad_norm:
            return "grad_explosion"
        if loss is None:
            return None
        self.zeros = self.zeros + 1 if loss == 0.0 else 0
        before = self._last(g.window)
        if len(before) >= max(3, g.window // 4):
            base = median(before)
            self.spikes = self.spikes + 1 if base > 0 and loss > g.spike_factor * base else 0
        self.losses.append(loss)
        self.seen += 1
        if self.zeros >= g.zero_patience:
            return "zero_loss"
        if self.spikes >= g.spike_patience:
            return "loss_spike"
        if self.seen >= max(g.min_steps, 2 * g.window):
            kept = min(len(self.losses), g.history)
            early = median(islice(self.losses, len(self.losses) - kept, len(self.losses) - kept + g.window))
            if early > 0 and median(self._last(g.window)) > g.divergence_factor * early:
                return "divergence"
        return None

    def _last(self, n: int) -> list[float]:
        return list(islice(self.losses, max(0, len(self.losses) - n), None))


def first_trip(series: DataFrame, g: Guard = Guard()) -> DataFrame:
    """run, step, reason of the first decision to halt: one pass over each run in order of step, which ends where it trips."""

    def watch(ordered: Iterator[tuple]) -> Iterator[tuple]:
        own = Watch(g)
        for _, step, loss, grad_norm in ordered:
            reason = own.see(loss, grad_norm)
            if reason:
                yield step, reason
                return

    kind = series.schema["run"].dataType.simpleString()
    rows = series.select("run", F.col("step").cast("long").alias("step"), F.col("loss").cast("double").alias("loss"), F.col("grad_norm").cast("double").alias("grad_norm"))
    return walked(rows, ["run"], ["step"], watch, f"run {kind}, step long, reason string")


def until_trip(series: DataFrame, g: Guard = Guard()) -> DataFrame:
    """The rows of each run up to and with the one that trips."""
    trips = first_trip(series, g).select(F.col("run").alias("__run"), F.col("step").alias("__stop"))
    return series.join(trips, F.col("run") == F.col("__run"), "left").where("__stop is null or step <= __stop").drop("__run", "__stop")


def early_stopping(series: DataFrame, patience: int = 3, min_delta: float = 0.0, mode: str = "min") -> DataFrame:
    """(run, step, value) -> run, best, best_step, stop_step, reason: one pass over each run, as an improvement depends on the best so far.

    A value that is not finite stops with non_finite_eval; more than `patience` bad values in a row with early_stop.
    """
    if mode not in ("min", "max") or patience < 0 or min_delta < 0:
        raise ValueError("mode is min or max; patience and min_delta are not negative")
    sign = 1.0 if mode == "min" else -1.0

    def follow(ordered: Iterator[tuple]) -> Iterator[tuple]:
        best, best_step, bad = None, None, 0
        for _, step, value in ordered:
            if not math.isfinite(value):
                yield best, best_step, step, "non_finite_eval"
                return
            if best is None or sign * value < sign * best - min_delta:
                best, best_step, bad = value, step, 0
                continue
            bad += 1
            if bad > patience:
                yield best, best_step, step, "early_stop"
                return
        yield best, best_step, None, None

    kind = series.schema["run"].dataType.simpleString()
    rows = series.where("value is not null").select("run", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    return walked(rows, ["run"], ["step"], follow, f"run {kind}, best double, best_step long, stop_step long, reason string")

"""Bookkeeping of runs: budgets, checkpoint retention, job records, metric tails, retries, rate limits, breakers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.folds import walked

LIMITS = (("cost_usd", "max_cost_usd"), ("tokens", "max_tokens"), ("steps", "max_steps"))


@dataclass(frozen=True)
class Budget:
    max_cost_usd: float | None = None
    max_tokens: int | None = None
    max_steps: int | None = None
    warn_at: float = 0.8

    def __post_init__(self):
        if any(v is not None and v <= 0 for v in (self.max_cost_usd, self.max_tokens, self.max_steps)) or not 0 < self.warn_at <= 1:
            raise ValueError("limits are positive and warn_at lies in (0, 1]")

    def limits(self) -> list[tuple[str, float]]:
        return [(name, getattr(self, field)) for name, field in LIMITS if getattr(self, field) is not None]

    def would_exceed(self, used: dict[str, float], delta: dict[str, float]) -> str | None:
        """The first limit that the usage would exceed after delta."""
        return next((n for n, limit in self.limits() if used.get(n, 0) + delta.get(n, 0) > limit), None)


def running_usage(usage: DataFrame, budget: Budget) -> DataFrame:
    """(run, step, train_tokens, sample_tokens, steps, cost_usd) -> running sums, breached (the first limit exceeded) and warned (limits at warn_at for the first time)."""
    by = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = usage.withColumns({"used_tokens": F.sum(F.col("train_tokens") + F.col("sample_tokens")).over(by), "used_steps": F.sum("steps").over(by), "used_cost_usd": F.sum("cost_usd").over(by)})
    breached, warned = F.lit(None).cast("string"), []
    for name, limit in reversed(budget.limits()):
        breached = F.when(F.col(f"used_{name}") > limit, name).otherwise(breached)
    for name, limit in budget.limits():
        now = F.col(f"used_{name}") >= budget.warn_at * limit
        own = F.col(name) if name != "tokens" else F.col("train_tokens") + F.col("sample_tokens")
        warned.append(F.when(now & ~(F.col(f"used_{name}") - own >= budget.warn_at * limit), name))
    return rows.select("run", "step", "used_tokens", "used_steps", "used_cost_usd", breached.alias("breached"), F.concat_ws("+", *warned).alias("warned"))


def first_breach(usage: DataFrame, budget: Budget) -> DataFrame:
    """run, step, breached of the first row over a limit; its usage counts."""
    return running_usage(usage, budget).where("breached is not null").groupBy("run").agg(F.min(F.struct("step", "breached", "used_tokens")).alias("b")).select("run", "b.*")


def remaining(totals: DataFrame, budget: Budget) -> DataFrame:
    """(tokens, steps, cost_usd) totals -> what is left of each limit, not below 0, and the largest fraction used."""
    left = [F.greatest(F.lit(0.0), F.lit(float(limit)) - F.col(name)).alias(f"left_{name}") for name, limit in budget.limits()]
    used = [F.col(name) / float(limit) for name, limit in budget.limits()]
    return totals.select("*", *left, (F.greatest(*used) if len(used) > 1 else used[0] if used else F.lit(0.0)).alias("fraction_used"))


@dataclass(frozen=True)
class Retention:
    keep_last: int = 3
    keep_best: int = 1
    keep_every: int = 0
    mode: str = "min"
    min_age_steps: int = 0
    protect_final: bool = True

    def __post_init__(self):
        if min(self.keep_last, self.keep_best, self.keep_every, self.min_age_steps) < 0 or self.mode not in ("min", "max"):
            raise ValueError("counts are not negative and mode is min or max")
        if not (self.keep_last or self.keep_best or self.keep_every or self.min_age_steps or self.protect_final):
            raise ValueError("a policy that keeps nothing is refused")


def last_writes(entries: DataFrame) -> DataFrame:
    """(run, step, seq, ...) -> of several entries of a step the one written last."""
    return entries.withColumn("__k", F.row_number().over(Window.partitionBy("run", "step").orderBy(F.desc("seq")))).where("__k = 1").drop("__k")


def retention_plan(entries: DataFrame, policy: Retention = Retention(), exists: str | None = None) -> DataFrame:
    """(run, step, metric[, exists]) -> run, step, action (keep, delete, missing) and reasons: final, last, best, every, young, joined by +."""
    newest = Window.partitionBy("run").orderBy(F.desc("step"))
    value = F.col("metric") if policy.mode == "min" else -F.col("metric")
    usable = F.col("metric").isNotNull() & ~F.isnan("metric") & (F.abs("metric") < float("inf"))
    ranked = entries.withColumns({
        "__new": F.row_number().over(newest), "__latest": F.max("step").over(Window.partitionBy("run")),
        "__best": F.when(usable, F.row_number().over(Window.partitionBy("run").orderBy(F.when(usable, value).asc_nulls_last(), F.desc("step")))),
    })
    reasons = F.array_compact(F.array(
        F.when(F.lit(policy.protect_final) & (F.col("__new") == 1), "final"), F.when(F.col("__new") <= policy.keep_last, "last"), F.when(F.col("__best") <= policy.keep_best, "best"),
        F.when(F.col("step") % policy.keep_every == 0, "every") if policy.keep_every else F.lit(None).cast("string"), F.when(F.col("__latest") - F.col("step") < policy.min_age_steps, "young"),
    ))
    action = F.when(F.size(reasons) > 0, "keep").otherwise("delete")
    if exists:
        action = F.when(~F.col(exists), "missing").otherwise(action)
    return ranked.select("run", "step", action.alias("action"), F.array_join(reasons, "+").alias("reasons"))


def retention_summary(plan: DataFrame) -> DataFrame:
    """(run, step, action, reasons) -> run, summary: steps kept with their reasons, deleted and missing, in order."""
    listed = lambda action, text: F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("action") == action, F.struct("step", "reasons")))), text), ", "), F.lit("")), F.lit("-"))
    step = lambda e: e["step"].cast("string")
    return plan.groupBy("run").agg(F.concat(
        F.lit("keep "), listed("keep", lambda e: F.concat(step(e), F.lit(" ("), e["reasons"], F.lit(")"))), F.lit("; delete "), listed("delete", step), F.lit("; missing "), listed("missing", step),
    ).alias("summary"))


def bytes_freed(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """(run, step, action) and (run, step, bytes) -> run, bytes that deleting frees; unknown sizes count 0."""
    gone = plan.where("action = 'delete'").join(sizes, ["run", "step"], "left")
    return gone.groupBy("run").agg(F.sum(F.coalesce("bytes", F.lit(0))).cast("long").alias("bytes"))


def submit(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The jobs with new ones, pending; of rows with one id the new one holds."""
    kept = jobs.join(new.select("id"), "id", "left_anti")
    return kept.unionByName(new.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def latest_checkpoint(entries: DataFrame) -> DataFrame:
    """The entry written last, whatever its step."""
    return entries.groupBy("run").agg(F.max_by(F.struct("step", "path"), "seq").alias("e")).select("run", "e.*")


def list_jobs(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest jobs; a top-k, not a sort of all."""
    return (jobs.where(F.col("status") == status) if status else jobs).orderBy(F.desc("created_at"), "id").limit(limit)


def reconcile(jobs: DataFrame) -> DataFrame:
    """After a restart: running jobs have failed."""
    hit = F.col("status") == "running"
    return jobs.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "error": F.when(hit, "Interrupted by process restart.").otherwise(F.col("error"))})


def utc_now() -> Column:
    """The time of the query in UTC, as records have it."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


TERMINAL = ("succeeded", "failed", "cancelled")


def mark(jobs: DataFrame, job_id: str, status: str, now: Column) -> DataFrame:
    """A job's new status: started_at is set once, finished_at with a terminal status; others stay."""
    hit = F.col("id") == job_id
    return jobs.withColumns({
        "status": F.when(hit, status).otherwise(F.col("status")),
        "started_at": F.when(hit & F.col("started_at").isNull() & F.lit(status == "running"), now).otherwise(F.col("started_at")),
        "finished_at": F.when(hit & F.lit(status in TERMINAL), now).otherwise(F.col("finished_at")),
    })


def cancel(jobs: DataFrame, job_id: str) -> DataFrame:
    """Pending and running jobs become cancelled; finished ones stay."""
    return jobs.withColumn("status", F.when((F.col("id") == job_id) & ~F.col("status").isin(*TERMINAL), "cancelled").otherwise(F.col("status")))


def metrics_tail(series: DataFrame, n: int = 0) -> DataFrame:
    """The last n rows of each run; 0: all."""
    if not n:
        return series
    return series.withColumn("__k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("step")))).where(F.col("__k") <= n).drop("__k")


def progress(step: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), step / total)).otherwise(0.0)


#: HTTP statuses that are worth another try, and phrases of errors that have none.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
RETRYABLE_PHRASES = (
    "timeout", "timed out", "connection reset", "connection aborted", "temporarily unavailable", "too many requests",
    "service unavailable", "broken pipe", "econnreset", "rate limit",
)


def is_retryable(status: Column, message: Column | None = None) -> Column:
    """Whether a status is worth another try; without a status, whether the message has one of the phrases."""
    told = F.coalesce(F.lower(message).rlike("|".join(RETRYABLE_PHRASES)), F.lit(False)) if message is not None else F.lit(False)
    return F.when(status.isNull(), told).otherwise(status.isin(*RETRYABLE))


def retry_after(headers: Column) -> Column:
    """Seconds of a Retry-After header (map<string, string>, the name in any case); null if it is missing or no number."""
    own = F.map_filter(headers, lambda k, v: F.lower(k) == "retry-after")
    seconds = F.get(F.map_values(own), 0).try_cast("double")
    return F.when((seconds >= 0) & ~F.isnan(seconds), seconds)


def backoff(attempt: Column, base: float = 0.5, multiplier: float = 2.0, longest: float = 30.0, hint: Column | None = None, jitter: Column | None = None) -> Column:
    """Seconds before another try; a jitter in [0, 1) scales them; a server's hint may lengthen them up to the longest."""
    if base < 0 or longest < 0 or multiplier < 1:
        raise ValueError("delays are not negative and the multiplier is 1 or more")
    delay = F.least(F.lit(base) * F.pow(F.lit(multiplier), attempt - 1), F.lit(longest))
    delay = delay if jitter is None else delay * jitter
    return delay if hint is None else F.greatest(delay, F.coalesce(F.least(hint, F.lit(longest)), F.lit(0.0)))


def token_bucket(requests: DataFrame, rate: float, capacity: float | None = None) -> DataFrame:
    """(key, at seconds, amount) -> key, at, granted, tokens after: a lazily refilled bucket for each key, folded in order of time."""
    cap = float(rate if capacity is None else capacity)

    def granted(ordered: Iterator[tuple]) -> Iterator[tuple]:
        tokens, last = cap, None
        for _, at, amount in ordered:
            tokens = min(cap, tokens + max(0.0, at - (at if last is None else last)) * rate)
            ok = tokens >= amount
            tokens, last = tokens - amount if ok else tokens, at
            yield at, ok, tokens

    rows = requests.select("key", F.col("at").cast("double").alias("at"), F.col("amount").cast("double").alias("amount"))
    return walked(rows, ["key"], ["at", "amount"], granted, f"key {requests.schema['key'].dataType.simpleString()}, at double, granted boolean, tokens double")


def circuit_breaker(calls: DataFrame, failures: int = 5, recovery: float = 30.0, successes: int = 1, probes: int = 1) -> DataFrame:
    """(key, at seconds, ok) -> key, at, state before the call, rejected: closed opens after `failures` failures in a row;
    after `recovery` it is half open for at most `probes` calls; `successes` of them close it, a failure opens it again."""

    def states(ordered: Iterator[tuple]) -> Iterator[tuple]:
        state, bad, good, tried, opened = "closed", 0, 0, 0, 0.0
        for _, at, ok in ordered:
            if state == "open" and at - opened >= recovery:
                state, good, tried = "half_open", 0, 0
            rejected = state == "open" or state == "half_open" and tried >= probes
            yield at, state, rejected
            if rejected:
                continue
            tried += state == "half_open"
            if not ok:
                bad += 1
                if state == "half_open" or bad >= failures:
                    state, opened = "open", at
            elif state == "closed":
                bad = 0
            else:
                good += 1
                if good >= successes:
                    state, bad = "closed", 0

    rows = calls.select("key", F.col("at").cast("double").alias("at"), "ok")
    return walked(rows, ["key"], ["at", "ok"], states, f"key {calls.schema['key'].dataType.simpleString()}, at double, state string, rejected boolean")

"""Queries over series and records: guards on events, budgets on events, retention on orders, jobs on orders."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import guards, runs
from corpusmill.operators.stored import Scratch, shared_dir, stored
from corpusmill.plans.catalog import query
from corpusmill.plans.views import table
from corpusmill.sources import checkpoints, files, shared
from corpusmill.streaming import guarded, incremental

_SERIES = """series as (select user_id as run, row_number() over (partition by user_id order by ts, event_id)::bigint as step, event_id,
    case when event_id % 101 = 0 then null when event_id % 197 = 0 then 'nan'::double when user_id % 5 = 0 and (event_id // 40) % 3 = 0 then 0.0
        when event_id % 13 < 2 then value * 12 else value + row_number() over (partition by user_id order by ts, event_id) end as loss,
    case when event_id % 211 = 0 then 'inf'::double else value * 2.5 end as grad_norm from events)"""


def series(spark, sf_dir):
    """Events as metric series of runs, with planted nulls, NaNs, zeros, spikes and a trend."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), step.alias("step"), "event_id", "value")
    zero = (F.col("run") % 5 == 0) & (F.floor(e / 40) % 3 == 0)
    loss = F.when(e % 101 == 0, F.lit(None)).when(e % 197 == 0, F.lit(float("nan"))).when(zero, 0.0).when(e % 13 < 2, F.col("value") * 12).otherwise(F.col("value") + F.col("step"))
    return rows.select("run", "step", "event_id", loss.alias("loss"), F.when(e % 211 == 0, F.lit(float("inf"))).otherwise(F.col("value") * 2.5).alias("grad_norm"))


def _finite(spark, sf_dir):
    return series(spark, sf_dir).withColumn("loss", F.when(F.isnan("loss"), None).otherwise(F.col("loss")))


_FINITE = f"{_SERIES}, fin as (select run, step, grad_norm, case when isnan(loss) then null else loss end as loss from series), told as (select * from fin where loss is not null)"
_NUMBERS = "case when loss is not null and not isfinite(loss) then 'non_finite_loss' when not isfinite(grad_norm) then 'non_finite_grad' when grad_norm > 600 then 'grad_explosion' end"
_GUARD = guards.Guard(max_grad_norm=600.0)


@query(f"with {_SERIES}, r as (select run, step, {_NUMBERS} as reason from series) select * from r where reason is not null")
def guard_numbers(spark, sf_dir):
    return guards.number_guard(series(spark, sf_dir), _GUARD).where("reason is not null").select("run", "step", "reason")


_ZERO = "zisl as (select *, sum((loss <> 0)::int) over (partition by run order by step) as island from told), zero as (select run, step, (sum((loss = 0)::int) over (partition by run, island order by step))::bigint as streak from zisl)"


@query(f"with {_FINITE}, {_ZERO} select *, streak >= 5 as tripped from zero")
def guard_zero_loss(spark, sf_dir):
    return guards.zero_loss(_finite(spark, sf_dir), _GUARD)


_SPIKE = """b as (select *, quantile_cont(loss, 0.5) over w as m, count(loss) over w as n from told window w as (partition by run order by step rows between 20 preceding and 1 preceding)),
    s as (select *, n >= 5 and m > 0 and loss > 5 * m as spike from b), sisl as (select *, sum((n >= 5 and not spike)::int) over (partition by run order by step) as island from s),
    spikes as (select run, step, case when n >= 5 then m end as base, spike, (sum(spike::int) over (partition by run, island order by step))::bigint as streak from sisl)"""


@query(f"with {_FINITE}, {_SPIKE} select run, step, round(base, 6) as base, spike, streak, streak >= 3 as tripped from spikes")
def guard_spike(spark, sf_dir):
    return guards.loss_spike(_finite(spark, sf_dir), _GUARD).withColumn("base", F.round("base", 6))


_DIVERGE = """k as (select *, row_number() over (partition by run order by step) as k from told),
    d as (select run, step, k, case when k <= 512 then quantile_cont(case when k <= 20 then loss end, 0.5) over (partition by run order by step) else quantile_cont(loss, 0.5) over (partition by run order by step rows between 511 preceding and 492 preceding) end as early,
        quantile_cont(loss, 0.5) over (partition by run order by step rows between 19 preceding and current row) as late from k),
    diverged as (select run, step, case when k >= 40 then early end as early, case when k >= 40 then late end as late, k >= 40 and early > 0 and late > 1.5 * early as tripped from d)"""


@query(f"with {_FINITE}, {_DIVERGE} select run, step, round(early, 6) as early, round(late, 6) as late, tripped from diverged")
def guard_divergence(spark, sf_dir):
    return guards.divergence(_finite(spark, sf_dir), _GUARD).withColumns({c: F.round(c, 6) for c in ("early", "late")})


_FIRST_TRIP = f"""with {_FINITE}, {_ZERO}, {_SPIKE}, {_DIVERGE}, trips as (select run, step, 0 as rank, {_NUMBERS} as reason from fin where {_NUMBERS} is not null
    union all select run, step, 1, 'zero_loss' from zero where streak >= 5 union all select run, step, 2, 'loss_spike' from spikes where streak >= 3 union all select run, step, 3, 'divergence' from diverged where tripped)
    select run, step, reason from trips qualify row_number() over (partition by run order by step, rank) = 1"""


@query(_FIRST_TRIP)
def guard_first_trip(spark, sf_dir):
    return guards.first_trip(_finite(spark, sf_dir), _GUARD)


@query(_FIRST_TRIP)
def guard_stream(spark, sf_dir):
    """The same decisions told by a stream that gets the series in four parts, dealt by event, so that steps come late and out of order; the first comes twice."""
    base = f"{shared_dir(spark)}/guards-{uuid.uuid4().hex}"
    rows = _finite(spark, sf_dir).select("run", "step", "loss", "grad_norm", F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("part"))
    rows = stored(rows)
    files_each = 1 + rows.count() // 1_000_000  # of a part
    for part in (0, 1, 0, 2, 3):
        rows.where(F.col("part") == part).drop("part").repartition(files_each).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 2 * files_each).parquet(f"{base}/in")
    put = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
    incremental.run_available(guarded.guarded(stream, _GUARD), put, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").drop("batch")


@query(f"""with recursive {_SERIES}, v as (select run, row_number() over (partition by run order by step) as k, step, loss as value from series where loss is not null),
    walk as (select run, k, value as best, step as best_step, 0 as bad, null::bigint as stop_step, null::varchar as reason from v where k = 1 and isfinite(value)
        union all select run, k, null, null, 0, step, 'non_finite_eval' from v where k = 1 and not isfinite(value)
        union all select w.run, v.k, case when isfinite(v.value) and v.value < w.best - 0.5 then v.value else w.best end, case when isfinite(v.value) and v.value < w.best - 0.5 then v.step else w.best_step end,
            case when v.value < w.best - 0.5 then 0 else w.bad + 1 end, case when not isfinite(v.value) or not v.value < w.best - 0.5 and w.bad + 1 > 3 then v.step end,
            case when not isfinite(v.value) then 'non_finite_eval' when not v.value < w.best - 0.5 and w.bad + 1 > 3 then 'early_stop' end
        from walk w join v on v.run = w.run and v.k = w.k + 1 where w.reason is null)
    select run, best, best_step, stop_step, reason from walk qualify row_number() over (partition by run order by k desc) = 1""")
def early_stopping(spark, sf_dir):
    return guards.early_stopping(series(spark, sf_dir).select("run", "step", F.col("loss").alias("value")), patience=3, min_delta=0.5)


_USAGE = "usage as (select user_id as run, row_number() over (partition by user_id order by ts, event_id)::bigint as step, floor(value * 10)::bigint as train_tokens, event_id % 7 as sample_tokens, 1 as steps, floor(value)::bigint / 128 as cost_usd from events)"


def _usage(spark, sf_dir):
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), step.alias("step"), F.floor(F.col("value") * 10).alias("train_tokens"), (F.col("event_id") % 7).alias("sample_tokens"), F.lit(1).alias("steps"), (F.floor("value") / 128.0).alias("cost_usd"),
    )


_BUDGET = runs.Budget(max_cost_usd=12.0, max_tokens=15000, max_steps=50)
_RUNNING = """r as (select run, step, sum(train_tokens + sample_tokens) over w as t, sum(steps) over w as s, sum(cost_usd) over w as c, train_tokens + sample_tokens as dt, steps as ds, cost_usd as dc from usage window w as (partition by run order by step)),
    running as (select run, step, t::bigint as used_tokens, s::bigint as used_steps, c as used_cost_usd, case when c > 12 then 'cost_usd' when t > 15000 then 'tokens' when s > 50 then 'steps' end as breached,
        concat_ws('+', case when c >= 9.6 and not c - dc >= 9.6 then 'cost_usd' end, case when t >= 12000 and not t - dt >= 12000 then 'tokens' end, case when s >= 40 and not s - ds >= 40 then 'steps' end) as warned from r)"""


@query(f"with {_USAGE}, {_RUNNING} select * from running")
def budget_running(spark, sf_dir):
    return runs.running_usage(_usage(spark, sf_dir), _BUDGET)


@query(f"with {_USAGE}, {_RUNNING} select run, step, breached, used_tokens from running where breached is not null qualify row_number() over (partition by run order by step) = 1")
def budget_first_breach(spark, sf_dir):
    return runs.first_breach(_usage(spark, sf_dir), _BUDGET)


@query(f"""with {_USAGE}, t as (select run, sum(train_tokens + sample_tokens)::bigint as tokens, sum(steps)::bigint as steps, sum(cost_usd) as cost_usd from usage group by run)
    select *, greatest(0.0, 12 - cost_usd) as left_cost_usd, greatest(0, 15000 - tokens)::double as left_tokens, greatest(0, 50 - steps)::double as left_steps, greatest(cost_usd / 12, tokens / 15000, steps / 50) as fraction_used from t""")
def budget_remaining(spark, sf_dir):
    totals = _usage(spark, sf_dir).groupBy("run").agg(F.sum(F.col("train_tokens") + F.col("sample_tokens")).alias("tokens"), F.sum("steps").alias("steps"), F.sum("cost_usd").alias("cost_usd"))
    return runs.remaining(totals, _BUDGET)


_ENTRIES = "entries as (select o_custkey as run, (row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) // 2 * 100)::bigint as step, o_orderkey as seq, case when o_orderkey % 11 = 0 then null else o_totalprice end as metric, 'step-' || o_orderkey as path from orders)"
_LAST = "last as (select * from entries qualify row_number() over (partition by run, step order by seq desc) = 1)"


def entries(spark, sf_dir):
    """Orders as checkpoints of a customer's run: two writes to a step, some without a metric."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), (F.floor(k / 2) * 100).alias("step"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("metric"), F.concat(F.lit("step-"), F.col("o_orderkey").cast("string")).alias("path"))


@query(f"with {_ENTRIES}, {_LAST} select run, step, seq, metric, path from last")
def last_write_dedupe(spark, sf_dir):
    return runs.last_writes(entries(spark, sf_dir))


@query(f"""with {_ENTRIES}, {_LAST}, k as (select *, row_number() over (partition by run order by step desc) as new, max(step) over (partition by run) as latest, case when metric is not null then row_number() over (partition by run order by metric nulls last, step desc) end as best from last),
    r as (select run, step, concat_ws('+', case when new = 1 then 'final' end, case when new <= 2 then 'last' end, case when best <= 1 then 'best' end, case when step % 400 = 0 then 'every' end, case when latest - step < 150 then 'young' end) as reasons from k)
    select run, step, case when reasons <> '' then 'keep' else 'delete' end as action, reasons from r""")
def retention_plan(spark, sf_dir):
    return runs.retention_plan(runs.last_writes(entries(spark, sf_dir)), runs.Retention(keep_last=2, keep_best=1, keep_every=400, min_age_steps=150))


@query(f"with {_ENTRIES} select run, arg_max(step, seq) as step, arg_max(path, seq) as path from entries group by run")
def latest_checkpoint(spark, sf_dir):
    return runs.latest_checkpoint(entries(spark, sf_dir))


_JOBS = """jobs as (select 'job-' || o_orderkey as id, case o_orderstatus when 'O' then 'running' when 'F' then 'succeeded' else 'pending' end as status, o_orderdate as created_at, o_orderkey % 60 as current_step, o_orderkey % 3 * 25 as total_steps from orders)"""


def jobs(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("pending")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("job-"), k.cast("string")).alias("id"), s.alias("status"), F.col("o_orderdate").alias("created_at"), (k % 60).alias("current_step"), (k % 3 * 25).alias("total_steps"), F.lit(None).cast("string").alias("error"))


@query(f"with {_JOBS} select id, status from jobs where status = 'succeeded' order by created_at desc, id limit 50")
def job_list_top(spark, sf_dir):
    """A top-50 report: the limit is the feature."""
    return runs.list_jobs(jobs(spark, sf_dir), "succeeded").select("id", "status")


@query(f"with {_JOBS} select case status when 'running' then 'failed' else status end as status, count(*)::bigint as n, count(*) filter (where status = 'running')::bigint as interrupted from jobs group by 1")
def job_reconcile(spark, sf_dir):
    return runs.reconcile(jobs(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.count("error").alias("interrupted"))


@query(f"with {_JOBS} select id, case when total_steps > 0 then least(1.0, current_step / total_steps) else 0.0 end::double as progress from jobs")
def job_progress(spark, sf_dir):
    return jobs(spark, sf_dir).select("id", runs.progress(F.col("current_step"), F.col("total_steps")).alias("progress"))


@query(f"with {_SERIES} select run, step, event_id from series qualify row_number() over (partition by run order by step desc) <= 10")
def metrics_tail(spark, sf_dir):
    return runs.metrics_tail(series(spark, sf_dir), 10).select("run", "step", "event_id")


@query("""with c as (select event_id, event_id % 8 + 1 as attempt, [400, 408, 429, 500, 503, 404][event_id % 6 + 1] as status from events)
    select event_id, attempt, status, status in (408, 425, 429, 500, 502, 503, 504) as retryable, least(0.5 * pow(2, attempt - 1), 30.0) as delay from c""")
def retry_backoff(spark, sf_dir):
    """Events as failed calls: whether each is worth another attempt, and when."""
    e = F.col("event_id")
    status = F.get(F.array(*map(F.lit, (400, 408, 429, 500, 503, 404))), (e % 6).cast("int"))
    rows = table(spark, sf_dir, "events").select(e, (e % 8 + 1).alias("attempt"), status.alias("status"))
    return rows.select("event_id", "attempt", "status", runs.is_retryable(F.col("status")).alias("retryable"), runs.backoff(F.col("attempt")).alias("delay"))


def _seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


_AT = "epoch_us(ts) / 1e6"


@query(f"""with recursive q as (select user_id as key, {_AT} as t, (event_id % 3 + 1)::double as amount, row_number() over (partition by user_id order by ts, event_id % 3) as k from events),
    walk as (select key, t, k, 5.0 >= amount as granted, case when 5.0 >= amount then 5.0 - amount else 5.0 end::double as tokens from q where k = 1
        union all select q.key, q.t, q.k, least(5.0, w.tokens + greatest(0.0, q.t - w.t) / 3600) >= q.amount, case when least(5.0, w.tokens + greatest(0.0, q.t - w.t) / 3600) >= q.amount then least(5.0, w.tokens + greatest(0.0, q.t - w.t) / 3600) - q.amount else least(5.0, w.tokens + greatest(0.0, q.t - w.t) / 3600) end
        from walk w join q on q.key = w.key and q.k = w.k + 1)
    select key, round(t, 3) as "at", granted, round(tokens, 6) as tokens from walk""")
def token_bucket(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), _seconds().alias("at"), (F.col("event_id") % 3 + 1).alias("amount"))
    return runs.token_bucket(requests, rate=1 / 3600, capacity=5.0).withColumns({"at": F.round("at", 3), "tokens": F.round("tokens", 6)})


@query(f"""with recursive q as (select user_id as key, {_AT} as t, event_type <> 'error' and event_id % 4 <> 0 as ok, row_number() over (partition by user_id order by ts, event_type <> 'error' and event_id % 4 <> 0) as k from events),
    walk as (select key, t, k, ok, 'closed' as state, false as rejected, case when ok then 0 else 1 end as bad, 0.0::double as opened, 'closed' as after from q where k = 1
        union all select q.key, q.t, q.k, q.ok, case when w.after = 'open' and q.t - w.opened >= 7200 then 'half_open' else w.after end,
            w.after = 'open' and q.t - w.opened < 7200,
            case when w.after = 'open' and q.t - w.opened < 7200 then w.bad when q.ok then 0 else w.bad + 1 end,
            case when not q.ok and (w.after = 'open' and q.t - w.opened >= 7200 or w.after = 'closed' and w.bad + 1 >= 2) then q.t else w.opened end,
            case when w.after = 'open' and q.t - w.opened < 7200 then 'open' when q.ok then 'closed' when w.after = 'open' or w.bad + 1 >= 2 then 'open' else 'closed' end
        from walk w join q on q.key = w.key and q.k = w.k + 1)
    select key, round(t, 3) as "at", state, rejected from walk""")
def circuit_breaker(spark, sf_dir):
    """Every fourth call fails; one probe at a time, which closes or opens the breaker at once."""
    ok = (F.col("event_type") != "error") & (F.col("event_id") % 4 != 0)
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), _seconds().alias("at"), ok.alias("ok"))
    return runs.circuit_breaker(calls, failures=2, recovery=7200.0).withColumn("at", F.round("at", 3))


@query("""select event_id, status, message, case when status is null then regexp_matches(lower(coalesce(message, '')), 'timeout|timed out|connection reset|rate limit|service unavailable') else status in (408, 425, 429, 500, 502, 503, 504) end as retryable, seconds as hint, greatest(1.0, coalesce(least(seconds, 30.0), 0.0)) as delay
    from events join (values (0, 429, null, 7.0::double), (1, 503, 'x', 90.0), (2, 404, 'timeout', null), (3, null, 'Read Timed Out', null), (4, null, 'bad request', 0.5), (5, null, null, null)) as t(k, status, message, seconds) on event_id % 6 = k""")
def retry_decisions(spark, sf_dir):
    """Events as answers with a status or a message, and headers that ask for a delay."""
    kinds = [(429, None, "Retry-After", "7"), (503, "x", "retry-after", "90"), (404, "timeout", "Retry-After", "soon"), (None, "Read Timed Out", None, None), (None, "bad request", "RETRY-AFTER", "0.5"), (None, None, None, None)]
    header = lambda k, v: F.create_map(F.lit(k), F.lit(v)) if k else F.lit(None).cast("map<string,string>")
    kind = F.array(*(F.struct(F.lit(s).cast("int").alias("status"), F.lit(m).cast("string").alias("message"), header(k, v).alias("headers")) for s, m, k, v in kinds))
    told = table(spark, sf_dir, "events").select("event_id", F.get(kind, (F.col("event_id") % 6).cast("int")).alias("x")).select("event_id", "x.*").withColumn("hint", runs.retry_after(F.col("headers")))
    return told.select("event_id", "status", "message", runs.is_retryable(F.col("status"), F.col("message")).alias("retryable"), "hint", runs.backoff(F.lit(2), hint=F.col("hint")).alias("delay"))


@query(f"""with {_JOBS}, m as (select id, case when id = 'job-1' then 'running' when id = 'job-2' then 'succeeded' when id = 'job-3' and status not in ('succeeded', 'failed', 'cancelled') then 'cancelled' else status end as status,
    case when id = 'job-1' then 'now' end as started_at, case when id = 'job-2' then 'later' end as finished_at from jobs) select status, count(*)::bigint as n, count(started_at)::bigint as started, count(finished_at)::bigint as finished from m group by status""")
def job_marks(spark, sf_dir):
    """A job set running, one finished, one cancelled, and a finished one that stays when cancelled."""
    rows = jobs(spark, sf_dir).withColumns({"started_at": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("string")})
    rows = runs.mark(runs.mark(rows, "job-1", "running", F.lit("now")), "job-2", "succeeded", F.lit("later"))
    return runs.cancel(runs.cancel(rows, "job-3"), "job-2").groupBy("status").agg(F.count("*").alias("n"), F.count("started_at").alias("started"), F.count("finished_at").alias("finished"))


@query(f"with {_JOBS} select id, status, total_steps from jobs where id not in ('job-5', 'job-new') union all select * from (values ('job-5', 'pending', 10), ('job-new', 'pending', 20)) as t(id, status, total_steps)")
def job_submit(spark, sf_dir):
    new = spark.createDataFrame([("job-5", 10), ("job-new", 20)], "id string, total_steps long")
    return runs.submit(jobs(spark, sf_dir), new).select("id", "status", "total_steps")


@query(f"with {_JOBS} select id, case status when 'running' then 'failed' else status end as status, current_step, total_steps from jobs")
def job_file_round_trip(spark, sf_dir):
    """Job records written as JSON and read after a restart."""
    path = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    files.write_jobs(jobs(spark, sf_dir).select("id", "status", "current_step", "total_steps"), path)
    return files.load_jobs(spark, path, lines=True).select("id", "status", "current_step", "total_steps")


@query(f"""with {_ENTRIES}, {_LAST}, k as (select *, row_number() over (partition by run order by step desc) as new, case when metric is not null then row_number() over (partition by run order by metric desc nulls last, step desc) end as best from last),
    r as (select run, step, seq, concat_ws('+', case when new = 1 then 'final' end, case when new <= 2 then 'last' end, case when best <= 1 then 'best' end) as reasons from k)
    select run, 'keep ' || coalesce(string_agg(step || ' (' || reasons || ')', ', ' order by step) filter (where reasons <> ''), '-') || '; delete ' || coalesce(string_agg(step::varchar, ', ' order by step) filter (where reasons = ''), '-') || '; missing -' as summary,
        coalesce(sum(seq % 1000) filter (where reasons = ''), 0)::bigint as bytes from r group by run""")
def retention_summary(spark, sf_dir):
    """Each run's plan in words (the largest metric is best) and the bytes that deleting frees."""
    last = runs.last_writes(entries(spark, sf_dir))
    plan = runs.retention_plan(last, runs.Retention(keep_last=2, keep_best=1, mode="max"))
    freed = runs.bytes_freed(plan, last.select("run", "step", (F.col("seq") % 1000).alias("bytes")))
    return runs.retention_summary(plan).join(freed, "run", "left").select("run", "summary", F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query("""with e as (select s_nationkey as run, s_suppkey as step, s_acctbal as metric, row_number() over (partition by s_nationkey order by s_suppkey desc) as newest,
        row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey desc) as best from supplier)
    select run::varchar as run, step::bigint as step, round(metric, 2)::double as metric from e where newest <= 2 or best <= 1""")
def retention_on_storage(spark, sf_dir):
    """Nations as runs whose suppliers are snapshots on the shared storage: what the manifests name after retention of all runs, and the files agree."""
    root = f"{shared_dir(spark)}/checkpoints-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("run"), F.col("s_suppkey").cast("long").alias("step"), F.col("s_acctbal").cast("double").alias("metric"))
    for r in rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", "metric"))).alias("steps")).toLocalIterator():  # a manifest for each of the nations
        entries = [{"step": s.step, "path": f"{root}/{r.run}/step-{s.step:06d}.state", "metrics": {"eval_loss": s.metric}} for s in r.steps]
        shared.replace_text(spark, f"{root}/{r.run}/{checkpoints.MANIFEST}", json.dumps(entries))
    states = rows.select(F.concat_ws("/", F.lit(root), "run", F.format_string("step-%06d.state", "step")).alias("path"), F.to_json(F.struct("step")).alias("text"))
    with Scratch(spark) as put:
        shared.write_texts(states, put)
    checkpoints.retain_all(spark, root, runs.Retention(keep_last=2, keep_best=1))
    left = checkpoints.plan_all(spark, root, runs.Retention(keep_last=10**6))
    return left.where("action = 'keep'").select("run", "step", F.round(F.col("metrics")["eval_loss"], 2).alias("metric"))

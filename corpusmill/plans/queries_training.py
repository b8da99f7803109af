"""Queries over rewards, preference pairs, evaluations, costs and simulated training."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import chat
from corpusmill.operators import tokens, training
from corpusmill.plans.catalog import query
from corpusmill.plans.queries_text import LEN_SQL, datum_sql, told_ids, told_weights
from corpusmill.plans.views import CHAT_SQL, examples, table
from corpusmill.sources.registry import MODELS, model_registry


@query("""with s as (select event_id, event_id % 200 as step, greatest(1, (200 * 0.03)::int) as warm from events), p as (select event_id, step, warm, least(1.0, greatest(0.0, (step - warm) / (200.0 - warm))) as p from s)
    select event_id, step, round(case when step < warm then 1e-4 * (step + 1) / warm else 1e-5 + 9e-5 * 0.5 * (1 + cos(pi() * p)) end, 12) as cosine, round(case when step < warm then 1e-4 * (step + 1) / warm else 1e-4 - 9e-5 * p end, 12) as linear, round(case when step < warm then 1e-4 * (step + 1) / warm else 1e-4 end, 12) as constant from p""")
def lr_schedule(spark, sf_dir):
    """The rates of 200 steps, each event at one of them."""
    step = F.col("event_id") % 200
    return table(spark, sf_dir, "events").select("event_id", step.alias("step"), *(F.round(training.learning_rate(step, 200, schedule=s), 12).alias(s) for s in ("cosine", "linear", "constant")))


@query("""with g as (select *, avg(o_totalprice) over w as m, stddev_pop(o_totalprice) over w as s from orders window w as (partition by o_custkey))
    select o_orderkey, round(o_totalprice - m, 6) as reinforce, round((o_totalprice - m) / (s + 1e-6), 6) as grpo from g""")
def group_advantages(spark, sf_dir):
    rewards = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    both = training.advantages(rewards, "o_custkey", "o_totalprice", "reinforce").withColumnRenamed("advantage", "reinforce")
    both = training.advantages(both, "o_custkey", "o_totalprice", "grpo").withColumnRenamed("advantage", "grpo")
    return both.select("o_orderkey", F.round("reinforce", 6).alias("reinforce"), F.round("grpo", 6).alias("grpo"))


@query("select o_custkey % 50 as iteration, round(avg(o_totalprice), 4) as reward_mean from orders group by 1")
def reward_mean(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("iteration")).agg(F.round(F.avg("o_totalprice"), 4).alias("reward_mean"))


_PAIRS = """pairs as (select l_orderkey % 40 as batch, -l_quantity * 0.9 as pc, -l_extendedprice / 1500 as pr, -l_quantity as rc, -l_extendedprice / 1500 - l_tax as rr from lineitem),
    m as (select batch, (pc - pr) - (rc - rr) as gap from pairs)"""
_LOGSIG = "(least(0.0, {0}) - ln(1 + exp(-abs({0}))))"


@query(f"with {_PAIRS} select batch, round(avg(-0.9 * {_LOGSIG.format('(0.1 * gap)')} - 0.1 * {_LOGSIG.format('(-0.1 * gap)')}), 6) as loss, round(avg(0.1 * gap), 6) as margin, round(avg((gap > 0)::int), 6) as accuracy from m group by batch")
def dpo_metrics(spark, sf_dir):
    return training.dpo_metrics(_pairs(spark, sf_dir), "batch", smoothing=0.1)


@query(f"with {_PAIRS} select batch, round(avg(pow(gap - 5, 2)), 6) as loss, round(avg(0.1 * gap), 6) as margin, round(avg((gap > 0)::int), 6) as accuracy from m group by batch")
def ipo_metrics(spark, sf_dir):
    return training.dpo_metrics(_pairs(spark, sf_dir), "batch", kind="ipo")


def _pairs(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / 1500
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("batch"), (-q * 0.9).alias("pc"), (-p).alias("pr"), (-q).alias("rc"), (-p - F.col("l_tax")).alias("rr"))


@query(f"""with {LEN_SQL}, b as (select row_id % 16 as batch, supervised_len / 100.0 as loss from lens), m as (select batch, avg(loss) as m from b group by batch) select round(avg(m), 6) as loss, count(*)::bigint as batches from m""")
def held_out_loss(spark, sf_dir):
    rows = tokens.token_lengths(examples(spark, sf_dir)).select((F.col("row_id") % 16).alias("batch"), (F.col("supervised_len") / 100.0).alias("loss"))
    return training.held_out_loss(rows, "batch", "loss").withColumn("loss", F.round("loss", 6))


@query(f"""with {CHAT_SQL}, a as (select row_id, contents[len(roles) - list_position(list_reverse(roles), 'assistant') + 1] as answer from chat), b as (select answer, case when row_id % 3 = 0 then lower(answer) || ' ' when row_id % 3 = 1 then answer else answer || '!' end as given from a)
    select round(avg((trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(given), '\\s+', ' ', 'g')))::int), 6) as accuracy, count(*)::bigint as n from b""")
def exact_match(spark, sf_dir):
    a = examples(spark, sf_dir).select("row_id", chat.last_answer(F.col("messages")).alias("answer"))
    k = F.col("row_id") % 3
    given = a.withColumn("given", F.when(k == 0, F.concat(F.lower("answer"), F.lit(" "))).when(k == 1, F.col("answer")).otherwise(F.concat("answer", F.lit("!"))))
    return training.exact_match(given, "given", "answer").withColumn("accuracy", F.round("accuracy", 6))


_MODEL_SQL = "m as (select * from (values " + ", ".join(f"({i}, '{r[0]}', {r[3]}::double)" for i, r in enumerate(MODELS)) + f", ({len(MODELS)}, 'someone/unknown', null::double)) as t(k, model, active_b))"


@query(f"""with {_MODEL_SQL}, u as (select o_custkey % {len(MODELS) + 1} as k, sum(o_orderkey)::bigint as train_tokens, sum(o_orderkey % 97)::bigint as sample_tokens from orders group by 1),
    r as (select *, case when k = 0 then 1.5 else 0.02 * coalesce(active_b, 8.0) end::double as tr, case when k = 1 then 0.125 when k = 0 then 0.375 else 0.005 * coalesce(active_b, 8.0) end::double as sr from u join m using (k))
    select model, train_tokens, sample_tokens, round(tr, 6) as train_rate, round(sr, 6) as sample_rate, round((train_tokens * tr + sample_tokens * sr) / 1e6, 6) as cost_usd from r""")
def cost_model(spark, sf_dir):
    names = F.array(*(F.lit(r[0]) for r in MODELS), F.lit("someone/unknown"))
    usage = table(spark, sf_dir, "orders").groupBy(F.get(names, (F.col("o_custkey") % (len(MODELS) + 1)).cast("int")).alias("model")).agg(F.sum("o_orderkey").alias("train_tokens"), F.sum(F.col("o_orderkey") % 97).alias("sample_tokens"))
    prices = {MODELS[0][0]: (1.5, None), MODELS[1][0]: (None, 0.125)}
    return training.costs(usage, model_registry(spark), prices=prices).withColumns({c: F.round(c, 6) for c in ("train_rate", "sample_rate", "cost_usd")})


@query(f"with {LEN_SQL} select (count(*) * avg(seq_len) * 3)::bigint as tokens from lens")
def token_estimate(spark, sf_dir):
    seen = tokens.token_lengths(examples(spark, sf_dir)).agg(F.count("*").alias("n"), F.avg("seq_len").alias("mean"))
    return seen.select(training.estimated_tokens(F.col("n"), F.col("mean"), F.lit(3)).alias("tokens"))


_BYTE_SUM = "list_sum(list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::int))"
_LOGPROB = "(-0.8 * n * exp(-step / 80.0) - 0.2 * n + (((target + n) % 1000) / 1000.0 - 0.5) * 0.1 * n)"


@query(f"""with {LEN_SQL}, r as (select row_id, supervised_len as n, array_to_string(list_transform(messages, lambda x: '<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>' || chr(10)), '') as t from lens),
    s as (select row_id, n, {_BYTE_SUM.format('t')} - 60 + 257 as target from r) select row_id, step, round({_LOGPROB}, 6) as logprob from s, (values (0), (40), (400)) as v(step)""")
def simulated_logprobs(spark, sf_dir):
    """The dry run's log-probabilities of whole examples at three steps."""
    rows = examples(spark, sf_dir).select("row_id", chat.supervised_datum(F.col("messages"), 1_000_000).alias("d")).withColumn("step", F.explode(F.array(F.lit(0), F.lit(40), F.lit(400))))
    return rows.select("row_id", "step", F.round(training.datum_logprob(F.col("d"), F.col("step")), 6).alias("logprob"))


_PAIR_SQL = f"""{CHAT_SQL}, one as (select row_id, contents[1] as p, contents[list_position(roles, 'assistant')] as c from chat)"""


@query(f"""with {_PAIR_SQL}, s as (select row_id, strlen(c) + 1 as n, {_BYTE_SUM.format("(p || c)")} + 514 as target, 10 as step from one) select row_id, n::bigint as supervised, round(1 / (1 + exp(-{_LOGPROB} / n)), 6) as score from s""")
def reward_model_datums(spark, sf_dir):
    """A prompt's and a completion's row as a reward model gets it, and the logistic of its mean log-probability."""
    m = F.col("messages")
    first = F.get(F.transform(F.filter(m, lambda x: x["role"] == "assistant"), lambda x: x["content"]), 0)
    one = examples(spark, sf_dir).select("row_id", F.get(m, 0)["content"].alias("p"), first.alias("c"))
    d = chat.completion_datum(F.col("p"), F.col("c"))
    return one.select("row_id", F.size(F.filter(d["weights"], lambda w: w > 0)).cast("long").alias("supervised"), F.round(training.reward_model_score(F.col("p"), F.col("c"), F.lit(10)), 6).alias("score"))


@query("select l_orderkey, l_linenumber, repeat('0', least(l_quantity::int, greatest(l_linenumber, 1) - 1)) || repeat('+', greatest(0, l_quantity::int - greatest(l_linenumber, 1) + 1)) as chosen, repeat('0', least(l_quantity::int, greatest(l_linenumber, 1) - 1)) || repeat('-', greatest(0, l_quantity::int - greatest(l_linenumber, 1) + 1)) as rejected from lineitem")
def signed_weights(spark, sf_dir):
    """Weights of chosen and rejected rows, as signs."""
    w = training.completion_weights(F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.lit(1.0))
    told = lambda sign: F.array_join(F.transform(training.signed_weights(w, sign), lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0")), "")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", told(1).alias("chosen"), told(-1).alias("rejected"))


@query("select o_orderkey, o_orderkey % 256 + 1 as lora_rank, round(64.0 / (o_orderkey % 256 + 1), 6)::double as scaling from orders")
def lora_scaling(spark, sf_dir):
    """Ranks from 1 to 256, dealt to orders."""
    rank = F.col("o_orderkey") % 256 + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", rank.alias("lora_rank"), F.round(training.lora_scaling(rank), 6).alias("scaling"))


@query("select p.k as prompt_no, item_id, g.k as sample, 5 + 200000 + p.k * 1000 + g.k as seed, true as holds from (select item_id, row_number() over (order by item_id) - 1 as k from benchmark) p, range(4) as g(k)")
def rollouts(spark, sf_dir):
    """Four samples of each prompt of an iteration; the completions' tokens are hashes, so their bounds are told."""
    rows = training.rollouts(table(spark, sf_dir, "benchmark"), "item_id", "text", iteration=2, group=4, seed=5, longest=64)
    c = F.col("completion")
    n = F.size(c["tokens"])
    holds = n.between(1, 64) & (n == F.size(c["logprobs"])) & F.forall(c["tokens"], lambda t: t.between(10, 2000)) & F.forall(c["logprobs"], lambda x: x < 0) & ((c["stop"] == "length") == (n == 64))
    return rows.select("prompt_no", "item_id", F.col("sample").cast("long").alias("sample"), "seed", holds.alias("holds"))


@query("""with recursive l as (select supplier.s_suppkey as k, (abs(s_acctbal)::bigint % 900 + 100) as len, row_number() over (order by s_suppkey) as i from supplier),
    walk as (select i, k, len, 0::bigint as pack_no, 0::bigint as o from l where i = 1
        union all select l.i, l.k, l.len, case when w.o + w.len + l.len <= 2048 then w.pack_no else w.pack_no + 1 end, case when w.o + w.len + l.len <= 2048 then w.o + w.len else 0 end from walk w join l on l.i = w.i + 1)
    select count(distinct pack_no)::bigint as n_packs, ceil(count(distinct pack_no) / 8)::bigint as steps_per_epoch, ceil(count(distinct pack_no) / 8)::bigint * 3 as total_steps from walk""")
def steps_per_epoch(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), (F.round(F.abs("s_acctbal")).cast("long") % 900 + 100).alias("len"))
    return tokens.steps_per_epoch(tokens.in_order_packs(rows, 2048), batch_size=8, epochs=3)


@query("select o_orderkey, round((row_number() over (partition by o_custkey order by o_orderkey)) / (count(*) over (partition by o_custkey)), 4) as epoch from orders")
def epoch_fraction(spark, sf_dir):
    return tokens.epoch_fraction(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", F.round("epoch", 4).alias("epoch"))


_ANSWERED = "list_append(messages, {'role': 'assistant', 'content': contents[list_position(roles, 'assistant')]})"
_MARKED = "list_append(messages, {'role': 'assistant', 'content': contents[list_position(roles, 'assistant')] || ' other'})"


@query(f"""with {CHAT_SQL}, a as (select row_id, {datum_sql(_ANSWERED, 256)} from chat), b as (select row_id, {datum_sql(_MARKED, 256)} from chat)
    select row_id, md5(a.inputs || a.weights) as chosen, md5(b.targets || b.weights) as rejected, strlen(a.weights)::bigint as n_chosen, strlen(b.weights)::bigint as n_rejected from a join b using (row_id)""")
def preference_datums(spark, sf_dir):
    """Two training rows that share a prompt: an example's messages with its first answer, and with a marked one."""
    m = F.col("messages")
    first = F.get(F.transform(F.filter(m, lambda x: x["role"] == "assistant"), lambda x: x["content"]), 0)
    d = examples(spark, sf_dir).select("row_id", training.preference_datums(m, first, F.concat(first, F.lit(" other")), 256).alias("d"))
    c, r = F.col("d.chosen"), F.col("d.rejected")
    return d.select("row_id", F.md5(F.concat(told_ids(c["input_tokens"]), told_weights(c["weights"]))).alias("chosen"), F.md5(F.concat(told_ids(r["target_tokens"]), told_weights(r["weights"]))).alias("rejected"), F.size(c["weights"]).cast("long").alias("n_chosen"), F.size(r["weights"]).cast("long").alias("n_rejected"))


@query("select l_orderkey, l_linenumber, repeat('0', least(l_quantity::int, greatest(l_linenumber, 1) - 1)) || repeat('1', greatest(0, l_quantity::int - greatest(l_linenumber, 1) + 1)) as mask, greatest(0, l_quantity::bigint - greatest(1, l_linenumber) + 1)::bigint as weighted, round(greatest(0, l_quantity::bigint - greatest(1, l_linenumber) + 1) * l_discount, 6) as advantage_sum from lineitem")
def completion_masks(spark, sf_dir):
    """Quantity as length, line number as prompt length, discount as advantage: positions whose target is in the completion."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", training.completion_weights(F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.lit(1.0)).alias("w"), "l_discount")
    on = F.size(F.filter("w", lambda x: x > 0)).cast("long")
    return rows.select("l_orderkey", "l_linenumber", told_weights(F.col("w")).alias("mask"), on.alias("weighted"), F.round(on * F.col("l_discount"), 6).alias("advantage_sum"))


@query("select o_orderkey % 10 as iteration, p.k as prompt, g.k as sample, 3 + (o_orderkey % 10) * 100000 + p.k * 1000 + g.k as seed from (select distinct o_orderkey % 10 as o_orderkey from orders) o, range(4) as p(k), range(8) as g(k)")
def rollout_seeds(spark, sf_dir):
    """The seed of each sample of a group, for each prompt of an iteration."""
    its = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("iteration")).distinct()
    each = its.select("iteration", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("prompt")).select("iteration", "prompt", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sample"))
    return each.select("iteration", F.col("prompt").cast("long").alias("prompt"), F.col("sample").cast("long").alias("sample"), training.rollout_seed(F.lit(3), F.col("iteration"), F.col("prompt"), F.col("sample")).alias("seed"))

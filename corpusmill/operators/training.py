"""Tabular parts of training: schedules, advantages, preference losses, evaluation, costs, simulated metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import chat, text
from corpusmill.operators import ranks


def learning_rate(step: Column, total: int, peak: float = 1e-4, warmup_ratio: float = 0.03, schedule: str = "cosine", min_ratio: float = 0.1) -> Column:
    """Linear warm-up, then constant, linear or cosine decay to peak * min_ratio."""
    if schedule not in ("constant", "linear", "cosine"):
        raise ValueError("schedule is constant, linear or cosine")
    if total <= 0:
        return F.lit(peak)
    warm, low = max(1, int(total * warmup_ratio)), peak * min_ratio
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warm) / float(max(1, total - warm))))
    late = {"constant": F.lit(peak), "linear": peak + (low - peak) * p, "cosine": low + (peak - low) * 0.5 * (1 + F.cos(math.pi * p))}[schedule]
    return F.when(step < warm, peak * (step + 1) / float(warm)).otherwise(late)


def advantages(rewards: DataFrame, group: str, reward: str, kind: str = "grpo") -> DataFrame:
    """rewards with advantage: reward less its group's mean, for grpo over its population deviation."""
    if kind not in ("grpo", "reinforce"):
        raise ValueError("kind is grpo or reinforce")
    stats = rewards.groupBy(group).agg(F.avg(reward).alias("__mean"), F.stddev_pop(reward).alias("__std"))  # combined before the shuffle
    centred = F.col(reward) - F.col("__mean")
    return rewards.join(stats, group).withColumn("advantage", centred / (F.col("__std") + 1e-6) if kind == "grpo" else centred).drop("__mean", "__std")


def log_sigmoid(x: Column) -> Column:
    return F.least(F.lit(0.0), x) - F.log1p(F.exp(-F.abs(x)))


def dpo_loss(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, smoothing: float = 0.0, kind: str = "sigmoid") -> tuple[Column, Column, Column]:
    """loss, margin, preferred of a preference pair."""
    gap = (policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)
    margin = beta * gap
    if kind == "ipo":
        loss = F.pow(gap - 1 / (2 * beta), F.lit(2))
    elif kind == "sigmoid":
        loss = -(1 - smoothing) * log_sigmoid(margin) - smoothing * log_sigmoid(-margin)
    else:
        raise ValueError("kind is sigmoid or ipo")
    return loss, margin, margin > 0


def dpo_metrics(pairs: DataFrame, batch: str, **options) -> DataFrame:
    """(batch, pc, pr, rc, rr) -> batch, loss, margin, accuracy."""
    loss, margin, preferred = dpo_loss(F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"), **options)
    return pairs.groupBy(batch).agg(F.round(F.avg(loss), 6).alias("loss"), F.round(F.avg(margin), 6).alias("margin"), F.round(F.avg(preferred.cast("double")), 6).alias("accuracy"))


def preference_messages(prompt: Column, answer: Column) -> Column:
    """The prompt's messages and an answer as one conversation: a pair gives two that share a prompt."""
    return F.concat(prompt, F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content"))))


def preference_datums(prompt: Column, chosen: Column, rejected: Column, limit: int) -> Column:
    """struct(chosen, rejected): the training rows of both answers to a prompt."""
    return F.struct(chat.supervised_datum(preference_messages(prompt, chosen), limit).alias("chosen"), chat.supervised_datum(preference_messages(prompt, rejected), limit).alias("rejected"))


def signed_weights(weights: Column, sign: int) -> Column:
    """+1 or -1 where a token has weight: chosen and rejected rows of a preference batch."""
    return F.transform(weights, lambda w: F.when(w > 0, float(sign)).otherwise(0.0))


def completion_weights(length: Column, prompt_length: Column, value: Column) -> Column:
    """0 while a position's target still lies in the prompt, the value from there on."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(i + 1 < prompt_length, F.lit(0.0)).otherwise(value))


def simulated_logprob(tokens: Column, target_sum: Column, step: Column) -> Column:
    """The dry-run backend's log-probability of n supervised tokens."""
    n = F.greatest(F.lit(1), tokens)
    return -0.8 * n * F.exp(-step / 80.0) - 0.2 * n + (F.pmod(target_sum + n, F.lit(1000)) / 1000.0 - 0.5) * 0.1 * n


def datum_logprob(d: Column, step: Column) -> Column:
    """The dry run's log-probability of a training row."""
    n = F.size(F.filter(d["weights"], lambda w: w > 0))
    return simulated_logprob(n, F.aggregate(d["target_tokens"], F.lit(0).cast("long"), lambda a, t: a + t), step)


def reward_model_score(prompt: Column, completion: Column, step: Column) -> Column:
    """Logistic of the mean log-probability of a completion given its prompt."""
    return text.let(chat.completion_datum(prompt, completion), lambda d: mean_logprob_score(datum_logprob(d, step), F.greatest(F.lit(1), F.size(F.filter(d["weights"], lambda w: w > 0)))))


def simulated_sample(seed: Column, longest: int) -> Column:
    """struct(tokens, logprobs, stop): the dry run's completion, 1 to `longest` tokens drawn from hashes of the seed."""
    draw = lambda *of: F.pmod(F.xxhash64(seed, *map(F.lit, of[:1]), *of[1:]), F.lit(1 << 30))
    n = (draw("length") % max(1, longest) + 1).cast("int")
    tokens = F.transform(F.sequence(F.lit(1), n), lambda i: (draw("token", i) % 1991 + 10).cast("int"))
    logprobs = F.transform(F.sequence(F.lit(1), n), lambda i: -(0.1 + draw("logprob", i) / float(1 << 30) * 1.8))
    return F.struct(tokens.alias("tokens"), logprobs.alias("logprobs"), F.when(n < longest, "stop").otherwise("length").alias("stop"))


def rollouts(prompts: DataFrame, key: str, prompt: str, iteration: int, group: int, seed: int = 0, longest: int = 64) -> DataFrame:
    """(key, prompt) -> a row for each sample of a prompt: key, prompt_no, sample, seed, completion (tokens, logprobs, stop)."""
    listed = ranks.numbered(prompts.select(F.lit(0).alias("all"), key, prompt), ["all"], [key], "prompt_no").drop("all")
    each = listed.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(group - 1)))).withColumn("seed", rollout_seed(F.lit(seed), F.lit(iteration), F.col("prompt_no"), F.col("sample")))
    return each.withColumn("completion", simulated_sample(F.col("seed"), longest))


def lora_scaling(rank: Column, alpha: float = 64.0) -> Column:
    """An adapter's factor: alpha by rank."""
    return F.lit(alpha) / rank


def mean_logprob_score(total: Column, n: Column) -> Column:
    return 1 / (1 + F.exp(-F.try_divide(total, n)))


def byte_sum(value: Column) -> Column:
    """Sum of a text's UTF-8 bytes."""
    return F.aggregate(chat.byte_ids(value), F.lit(0).cast("long"), lambda a, b: a + b)


def held_out_loss(rows: DataFrame, batch: str, loss: str) -> DataFrame:
    """One row: the mean of batch means, each batch counting alike; null without batches."""
    return rows.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("loss"), F.count("*").alias("batches"))


def exact_match(rows: DataFrame, answer: str, expected: str) -> DataFrame:
    """One row: the share of answers equal to the expected ones after lower case and single spaces."""
    hit = text.squeezed_lower(F.col(answer)) == text.squeezed_lower(F.col(expected))
    return rows.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n"))


def costs(usage: DataFrame, registry: DataFrame, per_billion: float = 0.02, sample_discount: float = 0.25, fallback_b: float = 8.0, prices: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """(model, train_tokens, sample_tokens) -> with rates in USD per million tokens and cost_usd.

    prices: train and sample rate by model, either may be None. Without a price training costs by active billions (fallback_b for
    unknown models) and sampling the training rate at a discount. Negative tokens fail the job.
    """
    spark = usage.sparkSession
    told = spark.createDataFrame([(k, *v) for k, v in (prices or {}).items()], "model string, own_train double, own_sample double")
    sizes = registry.select(F.col("name").alias("model"), "active_b")
    known = usage.join(F.broadcast(sizes), "model", "left").join(F.broadcast(told), "model", "left")  # few rows
    priced = known.withColumn("train_rate", F.coalesce("own_train", per_billion * F.coalesce("active_b", F.lit(fallback_b))))
    priced = priced.withColumn("sample_rate", F.coalesce("own_sample", F.col("train_rate") * sample_discount)).drop("active_b", "own_train", "own_sample")
    odd = (F.col("train_tokens") < 0) | (F.col("sample_tokens") < 0)
    cost = (F.col("train_tokens") * F.col("train_rate") + F.col("sample_tokens") * F.col("sample_rate")) / 1e6
    return priced.withColumn("cost_usd", F.when(odd, F.raise_error(F.lit("tokens are not negative"))).otherwise(cost))


def estimated_tokens(n: Column, average: Column, epochs: Column) -> Column:
    """Tokens of a run over n examples; negative inputs fail the job."""
    odd = F.least(n, average, epochs) < 0
    return F.when(odd, F.raise_error(F.lit("estimates are not negative"))).otherwise((n * average * epochs).cast("bigint"))


def round_robin(rows: DataFrame, key: str, iterations: int, per_batch: int) -> DataFrame:
    """draw, iteration, position, key: iterations of per_batch rows, around the list in key order again and again."""
    listed = ranks.numbered(rows.select(F.lit(0).alias("all"), key), ["all"], [key]).drop("all")
    n = F.broadcast(listed.agg(F.greatest(F.lit(1), F.count("*")).alias("n")))  # one row
    ids = rows.sparkSession.range(iterations * per_batch).join(n)
    draws = ids.select(F.col("id").alias("draw"), F.floor(F.col("id") / per_batch).alias("iteration"), (F.col("id") % F.col("n")).alias("position"))
    return draws.join(listed, "position").select("draw", "iteration", "position", key)


def rollout_seed(seed: Column, iteration: Column, prompt: Column, sample: Column) -> Column:
    return seed + iteration * 100_000 + prompt * 1000 + sample

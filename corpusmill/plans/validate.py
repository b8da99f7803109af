"""The dataset lint: every finding of a chat corpus with its count and first row ids, and the corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import chat, text
from corpusmill.operators import dedup, ranks
from corpusmill.operators.stored import stored
from corpusmill.operators.tokens import effective_limit, tail_rank, upper_median_rank

RANK = {"info": 0, "warning": 1, "error": 2}
#: The severity of each finding.
SEVERITY = {
    "empty_dataset": "error", "tiny_dataset": "warning", "empty_assistant_turn": "error", "zero_supervised_tokens": "error", "prompt_truncated_away": "error", "untokenizable_example": "error",
    "context_overflow": "error", "truncation": "warning", "system_turn_not_first": "warning", "consecutive_same_role": "warning", "trailing_user_turn": "info", "control_characters": "warning",
    "zero_width_characters": "warning", "bidi_override": "error", "lone_surrogate": "error", "replacement_character": "warning", "unicode_not_nfc": "info", "pii_detected": "error",
    "exact_duplicates": "warning", "near_duplicates": "warning", "label_conflict": "warning", "response_collapse": "warning", "eval_contamination": "error", "length_outliers": "info",
}
COLUMNS = ("code", "severity", "count", "examples")


def row_flags(examples: DataFrame, limit: int, context: int | None) -> DataFrame:
    """row_id and a boolean for each finding that a row has by itself: one pass, no shuffle."""
    m, n, blob = F.col("messages"), chat.sequence_length(F.col("messages")), F.col("__blob")
    surrogate = F.col("lone_surrogate") if "lone_surrogate" in examples.columns else F.lit(False)
    over = (n > context) if context else F.lit(False)
    flags: dict[str, Column] = {
        "empty_assistant_turn": chat.empty_target(m), "zero_supervised_tokens": F.lit(limit == 1), "prompt_truncated_away": chat.prompt_truncated_away(m, limit), "untokenizable_example": surrogate, "context_overflow": over,
        "truncation": n > limit, "system_turn_not_first": chat.system_not_first(m), "consecutive_same_role": chat.consecutive_same_role(m), "trailing_user_turn": chat.trailing_user_turn(m),
        **{k: text.hazard(blob, k) for k in text.HAZARDS}, "lone_surrogate": surrogate, "unicode_not_nfc": text.not_nfc(blob), "pii_detected": text.has_pii(blob),
    }
    joined = examples.withColumn("__blob", chat.joined_text(m))
    return joined.select("row_id", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))


def keyed(examples: DataFrame, exact_norm: bool = True) -> DataFrame:
    """row_id, prompt_key, response_key, norm (both texts); without exact_norm the JVM-side form, exact for text in NFKC."""
    norm = text.normalized_all if exact_norm else text.normalized
    m = F.col("messages")
    p, r = chat.prompt_text(m), chat.response_text(m)
    both = examples.select("row_id", norm(p).alias("prompt_key"), norm(r).alias("response_key"))
    return both.withColumn("norm", F.trim(F.concat("prompt_key", F.lit(" "), "response_key")))  # no form reaches across a line's end


def findings(examples: DataFrame, evaluation: DataFrame | None = None, max_seq_len: int | None = None, context: int | None = None, threshold: float = 0.85, min_examples: int = 8, exact_norm: bool = True) -> DataFrame:
    """(row_id, messages) -> code, severity, count, examples (first five row ids), by severity and code.

    Row flags come from one scan; duplicates, conflicts and similar rows from grouped keys and sketches. Truncation is
    told only where no row overflows the context.
    """
    limit = effective_limit(max_seq_len, context)
    examples = stored(examples)  # read by every branch below
    spark, n = examples.sparkSession, examples.count()
    none = spark.createDataFrame([], "code string, severity string, count long, examples array<long>")
    if not n:
        return none.unionByName(spark.createDataFrame([("empty_dataset", "error", 1, [])], none.schema))
    flags = row_flags(examples, limit, context)
    told = flags.select("row_id", F.explode(F.array_compact(F.array(*(F.when(F.col(c), c) for c in flags.columns[1:])))).alias("code"))
    k = stored(keyed(examples, exact_norm))
    firsts = dedup.first_sketches(k)
    parts = {
        "exact_duplicates": dedup.exact_duplicates(k, "prompt_key", "response_key"), "label_conflict": dedup.label_conflicts(k),
        "near_duplicates": dedup.near_duplicates(k, threshold, pair=("prompt_key", "response_key"), firsts=firsts),
    }
    if evaluation is not None:
        parts["eval_contamination"] = dedup.contamination(keyed(evaluation, exact_norm).select("row_id", "norm"), k, threshold, firsts=firsts)
    for code, rows in parts.items():
        told = told.unionByName(rows.select(F.col("row_id").cast("long").alias("row_id"), F.lit(code).alias("code")))
    rolled = dedup.first_examples(stored(told))
    shared = k.groupBy(dedup.digest("response_key")).agg(F.count("*").alias("c")).agg(F.max("c").alias("count")).where((F.lit(n) >= 4) & (F.col("count") >= 0.5 * n))
    picks = ranks.pick(examples.select(chat.sequence_length(F.col("messages")).alias("v")), "v", {"p50": upper_median_rank(), "p99": tail_rank(0.99)})
    outliers = picks.where("p50 > 0 and p99 >= 20 * p50")
    lone = F.array().cast("array<long>")
    rolled = rolled.unionByName(shared.select(F.lit("response_collapse").alias("code"), "count", lone.alias("examples"))).unionByName(outliers.select(F.lit("length_outliers").alias("code"), F.lit(1).cast("long").alias("count"), lone.alias("examples")))
    if n < min_examples:
        rolled = rolled.unionByName(spark.createDataFrame([("tiny_dataset", n, [])], "code string, count long, examples array<long>"))
    if context:
        overflows = rolled.where("code = 'context_overflow'").select(F.lit("truncation").alias("hidden"))
        rolled = rolled.join(F.broadcast(overflows), F.col("code") == F.col("hidden"), "left_anti")  # one row
    severity = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("code"))
    severity = F.when((F.col("code") == "exact_duplicates") & (F.col("count") >= 0.2 * n), "error").otherwise(severity)
    out = rolled.withColumn("severity", severity).select(*COLUMNS)
    return out.orderBy(F.desc(severity_rank(F.col("severity"))), "code")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warning", 1).otherwise(0)


def at_or_above(found: DataFrame, severity: str) -> DataFrame:
    return found.where(severity_rank(F.col("severity")) >= RANK[severity])


def gate(found: DataFrame, severity: str = "error") -> None:
    """ValueError if a finding is at least so severe."""
    worst = at_or_above(found, severity).limit(1).collect()
    if worst:
        raise ValueError(f"{worst[0].code}: {worst[0].severity}, {worst[0]['count']} rows")


def distinct_keys(k: DataFrame) -> DataFrame:
    """(prompt_key, response_key) -> one row: n, unique_prompts, unique_responses, unique_pairs, top (rows with the commonest response).

    Keys are counted by their digests; no text is shuffled. A digest that is seen in many rows is combined before the shuffle.
    """
    rows = k.select(dedup.digest("prompt_key").alias("p"), dedup.digest("response_key").alias("r"))
    pairs = stored(rows.groupBy("p", "r").agg(F.count("*").alias("c")))
    whole = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("unique_pairs"))
    prompts = pairs.select("p").distinct().agg(F.count("*").alias("unique_prompts"))
    responses = pairs.groupBy("r").agg(F.sum("c").alias("c")).agg(F.count("*").alias("unique_responses"), F.max("c").alias("top"))
    return whole.join(prompts).join(responses)  # one row each


def corpus_stats(examples: DataFrame) -> DataFrame:
    """One row: token totals, supervised share, distinct keys, duplicate rate, share of the commonest response."""
    m = F.col("messages")
    sums = examples.agg(F.sum(chat.sequence_length(m)).alias("total_tokens"), F.sum(chat.supervised_tokens(m)).alias("supervised_tokens"))
    row = sums.join(distinct_keys(keyed(examples)))
    return row.select(
        "n", "total_tokens", "supervised_tokens", F.round(F.try_divide("supervised_tokens", "total_tokens"), 4).alias("supervised_ratio"), "unique_prompts", "unique_responses",
        F.round(F.try_divide(F.col("n") - F.col("unique_pairs"), "n"), 4).alias("duplicate_rate"), F.round(F.try_divide("top", "n"), 4).alias("top_response_share"),
    )

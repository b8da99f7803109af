"""The drift report of two chat corpora: three lengths, the answers' first words, the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import chat
from corpusmill.operators import drift
from corpusmill.operators.stored import stored

WORDS_PER_MESSAGE = 200


def features(examples: DataFrame, side: Column) -> DataFrame:
    """(row_id, messages) -> side, row_id, prompt_chars, answer_chars, turns, answer_prefix."""
    m = F.col("messages")
    return examples.select(
        side.alias("side"), F.col("row_id").alias("position"), chat.side_chars(m, False).cast("double").alias("prompt_chars"), chat.side_chars(m, True).cast("double").alias("answer_chars"), F.size(m).cast("double").alias("turns"), chat.answer_prefix(m).alias("answer_prefix"),
    )


def vocabulary(examples: DataFrame, side: Column) -> DataFrame:
    """side, word, position of every word, at most 200 of each message."""
    words = F.slice(F.regexp_extract_all(F.lower("x.content"), F.lit("[a-z0-9']+"), F.lit(0)), 1, WORDS_PER_MESSAGE)
    told = examples.select(side.alias("side"), "row_id", F.posexplode("messages").alias("at", "x")).select("side", "row_id", "at", F.posexplode(words).alias("k", "word"))
    return told.select("side", "word", F.struct("row_id", "at", "k").alias("position"))


def drift_report(examples: DataFrame, side: Column, baseline, candidate, num_bins: int = drift.NUM_BINS, top_k: int = drift.TOP_K) -> DataFrame:
    """feature, psi, jsd, ks, severity, detail: three numeric and two categorical features."""
    f = stored(features(examples, side))  # a few numbers a row; the chats are read once for them and once for the words
    parts = [drift.compare_distributions(f, c, baseline, candidate, num_bins=num_bins) for c in ("prompt_chars", "answer_chars", "turns")]
    for rows, key in ((f, "answer_prefix"), (vocabulary(examples, side), "word")):
        parts.append(drift.compare_categorical(rows, key, baseline, candidate, feature="vocabulary" if key == "word" else key, top_k=top_k).select("feature", "psi", "jsd", F.lit(None).cast("double").alias("ks"), "severity", "detail"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overall(report: DataFrame) -> DataFrame:
    """One row: the highest severity, and whether anything drifted."""
    rank = F.array_position(F.array(*map(F.lit, drift.SEVERITIES)), F.col("severity"))
    top = F.max_by("severity", rank)
    return report.agg(top.alias("severity"), (top != "info").alias("drifted"))


def size_note(examples: DataFrame, side: Column, baseline, candidate) -> DataFrame:
    """One row: ratio of candidate to baseline rows, and a note if it is under 0.5 or over 2."""
    n = examples.select(side.alias("side")).agg(F.count(F.when(F.col("side") == baseline, 1)).alias("b"), F.count(F.when(F.col("side") == candidate, 1)).alias("c"))
    ratio = F.try_divide("c", "b")
    return n.select(F.round(ratio, 4).alias("ratio"), ((ratio < 0.5) | (ratio > 2)).alias("noted"))

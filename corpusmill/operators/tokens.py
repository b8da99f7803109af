"""Token accounting, in-order packing and batching of training rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import chat
from corpusmill.operators.folds import walked
from corpusmill.operators.stored import stored

UNLIMITED = 1_000_000


def effective_limit(max_seq_len: int | None, context_length: int | None) -> int:
    return max_seq_len or context_length or UNLIMITED


def token_lengths(examples: DataFrame) -> DataFrame:
    """(row_id, messages) -> turns, total_tokens, seq_len, supervised_len by closed forms over byte lengths."""
    m = F.col("messages")
    return examples.select("row_id", F.size(m).cast("long").alias("turns"), chat.total_tokens(m).alias("total_tokens"), chat.sequence_length(m).alias("seq_len"), chat.supervised_tokens(m).alias("supervised_len"))


def truncation_flags(examples: DataFrame, limit: int, context_length: int | None = None) -> DataFrame:
    """context_overflow, truncated, zero_supervised and prompt_truncated_away under a token limit."""
    m = F.col("messages")
    n = chat.sequence_length(m)
    overflow = (n > context_length) if context_length else F.lit(False)
    return examples.select(
        "row_id", n.alias("seq_len"), overflow.alias("context_overflow"), (n > limit).alias("truncated"), F.lit(limit == 1).alias("zero_supervised"),
        chat.prompt_truncated_away(m, limit).alias("prompt_truncated_away"),
    )


def upper_median_rank() -> Column:
    return F.floor(F.col("n") / 2)


def tail_rank(share: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(F.lit(share) * F.col("n")))


def _keyed(rows: DataFrame, by: str | None) -> tuple[DataFrame, str]:
    return (rows, by) if by else (rows.withColumn("__all", F.lit(0)), "__all")


def _opens(fill: int | None, n: int, limit: int) -> bool:
    """Whether a row of n tokens starts a pack; one without tokens does so only as the first of all."""
    return fill is None or n > 0 and fill > 0 and fill + n > limit


def _transfer(lens: Iterable[int], limit: int) -> tuple[list[int], list[int], list[int], int]:
    """How a stretch of rows acts on the fill it starts with: (above, used, packs, total).

    States 0 and 1 start with no pack and with one that has no token yet. A fill beyond 0 matters only until the first row that
    does not fit, which starts a pack whatever was before: starts above above[k] (and not above an earlier bound) have their first new
    pack at the same row, open packs[k + 2] packs and end with a fill of used[k + 2]. Other starts open none and end fuller by the total. No
    more than limit + 1 bounds differ.
    """
    above: list[int] = []
    used, packs, total = np.array([-1, 0]), np.array([0, 0]), 0
    for n in lens:
        new = (used < 0) | (n > 0) & (used > 0) & (used + n > limit)
        used, packs = np.where(new, n, used + n), packs + new
        if n > 0 and (not above or total < limit):
            above.append(limit - total - n)
            used, packs = np.append(used, n), np.append(packs, 1)
        total += n
    return above, used.tolist(), packs.tolist(), total


def _acted(fill: int | None, above: list[int], used: list[int], packs: list[int], total: int) -> tuple[int, int]:
    """(packs opened, fill at the end) of a stretch that starts with a fill."""
    if fill is None or fill == 0:
        k = 0 if fill is None else 1
        return packs[k], used[k]
    k = next((k for k, bound in enumerate(above) if fill > bound), None)
    return (0, fill + total) if k is None else (packs[k + 2], used[k + 2])


def in_order_packs(lengths: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """(row_id, len[, by]) -> pack_no, offset: rows in order fill packs; one that does not fit starts the next.

    A row over the limit is alone; rows without tokens stay in the pack before them. Rows of a value of `by` are one sequence; packs never mix values. A sequence is cut into ranges:
    each tells how it acts on the fill it starts with, these are put one after the other (at most limit + 1 numbers a range), and
    then each range places its own rows. So neither a hot value nor a table without `by` is one task.
    """
    rows, key = _keyed(lengths, by)
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(key, F.col("row_id").cast("long").alias("row_id"), F.col("len").cast("long").alias("len"))
    dealt = stored(rows.repartitionByRange(key, "row_id").withColumn("__part", F.spark_partition_id()))

    def told(ordered: Iterator[tuple]) -> Iterator[tuple]:
        yield _transfer((r[3] for r in ordered), limit)

    acts = walked(dealt, [key, "__part"], ["row_id"], told, f"{key} {kind}, __part int, above array<long>, used array<long>, packs array<long>, total long", give=64)

    def chained(ordered: Iterator[tuple]) -> Iterator[tuple]:
        fill, done = None, 0
        for _, part, above, used, packs, total in ordered:
            yield part, done, fill
            opened, fill = _acted(fill, above, used, packs, total)
            done += opened

    starts = walked(acts, [key], ["__part"], chained, f"{key} {kind}, __part int, done long, fill long")

    def places(ordered: Iterator[tuple]) -> Iterator[tuple]:
        _, _, _, _, done, fill = next(ordered)
        for _, _, row_id, n, _, _ in ordered:
            if _opens(fill, n, limit):
                done, fill = done + 1, 0
            yield row_id, n, done - 1, fill
            fill += n

    none = F.lit(None).cast("long")
    heads = starts.select(key, "__part", none.alias("row_id"), none.alias("len"), "done", "fill")
    both = dealt.where("row_id is not null").select(key, "__part", "row_id", "len", none.alias("done"), none.alias("fill")).unionByName(heads)
    out = walked(both, [key, "__part"], ["row_id"], places, f"{key} {kind}, __part int, row_id long, len long, pack_no long, offset long").drop("__part")
    return out if by else out.drop(key)


def packed_datums(datums: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """(row_id, datum[, by]) -> a row for each pack: pack_no, row_ids, input_tokens, target_tokens, weights, end to end.

    Packs are those of in_order_packs; each is put together by itself, one at a time in a task. Rows without tokens fill none.
    """
    rows, key = _keyed(datums, by)
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(key, F.col("row_id").cast("long").alias("row_id"), "datum")
    placed = in_order_packs(rows.select(key, "row_id", F.size("datum.input_tokens").alias("len")), limit, key).select(key, "row_id", "pack_no")
    full = rows.join(placed, [key, "row_id"]).select(key, "pack_no", "row_id", "datum.input_tokens", "datum.target_tokens", "datum.weights")

    def pack(ordered: Iterator[tuple]) -> Iterator[tuple]:
        held = ([], [], [], [])
        for _, _, row_id, *arrays in ordered:
            held[0].append(row_id)
            for own, more in zip(held[1:], arrays):
                own.extend(more)
        if held[1]:
            yield held

    out = walked(full, [key, "pack_no"], ["row_id"], pack, f"{key} {kind}, pack_no long, row_ids array<long>, input_tokens array<int>, target_tokens array<int>, weights array<double>", give=64)
    return out if by else out.drop(key)


def collated(packs: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """Packs -> batch_no and datums: `size` packs of each batch in order (the last batch of a value of `by` may have fewer)."""
    keys = [by] if by else []
    datum = F.struct("pack_no", "input_tokens", "target_tokens", "weights")
    return packs.groupBy(*keys, F.floor(F.col("pack_no") / size).alias("batch_no")).agg(F.array_sort(F.collect_list(datum)).alias("datums"))  # at most `size`


def batch_numbers(rows: DataFrame, size: int, order: str, by: str) -> DataFrame:
    """batch_no within each value of `by`: rows in order, `size` at a time."""
    return rows.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def steps_per_epoch(packs: DataFrame, batch_size: int, epochs: int = 1) -> DataFrame:
    """(pack_no) -> n_packs, steps per epoch and in total."""
    n = F.countDistinct("pack_no")
    return packs.agg(n.alias("n_packs"), F.ceil(n / batch_size).alias("steps_per_epoch"), (F.ceil(n / batch_size) * epochs).alias("total_steps"))


def epoch_fraction(rows: DataFrame, by: str, order: str) -> DataFrame:
    """epoch: the share of its value of `by` that is done with a row."""
    whole = Window.partitionBy(by)
    return rows.withColumn("epoch", F.row_number().over(whole.orderBy(order)) / F.count("*").over(whole))

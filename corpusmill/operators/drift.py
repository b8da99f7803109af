"""Distribution drift between a baseline and a candidate: bins, PSI, Jensen-Shannon, Kolmogorov-Smirnov, categories.

Values are counted before anything is ranked or binned, so windows read distinct values, and the edges that travel to
every row are at most num_bins - 1 numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import ranks
from corpusmill.operators.stored import stored
from corpusmill.operators.tokens import tail_rank, upper_median_rank

NUM_BINS, TOP_K, EPSILON, WARN, ERROR, SMALL, UNSEEN = 10, 50, 1e-6, 0.1, 0.25, 30, 0.05
SEVERITIES = ("info", "warning", "error")


def clean(values: DataFrame, column: str) -> DataFrame:
    """The column as double; a row that is null, NaN or infinite fails the job."""
    v = F.col(column).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return values.withColumn(column, F.when(ok, v).otherwise(F.raise_error(F.lit(f"{column} holds a value that is not a finite number")).cast("double")))


def grade(score: Column, warn: float = WARN, error: float = ERROR) -> Column:
    return F.when(score >= error, "error").when(score >= warn, "warning").otherwise("info")


def quantile_edges(values: DataFrame, column: str, num_bins: int = NUM_BINS) -> DataFrame:
    """One row: edges, strictly increasing. Few distinct values give fewer bins; one gives itself; none gives none."""
    seen = stored(ranks.counted(values.select(F.col(column).cast("double").alias("v")), "v"))
    return values.sparkSession.createDataFrame([(_edges(seen, ranks.running_totals(seen, "v", "c"), "c", num_bins),)], "edges array<double>")


def _edges(counted: DataFrame, upto: DataFrame, c: str, num_bins: int) -> list[float]:
    """The edges of values v that occur c times (0: not at all), from their running totals upto_c.

    Only the values at the ranks around an edge are collected: two for each.
    """
    if num_bins < 1:
        raise ValueError("num_bins must be positive")
    size = counted.where(F.col(c) > 0).agg(F.count("*").alias("d"), F.coalesce(F.sum(c), F.lit(0)).alias("n"), F.max("v").alias("top")).first()
    bins = min(num_bins, size.d)
    if size.d <= 1 or bins == 1:
        return [size.top] if size.d == 1 and num_bins > 1 else []
    places = [i * (size.n - 1) / bins for i in range(1, bins)]
    asked = sorted({r for p in places for r in (int(p), min(int(p) + 1, size.n - 1))})
    holds = F.exists(F.array(*map(F.lit, asked)), lambda r: (F.col(f"upto_{c}") - F.col(c) <= r) & (r < F.col(f"upto_{c}")))
    found = sorted((r.upto, r.v) for r in upto.where(holds).select(F.col(f"upto_{c}").alias("upto"), "v").collect())
    at = {r: next(v for upto_, v in found if r < upto_) for r in asked}
    return sorted({at[int(p)] + (p - int(p)) * (at[min(int(p) + 1, size.n - 1)] - at[int(p)]) for p in places})


def bucket_of(value: Column, edges: Column) -> Column:
    """The number of edges below the value: an edge's own value stays left of it."""
    return F.size(F.filter(edges, lambda e: e < value))


def histogram(values: DataFrame, column: str, edges: DataFrame, side: str = "side") -> DataFrame:
    """(side, value) and one row of edges -> side, bucket, count, zeros included."""
    counted = values.groupBy(side, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c")).join(F.broadcast(edges))  # one row
    counts = counted.groupBy(side, bucket_of(F.col("v"), F.col("edges")).alias("bucket")).agg(F.sum("c").alias("count"))
    grid = values.select(side).distinct().join(F.broadcast(edges)).select(side, F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bucket"))
    return grid.join(counts, [side, "bucket"], "left").select(side, "bucket", F.coalesce("count", F.lit(0)).alias("count"))


def _paired(counts: DataFrame, baseline, candidate, side: str, key: str, *by: str) -> DataFrame:
    """(side, key, count) -> [by,] key, b, c: both sides' counts with 0 where a side lacks the key."""
    pick = lambda s: F.coalesce(F.sum(F.when(F.col(side) == s, F.col("count"))), F.lit(0))
    return counts.groupBy(*by, key).agg(pick(baseline).alias("b"), pick(candidate).alias("c"))


def divergences(paired: DataFrame, *by: str) -> DataFrame:
    """(b, c) counts over the same keys -> psi, jsd.

    Shares are floored at EPSILON; PSI takes them so, JSD scales them to one again. One side empty: infinite PSI and JSD 1;
    both empty: 0.
    """
    totals = paired.groupBy(*by).agg(F.sum("b").alias("tb"), F.sum("c").alias("tc"), F.count("*").alias("keys"))
    joined = paired.join(totals, list(by)) if by else paired.join(F.broadcast(totals))
    share = lambda x, t: F.greatest(F.when(F.col(t) > 0, F.col(x) / F.col(t)).otherwise(0.0), F.lit(EPSILON))
    floored = joined.select(*by, "tb", "tc", share("b", "tb").alias("p"), share("c", "tc").alias("q"))
    sums = floored.groupBy(*by).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    scaled = floored.join(sums, list(by)) if by else floored.join(F.broadcast(sums))
    p, q = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    m = (p + q) / 2
    out = scaled.groupBy(*by).agg(
        F.max("tb").alias("tb"), F.max("tc").alias("tc"), F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"),
        (F.sum(p * F.log2(p / m)) / 2 + F.sum(q * F.log2(q / m)) / 2).alias("jsd"),
    )
    empty = (F.col("tb") == 0) | (F.col("tc") == 0)
    both = (F.col("tb") == 0) & (F.col("tc") == 0)
    psi = F.when(both, 0.0).when(empty, F.lit(math.inf)).otherwise(F.col("psi"))
    jsd = F.when(both, 0.0).when(empty, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("jsd"))))
    return out.select(*by, psi.alias("psi"), jsd.alias("jsd"))


def ks(values: DataFrame, column: str, baseline, candidate, side: str = "side") -> DataFrame:
    """One row: the largest gap between both empirical distributions; 1 if one side is empty, 0 if both are."""
    paired = stored(_sides(values, column, baseline, candidate, side))
    return _ks(paired, ranks.running_totals(paired, "v", "b", "c"))


def _sides(values: DataFrame, column: str, baseline, candidate, side: str) -> DataFrame:
    """(side, value) -> v, b, c: how often each value occurs on both sides; one pass, combined before the shuffle."""
    rows = values.where(F.col(side).isin(baseline, candidate)).groupBy(F.col(column).cast("double").alias("v"))
    return rows.agg(F.count(F.when(F.col(side) == baseline, 1)).alias("b"), F.count(F.when(F.col(side) == candidate, 1)).alias("c"))


def _ks(paired: DataFrame, upto: DataFrame) -> DataFrame:
    totals = paired.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("tb"), F.coalesce(F.sum("c"), F.lit(0)).alias("tc"))
    steps = upto.select(F.col("upto_b").alias("fb"), F.col("upto_c").alias("fc")).join(F.broadcast(totals))  # one row
    worst = steps.agg(F.max(F.abs(F.try_divide("fb", "tb") - F.try_divide("fc", "tc"))).alias("gap"))
    value = F.when((F.col("tb") == 0) & (F.col("tc") == 0), 0.0).when((F.col("tb") == 0) | (F.col("tc") == 0), 1.0).otherwise(F.col("gap"))
    return totals.join(worst).select(value.alias("ks"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, p50, p95, max; p50 is the upper median, p95 the value at rank 0.95 n."""
    picks = ranks.pick(values, column, {"p50": upper_median_rank(), "p95": tail_rank(0.95), "max": F.col("n") - 1})
    return picks.join(values.agg(F.round(F.avg(column), 4).alias("mean"))).select("n", "mean", "p50", "p95", "max")


def compare_distributions(values: DataFrame, column: str, baseline, candidate, side: str = "side", feature: str | None = None, num_bins: int = NUM_BINS) -> DataFrame:
    """(side, value) -> feature, psi, jsd, ks, severity, detail. Bins come from the baseline; under 30 rows on a side an error is a warning."""
    paired = stored(_sides(values, column, baseline, candidate, side))  # the input is read once; all else comes from this table
    upto = ranks.running_totals(paired, "v", "b", "c")
    edges = _edges(paired, upto, "b", num_bins)
    bucket = bucket_of(F.col("v"), F.array(*map(F.lit, edges)).cast("array<double>"))
    bins = paired.groupBy(bucket.alias("bucket")).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    grid = values.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    counts = grid.join(bins, "bucket", "left").select(F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("c", F.lit(0)).alias("c"))
    sizes = paired.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("nb"), F.coalesce(F.sum("c"), F.lit(0)).alias("nc"))
    row = divergences(counts).join(_ks(paired, upto)).join(sizes)
    small, empty = F.least("nb", "nc") < SMALL, F.least("nb", "nc") == 0
    graded = grade(F.col("psi"))
    severity = F.when(empty, "warning").when(small & (graded == "error"), "warning").otherwise(graded)
    detail = F.when(empty, "one side is empty").when(small, "small sample").otherwise("")
    return row.select(F.lit(feature or column).alias("feature"), F.round("psi", 6).alias("psi"), F.round("jsd", 6).alias("jsd"), F.round(F.when(~empty, F.col("ks")), 6).alias("ks"), severity.alias("severity"), detail.alias("detail"))


def category_counts(rows: DataFrame, key: str, side: str = "side") -> DataFrame:
    """side, key, count, first: the lowest position of the key, if rows have one."""
    first = F.min("position") if "position" in rows.columns else F.lit(0)
    return rows.groupBy(side, F.col(key).alias("key")).agg(F.count("*").alias("count"), first.alias("first"))


def compare_categorical(rows: DataFrame, key: str, baseline, candidate, side: str = "side", feature: str | None = None, top_k: int = TOP_K) -> DataFrame:
    """(side, key[, position]) -> feature, psi, jsd, unseen, severity, detail over the baseline's top_k keys and one bucket for all others.

    Equal counts are ranked by first position, then by key. unseen is the candidate's share of keys that the baseline lacks.
    """
    counts = category_counts(rows, key, side)
    wide = counts.groupBy("key").agg(
        F.coalesce(F.sum(F.when(F.col(side) == baseline, F.col("count"))), F.lit(0)).alias("b"), F.coalesce(F.sum(F.when(F.col(side) == candidate, F.col("count"))), F.lit(0)).alias("c"), F.min(F.when(F.col(side) == baseline, F.col("first"))).alias("first")
    )
    top = wide.where("b > 0").orderBy(F.desc("b"), "first", "key").limit(top_k).select("key", "b", "c")
    totals = wide.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("tb"), F.coalesce(F.sum("c"), F.lit(0)).alias("tc"), F.coalesce(F.sum(F.when(F.col("b") == 0, F.col("c"))), F.lit(0)).alias("new"))
    inside = top.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("sb"), F.coalesce(F.sum("c"), F.lit(0)).alias("sc"))
    other = totals.join(inside).select(F.lit(None).cast(top.schema["key"].dataType).alias("key"), (F.col("tb") - F.col("sb")).alias("b"), (F.col("tc") - F.col("sc")).alias("c"))
    row = divergences(top.unionByName(other)).join(totals)
    unseen = F.when(F.col("tc") > 0, F.col("new") / F.col("tc")).otherwise(0.0)
    detail = F.when(unseen > UNSEEN, F.format_string("%.1f%% of the candidate is unseen in the baseline", unseen * 100)).otherwise("")
    return row.select(F.lit(feature or key).alias("feature"), F.round("psi", 6).alias("psi"), F.round("jsd", 6).alias("jsd"), F.round(unseen, 6).alias("unseen"), grade(F.col("psi")).alias("severity"), detail.alias("detail"))

"""Running totals and exact ranks over a whole table without a one-task window.

Values are dealt to ranges whose borders are approximate quantiles. Each range is summed, the sums of the ranges before
it (a few rows) are added to the running totals within the range. The result is exact wherever the borders fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.stored import stored


def counted(values: DataFrame, column: str) -> DataFrame:
    """Distinct values v with their number of rows c; nulls are left out."""
    return values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))


def running_totals(rows: DataFrame, key: str, *sums: str, ranges: int | None = None) -> DataFrame:
    """rows with upto_<sum> for each column of sums: its total over all rows whose key is no greater. Keys are distinct numbers.

    There are as many ranges as the session has shuffle partitions, unless told.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = sorted(set(rows.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b < F.col(key))) if borders else F.lit(0)
    dealt = rows.withColumn("__range", place)
    totals = dealt.groupBy("__range").agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over at most `ranges` rows
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__{s}").over(ahead), F.lit(0)).alias(f"__{s}") for s in sums))
    within = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.select("*", *(F.sum(s).over(within).alias(f"upto_{s}") for s in sums)).join(F.broadcast(offsets), "__range")
    return placed.select(*rows.columns, *((F.col(f"upto_{s}") + F.col(f"__{s}")).alias(f"upto_{s}") for s in sums))


def pick(values: DataFrame, column: str, ranks: dict[str, Column]) -> DataFrame:
    """One row: n, and for each name the value at a 0-based rank, an expression of n."""
    seen = counted(values, column)
    upto = running_totals(seen, "v", "c")
    total = seen.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    ranked = upto.join(F.broadcast(total))  # one row
    at = lambda rank: F.max(F.when((rank >= F.col("upto_c") - F.col("c")) & (rank < F.col("upto_c")), F.col("v")))
    return total.join(ranked.agg(*(at(r).alias(k) for k, r in ranks.items())))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """rows with the 0-based place in `order` among those with the same `by`, which holds no nulls; ties as they come.

    Rows are dealt to ranges of by and order (so a hot value of by is cut as well) and written; a place is the number of
    rows in ranges before and the place in the range.
    """
    dealt = stored(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)) - 1
    placed = dealt.withColumn("__k", within).join(offsets, [*by, "__part"])
    return placed.select(*rows.columns, (F.col("__ahead") + F.col("__k")).cast("long").alias(name))

"""Functions by name in SQL against the column functions."""

import random

from pyspark.sql import functions as F

from corpusmill.functions import rewards, sql, text
from corpusmill.operators import sharding, tokens


def test_functions_by_name_equal_the_column_forms(spark):
    spec = sharding.ShardSpec(world_size=3, num_buckets=64, seed=5)
    assert set(sql.register(spark, spec)) == {"length_target", "numeric_match", "nonempty", "redact", "owner_of", "pack_rows"}
    rng = random.Random(2)
    parts = ["4111-1111-1111-1111", "1234567812345678", "a@b.com", "10.0.0.1", "415-555-0100", "x", " ", "it's", "\\d", "$1", "7.5", "\n"]
    rows = [("".join(rng.choices(parts, k=6)), "".join(rng.choices(parts, k=6))) for _ in range(100)]
    frame = spark.createDataFrame(rows, "p string, r string")
    named = spark.sql("select length_target(p, r) a, numeric_match(p, r) b, nonempty(r, r) c, redact(p) d, owner_of(p) e from {frame}", frame=frame).collect()
    columns = [*(rewards.reward(n)(F.col("p"), F.col("r")) for n in ("length_target", "numeric_match")), rewards.reward("nonempty")(F.col("r"), F.col("r")), text.redacted(F.col("p")), spec.owner_of(F.col("p"))]
    assert sorted(map(tuple, named)) == sorted(map(tuple, frame.select(*columns).collect()))


def test_packs_by_a_table_function(spark):
    sql.register(spark)
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, rng.choice([0, 3, 50, 120]), i % 3) for i in range(200)], "row_id long, len long, part long")
    rows.createOrReplaceTempView("pack_input")
    got = spark.sql("select * from pack_rows(100, table(pack_input) partition by part order by row_id)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, tokens.in_order_packs(rows, 100, by="part").select("row_id", "len", "pack_no", "offset").collect()))


def test_any_expression_is_a_shard_key(spark):
    spec = sharding.ShardSpec(2, num_buckets=8)
    rows = spark.range(40)
    by_name = sharding.epoch_order(rows.selectExpr("concat('k', id) as key"), "key", spec, 1)
    by_column = sharding.epoch_order(rows, F.concat(F.lit("k"), F.col("id")), spec, 1)
    assert sorted(map(tuple, by_name.collect())) == sorted(map(tuple, by_column.collect()))

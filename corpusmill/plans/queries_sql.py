"""The library's functions called from SQL, each against the SQL of the query that uses the column form."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import chat, sql
from corpusmill.operators import sharding, tokens
from corpusmill.plans import queries_corpus, queries_text  # noqa: F401 (their SQL is used below)
from corpusmill.plans.catalog import ORACLES, query
from corpusmill.plans.views import dirty, examples, private, table

_SQL_SPEC = sharding.ShardSpec(world_size=8)


@query(ORACLES["reward_heuristics"])
def sql_rewards(spark, sf_dir):
    """The rewards called by name from SQL."""
    sql.register(spark, _SQL_SPEC)
    m = F.col("messages")
    pairs = dirty(spark, sf_dir).select("row_id", chat.prompt_text(m).alias("p"), chat.response_text(m).alias("r"))
    return spark.sql("select row_id, round(length_target(p, r), 6) as length_target, numeric_match(p, r) as numeric_match, nonempty(p, r) as nonempty from {pairs}", pairs=pairs)


@query(ORACLES["redact_documents"])
def sql_redacted(spark, sf_dir):
    """Redaction called from SQL."""
    sql.register(spark, _SQL_SPEC, ascii=True)
    return spark.sql("select doc_id, redact(text) as text from {docs}", docs=private(spark, sf_dir))


@query(ORACLES["shard_assignment"].replace("select doc_id, bucket, owner from owned", "select doc_id, owner from owned"))
def sql_owners(spark, sf_dir):
    """Owners called from SQL."""
    sql.register(spark, _SQL_SPEC)
    return spark.sql("select doc_id, owner_of(cast(doc_id as string)) as owner from {docs}", docs=table(spark, sf_dir, "documents"))


@query(ORACLES["pack_sequences"].replace("select part, row_id, len", "select row_id, len"))
def sql_packs(spark, sf_dir):
    """In-order packs by a table function, a part of the rows at a time."""
    sql.register(spark, _SQL_SPEC)
    lens = tokens.token_lengths(examples(spark, sf_dir)).select("row_id", F.col("seq_len").alias("len"), (F.col("row_id") % 4).alias("part"))
    lens.createOrReplaceTempView("corpusmill_lens")
    return spark.sql("select * from pack_rows(4096, table(corpusmill_lens) partition by part order by row_id)")

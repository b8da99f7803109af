"""Queries over whole corpora: duplicates, contamination, shards, epochs, mixtures, packs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import chat, text
from corpusmill.operators import dedup, sharding, tokens
from corpusmill.operators.band_index import BandIndex
from corpusmill.operators.stored import shared_dir, stored
from corpusmill.plans import validate
from corpusmill.plans.catalog import ORACLES, query
from corpusmill.plans.queries_text import _NORM, LEN_SQL, datum_sql, told_ids, told_weights
from corpusmill.plans.views import CHAT_SQL, DIRTY_SQL, dirty, examples, table
from corpusmill.sources import files
from corpusmill.streaming import epochs

#: All pairs by Jaccard, through the shingles they share: texts t(id, norm) -> sim(a, b, jaccard, both orders).
_JACCARD = """shingled as (select id, unnest(case when length(norm) <= 5 then [norm] else list_distinct(list_transform(range(1, length(norm) - 3), lambda i: substr(norm, i, 5))) end) as g from t where norm <> ''),
    sized as (select id, g, count(*) over (partition by id) as n from shingled),
    common as (select a.id as x, b.id as y, a.n as nx, b.n as ny, count(*) as c from sized a join sized b on a.g = b.g and a.id < b.id and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) group by all),
    alike as (select x, y, c / (nx + ny - c) as jaccard from common where c / (nx + ny - c) >= 0.85), sim as (select x as a, y as b, jaccard from alike union all select y, x, jaccard from alike)"""
_DOCS = f"n as (select doc_id as row_id, {_NORM.format('text')} as norm from documents)"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), text.normalized(F.col("text")).alias("norm"))


def _keyed(spark, sf_dir):
    m = F.col("messages")
    return dirty(spark, sf_dir).select("row_id", text.normalized(chat.prompt_text(m)).alias("prompt_key"), text.normalized(chat.response_text(m)).alias("response_key"))


_KEYED_SQL = f"{DIRTY_SQL}, k as (select row_id, {_NORM.format('prompt')} as p, {_NORM.format('response')} as r from texts)"


@query(f"with {_DOCS}, f as (select *, min(row_id) over (partition by norm) as first_id from n) select row_id, first_id from f where row_id > first_id")
def exact_duplicates(spark, sf_dir):
    return dedup.exact_duplicates(_documents(spark, sf_dir), "norm")


@query(f"with {_KEYED_SQL}, f as (select *, min(row_id) over (partition by p, r) as first_id from k) select row_id, first_id from f where row_id > first_id")
def exact_duplicate_examples(spark, sf_dir):
    return dedup.exact_duplicates(_keyed(spark, sf_dir), "prompt_key", "response_key")


@query(f"with {_KEYED_SQL}, g as (select p, r, min(row_id) as row_id from k where p <> '' group by p, r), f as (select *, min(row_id) over (partition by p) as first_id from g) select row_id, first_id from f where row_id > first_id")
def label_conflicts(spark, sf_dir):
    return dedup.label_conflicts(_keyed(spark, sf_dir))


@query(f"""with {_DOCS}, t as (select min(row_id) as id, norm from n group by norm), {_JACCARD}
    select a as row_id, b as match_id, round(jaccard, 6) as jaccard from sim where b < a qualify row_number() over (partition by a order by jaccard desc, b) = 1""")
def near_duplicates(spark, sf_dir):
    return dedup.near_duplicates(_documents(spark, sf_dir))


@query(f"""with {_DOCS}, t as (select row_id as id, norm from n), {_JACCARD}, asked as (select row_id, norm from n where row_id % 3 = 0 and norm <> ''), e as (select q.row_id, min(r.row_id) as id from asked q join n r on r.norm = q.norm and r.row_id % 3 <> 0 group by q.row_id),
    firsts as (select min(row_id) as id from n where row_id % 3 <> 0 group by norm), near as (select a, b, jaccard from sim where a in (select row_id from asked) and a not in (select row_id from e) and b in (select id from firsts))
    select a as row_id, b as match_id, round(jaccard, 6) as jaccard, (row_number() over (partition by a order by round(jaccard, 9) desc, b))::int as rank from near""")
def ranked_hits(spark, sf_dir):
    """For a third of the documents all similar texts among the others, the most similar first; equal texts are left to the exact lookup."""
    docs = _documents(spark, sf_dir)
    asked, known = docs.where("row_id % 3 = 0 and norm <> ''"), docs.where("row_id % 3 <> 0")
    firsts = stored(dedup._firsts(known))
    rest = asked.withColumn("key", dedup.digest("norm")).join(firsts.select("key"), "key", "left_anti")
    hits = dedup.similar(dedup.sketches(rest.select("row_id", "norm")), dedup.sketches(firsts))
    found = dedup.ranked_hits(hits.withColumn("jaccard", F.round("jaccard", 9)))
    return found.select(F.col("left_id").alias("row_id"), F.col("right_id").alias("match_id"), F.round("jaccard", 6).alias("jaccard"), "rank")


@query(f"""with {_DOCS}, o as (select row_id, norm, first_value(row_id) over (partition by norm order by row_id % 4, row_id) as first_id from n where norm <> ''),
    t as (select row_id as id, norm from o where row_id = first_id), {_JACCARD}
    select row_id, first_id as match_id, 1.0::double as jaccard, 1::int as rank from o where row_id <> first_id
    union all
    select a, b, round(jaccard, 6), (row_number() over (partition by a order by jaccard desc, b))::int from sim where (b % 4, b) < (a % 4, a)""")
def index_batches(spark, sf_dir):
    """Documents added to a growing index in four batches: each row's matches among all rows before it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    index = BandIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    hits = [stored(index.add(docs.where(F.col("row_id") % 4 == b), b)) for b in range(4)]
    return reduce(DataFrame.unionByName, hits).withColumn("jaccard", F.round("jaccard", 6))


_CONTAMINATED = f"""{_KEYED_SQL}, b as (select row_id, {_NORM.format("prompt || chr(10) || response")} as norm from texts), train as (select norm, min(row_id) as id from b where row_id >= 1000000000 and norm <> '' group by norm),
    asked as (select row_id as id, norm from b where row_id < 1000000000 and norm <> ''), exact as (select a.id as row_id, r.id as match_id, 1.0::double as jaccard from asked a join train r using (norm)), t as (select id, norm from train union all select id, norm from asked), {_JACCARD},
    near as (select a as row_id, b as match_id, jaccard from sim where a in (select id from asked) and a not in (select row_id from exact) and b in (select id from train) qualify row_number() over (partition by a order by round(jaccard, 9) desc, b) = 1),
    contaminated as (select * from exact union all select * from near)"""


def _split(spark, sf_dir):
    """The clean examples as an evaluation set, their copies with planted defects as the training set."""
    k = validate.keyed(dirty(spark, sf_dir)).select("row_id", "norm")
    return k.where("row_id < 1000000000"), k.where("row_id >= 1000000000")


@query(f"with {_CONTAMINATED} select row_id, match_id, round(jaccard, 6) as jaccard from contaminated")
def eval_contamination(spark, sf_dir):
    return dedup.contamination(*_split(spark, sf_dir))


@query(f"with {_CONTAMINATED} select count(distinct row_id)::bigint as contaminated, (select count(*) from b where row_id < 1000000000)::bigint as evaluated, round(100.0 * count(distinct row_id) / (select count(*) from b where row_id < 1000000000), 1) as percent from contaminated")
def contamination_percent(spark, sf_dir):
    evaluation, training = _split(spark, sf_dir)
    return dedup.contamination_share(dedup.contamination(evaluation, training), evaluation)


@query(f"""with {_DOCS}, items as (select item_id as id, text from benchmark union all select 1000000000 + doc_id, text || case when doc_id % 200 = 0 then ' the end' else '' end from documents where doc_id % 100 = 0),
    q as (select id, {_NORM.format("text")} as norm from items where {_NORM.format("text")} <> ''), train as (select norm, min(row_id) as id from n where norm <> '' group by norm),
    exact as (select q.id as row_id, r.id as match_id, 1.0::double as jaccard from q join train r using (norm)), t as (select -1 - id as id, norm from q union all select id, norm from train), {_JACCARD},
    near as (select -1 - a as row_id, b as match_id, jaccard from sim where a < 0 and b >= 0 and -1 - a not in (select row_id from exact) qualify row_number() over (partition by a order by round(jaccard, 9) desc, b) = 1)
    select row_id, match_id, round(jaccard, 6) as jaccard from (select * from exact union all select * from near)""")
def benchmark_contamination(spark, sf_dir):
    """The whole benchmark, and every hundredth document as a leaked item (half of them changed), as an evaluation set against all documents."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    leaked = docs.select((F.lit(1_000_000_000) + F.col("doc_id")).alias("row_id"), F.concat("text", F.when(F.col("doc_id") % 200 == 0, " the end").otherwise("")).alias("text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text").unionByName(leaked)
    return dedup.contamination(items.select("row_id", text.normalized(F.col("text")).alias("norm")), _documents(spark, sf_dir))


@query(f"""with {_DOCS}, f as (select *, min(row_id) over (partition by norm) as first_id from n), d as (select row_id from f where row_id > first_id)
    select count(*)::bigint as duplicates, (select count(*) from n)::bigint as n, round(count(*) / (select count(*) from n), 6) as duplicate_rate, case when count(*) >= 0.2 * (select count(*) from n) then 'error' else 'warning' end as severity from d""")
def duplicate_rate(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    extra = dedup.exact_duplicates(docs, "norm").agg(F.count("*").alias("duplicates"))
    n = docs.agg(F.count("*").alias("n"))
    return extra.join(n).select("duplicates", "n", F.round(F.col("duplicates") / F.col("n"), 6).alias("duplicate_rate"), F.when(F.col("duplicates") >= 0.2 * F.col("n"), "error").otherwise("warning").alias("severity"))


@query(f"""with {_KEYED_SQL} select count(*)::bigint as n, count(distinct p)::bigint as unique_prompts, count(distinct r)::bigint as unique_responses, count(distinct (p, r))::bigint as unique_pairs from k""")
def distinct_counts(spark, sf_dir):
    return validate.distinct_keys(_keyed(spark, sf_dir)).select("n", "unique_prompts", "unique_responses", "unique_pairs")


_SPEC = sharding.ShardSpec(world_size=8)


def _digits(*parts: str) -> str:
    """`sharding.digits` as SQL."""
    return f"('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 13))::bigint"


def _owned_sql(world: int, name: str = "owned") -> str:
    """owned(doc_id, bucket, owner): of all ranks' straws for a bucket, digests of seed, rank and bucket, the greatest wins."""
    return f"""straws_{name} as (select b as bucket, arg_max(r, sha256('0/' || r || '/' || b)) as owner from range(1024) as t(b), range({world}) as u(r) group by b),
    {name} as (select doc_id, ({_digits("0", "doc_id")} % 1024)::int as bucket, owner::int as owner from documents join straws_{name} on bucket = {_digits("0", "doc_id")} % 1024)"""


@query(f"with {_owned_sql(8)} select doc_id, bucket, owner from owned")
def shard_assignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", _SPEC.bucket_of(F.col("doc_id")).alias("bucket"), _SPEC.owner_of(F.col("doc_id")).alias("owner"))


@query("select count(*)::bigint as n, count(distinct doc_id)::bigint as placed, true as within_world from documents")
def shard_coverage(spark, sf_dir):
    """Every document has one owner, within the world."""
    placed = shard_assignment(spark, sf_dir)
    return placed.agg(F.count("*").alias("n"), F.countDistinct("doc_id", "owner").alias("placed"), F.every(F.col("owner").between(0, 7)).alias("within_world"))


@query(f"""with {_owned_sql(8)} select doc_id, owner as rank, e::int as epoch, (row_number() over (partition by owner, e order by {_digits("3", "e", "doc_id")}, doc_id) - 1)::bigint as index from owned, range(2) as t(e)""")
def epoch_order(spark, sf_dir):
    return sharding.epoch_order(table(spark, sf_dir, "documents"), "doc_id", _SPEC, epochs=2, seed=3)


@query("select count(*)::bigint * 2 as reads, 0::bigint as repeats, count(distinct doc_id)::bigint as documents from documents")
def cursor_resume(spark, sf_dir):
    """What all ranks read up to a cursor and after it: two epochs, no gap, no repeat."""
    order = stored(epoch_order(spark, sf_dir))
    before = order.where("epoch = 0 and index < 40")
    after = None
    for rank in range(8):
        part = sharding.resume(order, sharding.Cursor(0, 40, 8, rank))
        after = part if after is None else after.unionByName(part)
    n = F.countDistinct("doc_id", "epoch", "rank")
    return before.unionByName(after).agg(F.count("*").alias("reads"), (F.count("*") - n).alias("repeats"), F.countDistinct("doc_id").alias("documents"))


@query("select e.k as epoch, doc_id from documents, range(2) as e(k)")
def epoch_stream(spark, sf_dir):
    """Two ranks read two epochs as streams, two batches an epoch, each stopped after the second batch and started again."""
    spec = sharding.ShardSpec(world_size=2)
    base = f"{shared_dir(spark)}/epochs-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    epochs.write_order(sharding.epoch_order(docs, "doc_id", spec, epochs=2, seed=3), f"{base}/order")
    size = docs.count() // 3
    for rank in (0, 1):
        put = lambda rows, batch_id, rank=rank: rows.select("epoch", "doc_id").write.mode("overwrite").parquet(f"{base}/read/{rank}-{batch_id}")
        for batches in (2, None):
            epochs.follow(spark, f"{base}/order", spec.sibling(rank), put, f"{base}/cursor-{rank}", size, 2, batches)
    return spark.read.schema("epoch int, doc_id long").option("recursiveFileLookup", True).parquet(f"{base}/read")


@query("select e.k as epoch, count(*)::bigint as rows, true as dense, true as shuffled from documents, range(2) as e(k) group by e.k")
def epoch_positions(spark, sf_dir):
    """Each epoch's order: every rank's indices run from 0 without a gap, and the second epoch's order is another."""
    order = stored(epoch_order(spark, sf_dir))
    by_rank = order.groupBy("epoch", "rank").agg(F.count("*").alias("n"), F.min("index").alias("a"), F.max("index").alias("z"), F.countDistinct("index").alias("d"), F.corr("index", "doc_id").alias("c"))
    dense = (F.col("a") == 0) & (F.col("z") == F.col("n") - 1) & (F.col("d") == F.col("n"))
    return by_rank.groupBy("epoch").agg(F.sum("n").alias("rows"), F.every(dense).alias("dense"), (F.avg(F.abs("c")) < 0.5).alias("shuffled"))


@query("select count(*)::bigint as n, 8::bigint as ranks, true as balanced, true as moved_few, true as only_to_new from documents")
def reshard_moves(spark, sf_dir):
    """From eight ranks to nine: rows move to the new rank only, about a ninth of them."""
    wider = sharding.ShardSpec(world_size=9)
    key = F.col("doc_id")
    moved = table(spark, sf_dir, "documents").select(_SPEC.owner_of(key).alias("a"), wider.owner_of(key).alias("b"))
    sizes = moved.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("moved"), F.count_if((F.col("a") != F.col("b")) & (F.col("b") != 8)).alias("stray"))
    total, shifted = F.sum("n"), F.sum("moved")
    return sizes.agg(total.alias("n"), F.count("*").alias("ranks"), (F.min("n") > 0.5 * F.avg("n")).alias("balanced"), shifted.between(0.05 * total, 0.2 * total).alias("moved_few"), (F.sum("stray") == 0).alias("only_to_new"))


_WEIGHTS = {"en": 0.7, "de": 0.2, "fr": 0.1, "es": 0.0}


@query("""with w as (select lang as source, count(*)::double as w from documents where lang is not null group by lang), p as (select temperature, source, pow(w, 1 / temperature) as r from w, (values (1.0::double), (2.0), (4.0)) as t(temperature))
    select temperature, source, round(r / sum(r) over (partition by temperature), 6) as probability from p""")
def mixture_probabilities(spark, sf_dir):
    """Languages weighed by their documents, at three temperatures."""
    counts = table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").cast("double").alias("n"))
    weights = {r.lang: r.n for r in counts.collect()}  # a row for each language
    rows = [(t, k, v) for t in (1.0, 2.0, 4.0) for k, v in (sharding.mixture_probabilities(weights, t).items() if weights else ())]
    return spark.createDataFrame(rows, "temperature double, source string, probability double").withColumn("probability", F.round("probability", 6))


_MIX = f"""rows as (select lang as source, doc_id as key, row_number() over (partition by lang order by doc_id) - 1 as position, count(*) over (partition by lang) as size from documents where lang in ('en', 'de', 'fr')),
    u as (select i as draw, {_digits("4", "i")} / 4503599627370496.0::double as u from range(2000) as t(i)),
    drawn as (select draw, case when u < 0.7::double / 1.0::double then 'en' when u < 0.9::double then 'de' else 'fr' end as source from u),
    turn as (select *, row_number() over (partition by source order by draw) - 1 as k from drawn)"""
_CYCLED = f"{_MIX}, cycled as (select draw, source, position, key from turn join rows using (source) where position = k % size)"


def _mixed(spark, sf_dir, policy):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("key"))
    return sharding.mixture(docs, 2000, _WEIGHTS, seed=4, policy=policy)


@query(f"with {_CYCLED} select * from cycled")
def mixture_sample(spark, sf_dir):
    return _mixed(spark, sf_dir, "cycle")


@query(f"""with {_MIX}, stop as (select coalesce(min(draw), 2000) as last_draw from turn join (select distinct source, size from rows) using (source) where k >= size)
    select draw, source, position, key from turn join rows using (source) where position = k and draw < (select last_draw from stop)""")
def mixture_stopped(spark, sf_dir):
    """Up to the first draw of a source that has no row left."""
    return _mixed(spark, sf_dir, "stop")


@query(f"""with recursive {_MIX}, sizes as (select count(*) filter (where source = 'en') as e, count(*) filter (where source = 'de') as d, count(*) filter (where source = 'fr') as f from rows),
    walk as (select -1::bigint as draw, 0::bigint as ne, 0::bigint as nd, 0::bigint as nf, 0.7::double as we, 0.2::double as wd, 0.1::double as wf, null::varchar as source, null::bigint as position
        union all
        select draw, ne + (s = 'en' and ne < e)::int, nd + (s = 'de' and nd < d)::int, nf + (s = 'fr' and nf < f)::int, case when s = 'en' and ne >= e then 0 else we end, case when s = 'de' and nd >= d then 0 else wd end, case when s = 'fr' and nf >= f then 0 else wf end,
            case when case s when 'en' then ne < e when 'de' then nd < d else nf < f end then s end, case s when 'en' then ne when 'de' then nd else nf end
        from (select u.draw, w.ne, w.nd, w.nf, w.we, w.wd, w.wf, case when u < we / (we + wd + wf) then 'en' when u < we / (we + wd + wf) + wd / (we + wd + wf) or wf = 0 then case when wd = 0 then 'en' else 'de' end else 'fr' end as s
            from walk w join u on u.draw = w.draw + 1 where we + wd + wf > 0) cross join sizes)
    select draw, source, position, key from walk join rows using (source, position)""")
def mixture_drained(spark, sf_dir):
    """A source without rows drops out and the others go on."""
    return _mixed(spark, sf_dir, "drain")


@query("select source, true as near_weight, true as in_order from (values ('en'), ('de'), ('fr')) as t(source)")
def mixture_properties(spark, sf_dir):
    """Draws of each source: about as many as its weight says, and positions that run through its rows in order, again and again."""
    drawn = mixture_sample(spark, sf_dir)
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source")).agg(F.count("*").alias("size"))
    k = F.row_number().over(Window.partitionBy("source").orderBy("draw")) - 1
    placed = drawn.withColumn("k", k).join(sizes, "source")
    told = placed.groupBy("source").agg(F.count("*").alias("n"), F.every(F.col("position") == F.col("k") % F.col("size")).alias("in_order"))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in _WEIGHTS.items() for x in kv)), F.col("source"))
    return told.select("source", (F.abs(F.col("n") / 2000 - weight) < 0.05).alias("near_weight"), "in_order")


@query(f"with {_CYCLED} select source, count(*)::bigint as emitted, round(count(*) / sum(count(*)) over (), 6) as share from cycled group by source")
def mixture_shares(spark, sf_dir):
    return sharding.realized_proportions(mixture_sample(spark, sf_dir))


@query(f"""with recursive {LEN_SQL}, o as (select row_id, seq_len as len, row_number() over (partition by row_id % 4 order by row_id) as k, row_id % 4 as part from lens),
    walk as (select part, k, row_id, len, 0::bigint as pack_no, 0::bigint as "offset" from o where k = 1
        union all select o.part, o.k, o.row_id, o.len, case when w."offset" + w.len + o.len <= 4096 then w.pack_no else w.pack_no + 1 end, case when w."offset" + w.len + o.len <= 4096 then w."offset" + w.len else 0 end
        from walk w join o on o.part = w.part and o.k = w.k + 1)
    select part, row_id, len, pack_no, "offset" from walk""")
def pack_sequences(spark, sf_dir):
    lens = tokens.token_lengths(examples(spark, sf_dir)).select("row_id", F.col("seq_len").alias("len"), (F.col("row_id") % 4).alias("part"))
    return tokens.in_order_packs(lens, 4096, by="part")


_PACK_WALK = """o as (select row_id, seq_len as len, row_number() over (partition by row_id % 4 order by row_id) as k, row_id % 4 as part from lens),
    walk as (select part, k, row_id, len, 0::bigint as pack_no, 0::bigint as used from o where k = 1
        union all select o.part, o.k, o.row_id, o.len, case when w.used + w.len + o.len <= 4096 then w.pack_no else w.pack_no + 1 end, case when w.used + w.len + o.len <= 4096 then w.used + w.len else 0 end from walk w join o on o.part = w.part and o.k = w.k + 1),
    packed as (select part, pack_no, string_agg(inputs, '' order by row_id) as inputs, string_agg(weights, '' order by row_id) as weights, count(*) as n from walk join datums using (row_id) group by part, pack_no)"""
_PACKED_SQL = f"{LEN_SQL}, datums as (select row_id, {datum_sql('messages', 1_000_000)} from lens), {_PACK_WALK}"


def _packs(spark, sf_dir):
    rows = examples(spark, sf_dir).select("row_id", (F.col("row_id") % 4).alias("part"), chat.supervised_datum(F.col("messages"), 1_000_000).alias("datum"))
    return tokens.packed_datums(rows, 4096, by="part")


@query(f"with recursive {_PACKED_SQL} select part, pack_no, n::bigint as n_rows, md5(inputs) as inputs, md5(weights) as weights from packed")
def packed_arrays(spark, sf_dir):
    """The packs' token and weight arrays, end to end."""
    return _packs(spark, sf_dir).select("part", "pack_no", F.size("row_ids").cast("long").alias("n_rows"), F.md5(told_ids(F.col("input_tokens"))).alias("inputs"), F.md5(told_weights(F.col("weights"))).alias("weights"))


@query(f"with recursive {_PACKED_SQL} select part, (pack_no // 3)::bigint as batch_no, count(*)::bigint as packs, md5(string_agg(inputs, '|' order by pack_no)) as inputs, sum(strlen(weights))::bigint as tokens from packed group by all")
def collated_batches(spark, sf_dir):
    """Batches of three packs with their arrays."""
    b = tokens.collated(_packs(spark, sf_dir), 3, by="part")
    d = F.col("datums")
    return b.select("part", "batch_no", F.size(d).cast("long").alias("packs"), F.md5(F.array_join(F.transform(d, lambda x: told_ids(x["input_tokens"])), "|")).alias("inputs"), F.aggregate(d, F.lit(0).cast("long"), lambda a, x: a + F.size(x["weights"])).alias("tokens"))


@query(f"""with {LEN_SQL} select row_id, row_id % 4 as part, ((row_number() over (partition by row_id % 4 order by row_id) - 1) // 8)::bigint as batch_no from lens""")
def batches(spark, sf_dir):
    rows = examples(spark, sf_dir).select("row_id", (F.col("row_id") % 4).alias("part"))
    return tokens.batch_numbers(rows, 8, "row_id", "part")


@query("""select iteration * 16 + i as draw, iteration, (iteration * 16 + i) % (select count(*) from benchmark) as position, b.item_id as item_id from range(6) as a(iteration), range(16) as c(i),
    (select item_id, row_number() over (order by item_id) - 1 as k, count(*) over () as n from benchmark) b where b.k = (iteration * 16 + i) % b.n""")
def round_robin_prompts(spark, sf_dir):
    """Prompts of six iterations of sixteen, around the list again and again."""
    from corpusmill.operators.training import round_robin

    return round_robin(table(spark, sf_dir, "benchmark"), "item_id", iterations=6, per_batch=16)


_STATS_SQL = f"""{_KEYED_SQL}, t as (select dirty.row_id, list_sum([13 + strlen(roles[i]) + strlen(contents[i]) + 11 for i in range(1, len(roles) + 1)]) as total,
    1 + coalesce(list_sum([strlen(contents[i]) + 11 for i in range(1, len(roles) + 1) if roles[i] = 'assistant']), 0) as sup from dirty)"""


@query(f"""with {_STATS_SQL}, g as (select p, r, count(*) as c from k group by p, r) select count(*)::bigint as n, sum(total)::bigint as total_tokens, sum(sup)::bigint as supervised_tokens, round(sum(sup) / sum(total), 4) as supervised_ratio,
    (select count(distinct p) from g)::bigint as unique_prompts, (select count(distinct r) from g)::bigint as unique_responses, round((select sum(c - 1) from g) / count(*), 4) as duplicate_rate,
    round((select max(s) from (select sum(c) as s from g group by r)) / count(*), 4) as top_response_share from t""")
def corpus_stats(spark, sf_dir):
    return validate.corpus_stats(dirty(spark, sf_dir))


_TOTAL = "list_sum([13 + strlen(roles[i]) + strlen(contents[i]) + 11 for i in range(1, len(roles) + 1)])"
_FINDINGS_SQL = f"""{_KEYED_SQL}, full_ as (select row_id, roles, contents, response, {_NORM.format("prompt || chr(10) || response")} as norm, {_TOTAL} as len, case when roles[-1] = 'assistant' then strlen(contents[-1]) + 12 else 1 end as run, array_to_string(contents, chr(10)) as blob from texts),
    pairs as (select p, r, min(row_id) as id from k group by p, r), t as (select norm, min(row_id) as id from full_ where norm <> '' group by norm), {_JACCARD},
    clean as (select row_id from full_ where row_id < 1000000000),
    told as (
        select row_id, unnest([case when not regexp_matches(response, '\\S') then 'empty_assistant_turn' end, case when list_contains(roles[2:], 'system') then 'system_turn_not_first' end,
            case when len([i for i in range(2, len(roles) + 1) if roles[i] = roles[i - 1] and roles[i] in ('user', 'assistant')]) > 0 then 'consecutive_same_role' end, case when roles[-1] = 'user' then 'trailing_user_turn' end,
            case when len > 2048 and run >= least(len + 1, 2048) - 1 then 'prompt_truncated_away' end, case when len > 32768 then 'context_overflow' end, case when len > 2048 then 'truncation' end,
            case when regexp_matches(blob, '{text.PII_PATTERNS["email"]}|{text.PII_PATTERNS["ipv4"]}|{text.PII_PATTERNS["aws_access_key"]}') then 'pii_detected' end]) as code from full_
        union all select k.row_id, 'exact_duplicates' from k join pairs using (p, r) where k.row_id > pairs.id
        union all select id, 'label_conflict' from (select id, min(id) over (partition by p) as first_ from pairs where p <> '') where id > first_
        union all select a, 'near_duplicates' from (select distinct a from sim where b < a) union all select pairs.id, 'near_duplicates' from pairs join full_ on full_.row_id = pairs.id join t using (norm) where t.id < pairs.id
        union all select row_id, 'eval_contamination' from clean),
    rolled as (select code, count(*) as count, array_to_string(list(row_id order by row_id)[1:5], ',') as examples from told where code is not null group by code),
    shared as (select 'response_collapse' as code, max(c) as count, '' as examples from (select count(*) as c from k group by r) having max(c) >= 0.5 * (select count(*) from k) and (select count(*) from k) >= 4)"""


@query(f"""with {_FINDINGS_SQL}, found as (select * from rolled union all select * from shared) select code, case when code = 'exact_duplicates' and count >= 0.2 * (select count(*) from k) then 'error'
    when code in ('empty_assistant_turn', 'prompt_truncated_away', 'context_overflow', 'pii_detected', 'eval_contamination') then 'error' when code = 'trailing_user_turn' then 'info' else 'warning' end as severity, count::bigint as count, examples from found""")
def findings_report(spark, sf_dir):
    """The lint of the view with planted defects, the clean examples (all of them in it) as evaluation set."""
    view = dirty(spark, sf_dir)
    found = validate.findings(view, evaluation=examples(spark, sf_dir), max_seq_len=2048, context=32768)
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query(f"""with {DIRTY_SQL}, f as (select row_id, unnest([case when not regexp_matches(response, '\\S') then 'empty_assistant_turn' end, case when list_contains(roles[2:], 'system') then 'system_turn_not_first' end,
        case when len([i for i in range(2, len(roles) + 1) if roles[i] = roles[i - 1] and roles[i] in ('user', 'assistant')]) > 0 then 'consecutive_same_role' end, case when roles[-1] = 'user' then 'trailing_user_turn' end]) as code from texts)
    select code, count(*)::bigint as count, array_to_string(list(row_id order by row_id)[1:5], ',') as examples from f where code is not null group by code""")
def structure_findings(spark, sf_dir):
    flags = validate.row_flags(dirty(spark, sf_dir), 2048, 32768)
    codes = ("empty_assistant_turn", "system_turn_not_first", "consecutive_same_role", "trailing_user_turn")
    told = flags.select("row_id", F.explode(F.array_compact(F.array(*(F.when(F.col(c), c) for c in codes)))).alias("code"))
    return dedup.first_examples(told).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query(f"select code, severity from ({ORACLES['findings_report']}) where severity <> 'info'")
def findings_gate(spark, sf_dir):
    """Of the lint's findings those that a gate at warning stops."""
    found = validate.findings(dirty(spark, sf_dir), evaluation=examples(spark, sf_dir), max_seq_len=2048, context=32768)
    return validate.at_or_above(found, "warning").select("code", "severity")


@query(f"with {CHAT_SQL} select md5(array_to_string(contents, chr(10))) as contents_md5, array_to_string(roles, ',') as roles, (row_number() over (order by row_id) - 1)::bigint as row_id from chat")
def chat_file_round_trip(spark, sf_dir):
    """Examples written as JSON lines in one file and read again."""
    path = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    files.write_chat(examples(spark, sf_dir).coalesce(1).sortWithinPartitions("row_id"), path)
    m = F.col("messages")
    return files.load_chat(spark, path).select(F.md5(chat.joined_text(m).cast("binary")).alias("contents_md5"), F.array_join(chat.roles(m), ",").alias("roles"), "row_id")


@query(f"""with {CHAT_SQL}, p as (select row_id, case when row_id % 4 = 0 then '[INST] ' else '' end || contents[1] as prompt, contents[list_position(roles, 'assistant')] as chosen from chat)
    select md5(prompt) as prompt_md5, md5(chosen) as chosen_md5, md5(chosen || '!') as rejected_md5, case when row_id % 2 = 0 then 'user' else 'system,user' end as roles from p""")
def preference_file_round_trip(spark, sf_dir):
    """Preference rows written as JSON lines, with prompts as text (some begin with a bracket) and as messages, and read again."""
    path = f"{shared_dir(spark)}/preferences-{uuid.uuid4().hex}"
    m = F.col("messages")
    first = F.get(F.transform(F.filter(m, lambda x: x["role"] == "assistant"), lambda x: x["content"]), 0)
    prompt = F.concat(F.when(F.col("row_id") % 4 == 0, "[INST] ").otherwise(""), F.get(m, 0)["content"])
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = examples(spark, sf_dir).select("row_id", prompt.alias("prompt"), first.alias("chosen"), F.concat(first, F.lit("!")).alias("rejected"))
    plain = rows.where("row_id % 2 = 0").select(F.to_json(F.struct("prompt", "chosen", "rejected")).alias("value"))
    listed = rows.where("row_id % 2 = 1").select(F.to_json(F.struct(F.array(turn("system", F.lit("be brief")), turn("user", F.col("prompt"))).alias("prompt"), "chosen", "rejected")).alias("value"))
    plain.unionByName(listed).write.text(path)
    got = files.load_preferences(spark, path)
    digest = lambda c: F.md5(c.cast("binary"))
    return got.select(digest(F.element_at("prompt", -1)["content"]).alias("prompt_md5"), digest(F.col("chosen")).alias("chosen_md5"), digest(F.col("rejected")).alias("rejected_md5"), F.array_join(chat.roles(F.col("prompt")), ",").alias("roles"))


@query("""select (row_number() over (order by item_id) - 1)::bigint as row_id, trim(text) as prompt from benchmark
    where trim(text) <> '' and not contains(text, chr(10)) and not contains(text, chr(13))""")
def prompt_file(spark, sf_dir):
    """Benchmark texts of one line as a prompts file, in order, with tabs, no-break spaces and blank lines."""
    path = f"{shared_dir(spark)}/prompts-{uuid.uuid4().hex}"
    told = table(spark, sf_dir, "benchmark").where("not contains(text, char(10)) and not contains(text, char(13))").coalesce(1).sortWithinPartitions("item_id")
    told.select(F.concat(F.lit("\t "), "text", F.lit(" \u00a0\n \t\u2003\n"))).write.text(path)
    return files.load_prompts(spark, path)


@query("select user_id as run, count(*)::bigint as rows, count(*) filter (where event_id % 7 <> 0)::bigint as losses from events group by 1")
def metrics_file(spark, sf_dir):
    """Metrics written in two batches as JSON lines, the first one twice, null fields left out, and read again."""
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("loss"))
    for part in (0, 0, 1):
        files.fan_out([files.chosen_sink(run_dir=path), files.no_sink])(rows.where(F.col("event_id") % 2 == part), part)
    return spark.read.schema("run long, event_id long, loss double").json(f"{path}/metrics").groupBy("run").agg(F.count("*").alias("rows"), F.count("loss").alias("losses"))


@query(f"""with {CHAT_SQL} select row_id, md5(array_to_string(list_transform(messages, lambda x: case when x.role = 'assistant' then x.content || ' mail [REDACTED:email]' else x.content end), chr(10))) as contents_md5 from chat""")
def redacted_examples(spark, sf_dir):
    """Messages with an address planted in each answer, redacted one by one."""
    planted = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), F.when(x["role"] == "assistant", F.concat(x["content"], F.lit(" mail me@example.org"))).otherwise(x["content"]).alias("content")))
    return examples(spark, sf_dir).select("row_id", F.md5(chat.joined_text(files.redacted_messages(planted)).cast("binary")).alias("contents_md5"))

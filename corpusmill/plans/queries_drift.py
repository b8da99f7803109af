"""Drift queries: lineitem quantities by return flag, documents by language, conversations by parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import drift
from corpusmill.plans import drift_report as report
from corpusmill.plans.catalog import query
from corpusmill.plans.views import CHAT_SQL, examples, table


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("side"), F.col("l_extendedprice").alias("v"))


def _edges_sql(source: str, where: str, bins: int = 10) -> str:
    return f"edges as (select list_sort(list_distinct(quantile_cont(v, [{', '.join(f'{i}/{bins}::double' for i in range(1, bins))}]))) as edges from {source} where {where})"


def _div_sql(pairs: str) -> str:
    """pairs: a table with b and c; gives psi and jsd."""
    return f"""shares as (select greatest(b / sum(b) over (), 1e-6) as p, greatest(c / sum(c) over (), 1e-6) as q from {pairs}),
        scaled as (select p, q, p / sum(p) over () as pp, q / sum(q) over () as qq from shares),
        div as (select sum((q - p) * ln(q / p)) as psi, least(1, greatest(0, sum(pp * log2(2 * pp / (pp + qq))) / 2 + sum(qq * log2(2 * qq / (pp + qq))) / 2)) as jsd from scaled)"""


def _ks_sql(source: str, b: str, c: str) -> str:
    return f"""steps as (select v, sum(count(*) filter (where side = {b})) over (order by v) as fb, sum(count(*) filter (where side = {c})) over (order by v) as fc from {source} group by v),
        gap as (select max(abs(fb / (select count(*) from {source} where side = {b}) - fc / (select count(*) from {source} where side = {c}))) as ks from steps)"""


_PRICES = "p as (select l_returnflag as side, l_extendedprice as v from lineitem)"
_EDGES = _edges_sql("p", "side = 'N'")
_HIST = "hist as (select side, len(list_filter(edges, lambda e: e < v)) as bucket, count(*) as n from p, edges group by all), grid as (select side, unnest(range(0, len(edges) + 1)) as bucket from edges, (select distinct side from p) s)"
_PAIRS = "pairs as (select bucket, coalesce(sum(n) filter (where side = 'N'), 0) as b, coalesce(sum(n) filter (where side = 'R'), 0) as c from grid left join hist using (side, bucket) group by bucket)"


@query(f"with {_PRICES}, {_EDGES} select pos::int as k, round(edge, 6) as edge from (select unnest(edges) as edge, generate_subscripts(edges, 1) - 1 as pos from edges)")
def quantile_bins(spark, sf_dir):
    edges = drift.quantile_edges(_prices(spark, sf_dir).where("side = 'N'"), "v")
    return edges.select(F.posexplode("edges").alias("k", "edge")).select("k", F.round("edge", 6).alias("edge"))


@query(f"with {_PRICES}, {_EDGES}, {_HIST} select side, bucket::int as bucket, coalesce(n, 0)::bigint as count from grid left join hist using (side, bucket)")
def drift_histogram(spark, sf_dir):
    p = _prices(spark, sf_dir)
    return drift.histogram(p, "v", drift.quantile_edges(p.where("side = 'N'"), "v"))


@query(f"with {_PRICES}, {_EDGES}, {_HIST}, {_PAIRS}, {_div_sql('pairs')} select round(psi, 6) as psi, round(jsd, 6) as jsd from div")
def psi_jsd_numeric(spark, sf_dir):
    p = _prices(spark, sf_dir)
    hist = drift.histogram(p, "v", drift.quantile_edges(p.where("side = 'N'"), "v"))
    return drift.divergences(drift._paired(hist, "N", "R", "side", "bucket")).select(F.round("psi", 6).alias("psi"), F.round("jsd", 6).alias("jsd"))


@query(f"with {_PRICES}, {_ks_sql('p', chr(39) + 'N' + chr(39), chr(39) + 'R' + chr(39))} select round(ks, 6) as ks from gap")
def ks_numeric(spark, sf_dir):
    return drift.ks(_prices(spark, sf_dir), "v", "N", "R").select(F.round("ks", 6).alias("ks"))


@query("""with r as (select l_extendedprice as v, row_number() over (order by l_extendedprice) - 1 as k, count(*) over () as n from lineitem)
    select max(n)::bigint as n, round(avg(v), 4) as mean, max(v) filter (where k = n // 2) as p50, max(v) filter (where k = least(n - 1, floor(0.95 * n))) as p95, max(v) as max from r""")
def numeric_summary(spark, sf_dir):
    return drift.summary(_prices(spark, sf_dir), "v")


@query(f"""with {_PRICES}, {_EDGES}, {_HIST}, {_PAIRS}, {_div_sql('pairs')}, {_ks_sql('p', chr(39) + 'N' + chr(39), chr(39) + 'R' + chr(39))}
    select 'v' as feature, round(psi, 6) as psi, round(jsd, 6) as jsd, round(ks, 6) as ks, case when psi >= 0.25 then 'error' when psi >= 0.1 then 'warning' else 'info' end as severity, '' as detail from div, gap""")
def compare_distributions(spark, sf_dir):
    return drift.compare_distributions(_prices(spark, sf_dir), "v", "N", "R")


def _categorical_sql(rows: str, feature: str) -> str:
    """rows: a table expression with side (0 or 1), key, first."""
    return f"""wide as (select key, count(*) filter (where side = 0) as b, count(*) filter (where side = 1) as c, min(first) filter (where side = 0) as first from {rows} group by key),
        top as (select key, b, c from wide where b > 0 order by b desc, first, key limit 50),
        pairs as (select b, c from top union all select (select sum(b) from wide) - (select sum(b) from top), (select sum(c) from wide) - (select sum(c) from top)),
        {_div_sql('pairs')}, fresh as (select coalesce(sum(c) filter (where b = 0), 0) / sum(c) as unseen from wide)
        select '{feature}' as feature, round(psi, 6) as psi, round(jsd, 6) as jsd, round(unseen, 6) as unseen, case when psi >= 0.25 then 'error' when psi >= 0.1 then 'warning' else 'info' end as severity,
            case when unseen > 0.05 then printf('%.1f%% of the candidate is unseen in the baseline', unseen * 100) else '' end as detail from div, fresh"""


@query("with rows as (select doc_id % 2 as side, source as key, doc_id as first from documents), " + _categorical_sql("rows", "source"))
def categorical_drift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), "source", F.col("doc_id").alias("position"))
    return drift.compare_categorical(docs, "source", 0, 1)


def _side():
    return F.col("row_id") % 2


_PREFIX_SQL = """prefixes as (select row_id % 2 as side, row_id as first, regexp_extract_all(lower(contents[list_position(roles, 'assistant')]), '[a-z0-9'']+')[1:2] as w from chat),
    rows as (select side, first, case when len(w) > 0 then array_to_string(w, ' ') else '<empty>' end as key from prefixes)"""


@query(f"with {CHAT_SQL}, {_PREFIX_SQL}, " + _categorical_sql("rows", "answer_prefix"))
def answer_prefix_drift(spark, sf_dir):
    return drift.compare_categorical(report.features(examples(spark, sf_dir), _side()), "answer_prefix", 0, 1)


_WORDS_SQL = """told as (select row_id, unnest(messages) as x, generate_subscripts(messages, 1) as pos from chat),
    split as (select row_id, pos, regexp_extract_all(lower(x.content), '[a-z0-9'']+')[1:200] as w from told),
    rows as (select row_id % 2 as side, unnest(w) as key, {'a': row_id, 'b': pos, 'c': generate_subscripts(w, 1)} as first from split)"""


@query(f"with {CHAT_SQL}, {_WORDS_SQL}, " + _categorical_sql("rows", "vocabulary"))
def vocabulary_drift(spark, sf_dir):
    return drift.compare_categorical(report.vocabulary(examples(spark, sf_dir), _side()), "word", 0, 1, feature="vocabulary")


def _numeric_sql(feature: str, value: str) -> str:
    """One row of the report, from a table expression with side (0 or 1) and v."""
    return f"""select * from (with p as (select row_id % 2 as side, ({value})::double as v from chat), sorted as (select list(v order by v) as s, count(*) - 1 as n, least(10, count(distinct v)) as bins from p where side = 0),
        edges as (select list_sort(list_distinct(list_transform(range(1, bins), lambda i: s[1 + floor(i * n / bins)::int] + (i * n / bins - floor(i * n / bins)) * (s[1 + least(n, floor(i * n / bins) + 1)::int] - s[1 + floor(i * n / bins)::int])))) as edges from sorted),
        hist as (select side, len(list_filter(edges, lambda e: e < v)) as bucket, count(*) as n from p, edges group by all), grid as (select unnest(range(0, len(edges) + 1)) as bucket from edges),
        pairs as (select bucket, coalesce(sum(n) filter (where side = 0), 0) as b, coalesce(sum(n) filter (where side = 1), 0) as c from grid left join hist using (bucket) group by bucket), {_div_sql("pairs")}, {_ks_sql("p", "0", "1")}
        select '{feature}' as feature, round(psi, 6) as psi, round(jsd, 6) as jsd, round(ks, 6) as ks, case when n < 30 and psi >= 0.1 or psi >= 0.1 and psi < 0.25 then 'warning' when psi >= 0.25 then 'error' else 'info' end as severity, case when n < 30 then 'small sample' else '' end as detail
        from div, gap, (select least(count(*) filter (where side = 0), count(*) filter (where side = 1)) as n from p))"""


_SIDE_CHARS = "length(array_to_string(list_transform(list_filter(messages, lambda x: x.role {} 'assistant'), lambda x: x.content), ' '))"
_REPORT_SQL = f"{CHAT_SQL}, report as (" + " union all ".join([
    _numeric_sql("prompt_chars", _SIDE_CHARS.format("<>")), _numeric_sql("answer_chars", _SIDE_CHARS.format("=")), _numeric_sql("turns", "len(messages)"),
    f"select feature, psi, jsd, null::double as ks, severity, detail from (with {_PREFIX_SQL}, {_categorical_sql('rows', 'answer_prefix')})",
    f"select feature, psi, jsd, null::double as ks, severity, detail from (with {_WORDS_SQL}, {_categorical_sql('rows', 'vocabulary')})",
]) + ")"


@query(f"with {_REPORT_SQL} select * from report")
def drift_report(spark, sf_dir):
    return report.drift_report(examples(spark, sf_dir), _side(), 0, 1)


@query(f"with {_REPORT_SQL} select case max(case severity when 'error' then 2 when 'warning' then 1 else 0 end) when 2 then 'error' when 1 then 'warning' else 'info' end as severity, bool_or(severity <> 'info') as drifted from report")
def drift_overall(spark, sf_dir):
    return report.overall(drift_report(spark, sf_dir))


@query(f"with {CHAT_SQL} select round(count(*) filter (where row_id % 2 = 1) / count(*) filter (where row_id % 2 = 0), 4) as ratio, count(*) filter (where row_id % 2 = 1) / count(*) filter (where row_id % 2 = 0) not between 0.5 and 2 as noted from chat")
def corpus_size_note(spark, sf_dir):
    return report.size_note(examples(spark, sf_dir), _side(), 0, 1)

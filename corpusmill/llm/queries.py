"""The queries of this subpackage: each operator on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.chat_format import read_back, with_probe
from corpusmill.llm.common import read
from corpusmill.llm.embedding_dedup import embedding_groups
from corpusmill.llm.html_extraction import extract_pages
from corpusmill.llm.manifest import manifest_audit
from corpusmill.llm.oracles import CHAT_FORMAT, MERKLE_MANIFEST, PREFIX_TRIE, SECRET_SCAN, URL_FILTER
from corpusmill.llm.packing import pack_documents
from corpusmill.llm.prefix_trie import prefix_trie
from corpusmill.llm.quality_classifier import quality_scores
from corpusmill.llm.quality_rules import BARS, FURNITURE, LineRules, quality_rules
from corpusmill.llm.secrets import secret_scan
from corpusmill.llm.sentencepiece_codec import encode_documents
from corpusmill.llm.simhash import simhash_groups
from corpusmill.llm.url_filter import url_verdicts
from corpusmill.llm.warc import ARCHIVE_RECORDS, DATE, audit, damaged, records


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as archives against a replica with planted damage."""
    pages = read(spark, sf_dir, "pages")
    return audit(records(pages), damaged(pages))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read(spark, sf_dir, "embeddings"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings."""
    return read_back(with_probe(read(spark, sf_dir, "conversations")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_audit(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}

_L = LineRules()
_GAP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"  # what Python takes as white space
_PHRASES = "(" + " + ".join(f"(length(lower(l)) - length(replace(lower(l), '{p}', ''))) / {len(p)} * {p.count(' ') + 1}" for p in FURNITURE) + ")"
#: The base columns and the line rules as SQL: lines are judged one by one, a text by the words it loses.
_QUALITY_RULES = rf"""
    with d as (select row_number() over () as no, doc_id, coalesce(text, '') as text from documents),
    worded as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, string_split(text, chr(10)) as lines from d),
    windows as (select no, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) as w, unnest(range(1, len(words) - 1)) as i from worded),
    twice as (select no, i, count(*) over (partition by no, w) as c from windows),
    covered as (select no, count(distinct p) as n_repeat from (select no, unnest([i, i + 1, i + 2]) as p from twice where c > 1) group by no),
    line as (select no, unnest(lines) as l, generate_subscripts(lines, 1) as k from worded),
    spoken as (select no, l, k, row_number() over (partition by no, l order by k) as nth, coalesce(lag(l) over w, last_value(l) over (w rows between unbounded preceding and unbounded following)) as before, coalesce(lead(l) over w, first_value(l) over w) as after
        from line where regexp_matches(l, '[^\x20\x09-\x0D]') window w as (partition by no order by k)),
    sides as (select l, side, count(*) as c from (select l, unnest(['b' || before, 'a' || after]) as side from spoken where nth = 1 and not regexp_matches(regexp_replace(l, '[\x20\x09-\x0D]+$', ''), '[.!?…]["''»”’)\]]*$') and len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) <= {_L.furniture_words}) group by l, side),
    shared as (select l from (select l, left(side, 1) as s, sum(c) as n, max(c) as top from sides group by all) group by l
        having max(n) >= {_L.shared_documents} and max(top) <= {_L.shared_neighbour}::double * max(n) and max(n) >= {_L.shared_part}::double * (select count(*) from d)),
    told as (select *, regexp_extract_all(l, '[^\x20\x09-\x0D]+') as w, list_filter(regexp_split_to_array(l, '{_GAP}'), lambda x: x <> '') as u from line where regexp_matches(l, '[^\x20\x09-\x0D]')),
    measured as (select *, len(w) as n, len(list_filter(u, lambda x: x in ({", ".join(f"'{c}'" for c in BARS)}))) as bars, len(list_filter(u, lambda x: regexp_matches(x, '[^#*$%&|<>][#*$%&|<>]{{2,}}[.,;:!?]*$'))) as tails,
        (length(l) - length(replace(l, '!!', ''))) / 2 as bangs, len(list_filter(u, lambda x: regexp_matches(x, '\p{{Lu}}') and not regexp_matches(x, '[\p{{Ll}}\p{{Lt}}]'))) as upper_,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as stutters, row_number() over (partition by no, l order by k) as nth from told),
    judged as (select *, case when not regexp_matches(l, '[\p{{L}}\p{{N}}]') then true when n <= {_L.furniture_words} and n > 0 and {_PHRASES} >= {_L.furniture_share}::double * n and {_PHRASES} > 0 then true
        when n <= {_L.furniture_words} and l in (select l from shared) then true
        when n < {_L.share_words} then n <= {_L.stub_words} and bars >= 1 and not regexp_matches(regexp_replace(l, '[\x20\x09-\x0D]+$', ''), '[.!?…:;,"''»”’)\]]$')
        else bars >= {_L.bar_share}::double * n or tails >= {_L.symbol_share}::double * n and tails > 0 or bangs >= {_L.exclaim_share}::double * n and bangs > 0 or upper_ >= {_L.upper_share}::double * n
            or len(list_distinct(w)) <= n - {_L.stutter_share}::double * n and stutters >= {_L.stutter_share}::double * n end as fault from measured),
    lost as (select no, sum(case when fault or nth > 1 then n else 0 end) as lost, sum((nth > 1)::int) as dup from judged group by no),
    base as (select no, doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols from worded),
    failed as (select *, n_words < {_L.min_words} or 100 * coalesce(n_repeat, 0) > {_L.max_repeat_percent} * n_words as base_failed from base left join covered using (no) left join lost using (no))
    select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words, base_failed,
        not base_failed and coalesce(lost, 0) <= {_L.max_lost_share}::double * n_words as kept, case when base_failed then 0 else coalesce(lost, 0) end::bigint as n_lost_words from failed
"""

ORACLES: dict[str, str] = {
    "op3_url_filter": URL_FILTER,
    "op9_secret_scan": SECRET_SCAN,
    "op11_chat_formatting": CHAT_FORMAT,
    "op12_merkle_manifest": MERKLE_MANIFEST,
    "op13_prefix_trie": PREFIX_TRIE,
    "op4_quality_rules": _QUALITY_RULES,
    "op5_embedding_near_dedup": """
        with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
        ok as (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        pairs as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
        reach as (select vec_id as a, vec_id as b from v union select r.a, p.b from reach r join pairs p on r.b = p.a),
        counts as (select a, count(*) as n from pairs group by a), least as (select a, min(b) as component_id from reach group by a)
        select v.vec_id, coalesce(n, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept from v join least on least.a = v.vec_id left join counts on counts.a = v.vec_id
    """,
    "op2_warc_fixity": f"""
        with parts as (
            select page_id, coalesce(url, '') as url, coalesce(html, '') as html, chr(13) || chr(10) as nl, md5(cast(page_id as varchar)) as mark, md5('{DATE} ' || coalesce(url, '')) as named from pages
        ), whole as (
            select *, 'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:uuid:' || concat_ws('-', substr(named, 1, 8), substr(named, 9, 4), substr(named, 13, 4), substr(named, 17, 4), substr(named, 21, 12)) || '>' || nl || 'WARC-Date: {DATE}' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Type: text/html' || nl || 'Content-Length: '
                || cast(strlen(html) as varchar) || nl || nl as head,
                mark < '04' and substr(mark, 3, 1) >= '8' as lost,
                mark < '04' and substr(mark, 3, 1) < '8' and substr(html, 1, 1) in ('<', ' ') as broken from parts
        ), hashed as (
            select page_id, lost, broken, cast(strlen(head || html || nl || nl) as bigint) as length, sha256(head || html || nl || nl) as digest,
                sha256(head || '?' || substr(html, 2) || nl || nl) as other, cast(floor(page_id / {ARCHIVE_RECORDS}) as bigint) as archive from whole
        ), placed as (
            select *, row_number() over (partition by archive order by page_id) - 1 as number,
                cast(sum(length) over (partition by archive order by page_id) - length as bigint) as start from hashed
        )
        select archive, number, start as left_offset, length as left_length, digest as left_digest, case when lost then null else start end as right_offset,
            case when lost then null else length end as right_length, case when lost then null else other end as right_digest,
            case when lost then 'missing_right' else 'corrupt' end as fault
        from placed where lost or broken
    """,
}

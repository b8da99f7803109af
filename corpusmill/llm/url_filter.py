"""URL filter: fixed host-and-path rules, and for all other urls association rules mined from labelled urls.

Each url is the set of its tokens (scheme, host suffixes, path parts, extension, query keys), all of them. Spark's FP-growth
finds the token sets that are frequent among labelled urls; rules `tokens -> bad` stay if their confidence and support
pass, the lower bound of their confidence does too, and no rule with fewer of the same tokens is as sure. Tokens that
always occur together there count as one item, else a deep path would give two sets to the power of its depth. An
inverted index from each rule's rarest token finds the rules that a url may fulfil.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_BAD = "=bad"


@dataclass(frozen=True)
class Mining:
    """Shares of labelled urls; z: how many standard errors the confidence's lower bound lies below it."""

    min_support: float = 0.002
    min_confidence: float = 0.6
    min_lower_bound: float = 0.5
    z: float = 2.58


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From there up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A rule fits its host, all subdomains and all paths it begins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_DIGITS = re.compile(r"\d+")


def url_tokens(url: str | None) -> list[str]:
    """Sorted distinct tokens of a whole url; none for null and without ://."""
    head, _, rest = (url or "").partition("://")
    if not _:
        return []
    where, query = re.split(r"[?#]", rest, maxsplit=1)[0], rest.partition("?")[2].partition("#")[0]
    name, _, path = where.partition("/")
    labels = name.translate(str.maketrans(UPPER, LOWER)).split(".")
    out = {f"scheme:{head.lower()}"}
    out |= {f"host:{'.'.join(labels[-k:])}" for k in range(1, len(labels) + 1)}
    parts = [p for p in path.split("/") if p]
    out |= {f"path{i}:{_DIGITS.sub('0', p.lower())}" for i, p in enumerate(parts)}
    if parts and "." in parts[-1]:
        out.add(f"type:{parts[-1].rpartition('.')[2].lower()}")
    out |= {f"query:{q.partition('=')[0]}" for q in query.split("&") if q}
    return sorted(out)


def document_of(url: Column) -> Column:
    """The number that ends a url's path (before an extension): the document that the page shows."""
    number = F.regexp_extract(url, r"^(?s).*?://[^/?#]*[^?#]*?/([0-9]+)(?:\.[A-Za-z]+)?/?(?:[?#].*)?$", 1)
    return F.nullif(number, F.lit("")).try_cast("bigint")


Rule = tuple[tuple[str, ...], float, int]  #: tokens, confidence, urls that hold the tokens


def _itemized(urls: DataFrame, of_token: Callable[[str], str | None]) -> DataFrame:
    """(url, bad) -> items: of_token of each token where there is one, and the label's token for bad urls."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted({i for t in url_tokens(u.as_py()) if (i := of_token(t)) is not None}) + [_BAD] * bad.as_py() for u, bad in zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string()))], ["items"])

    return urls.select("url", "bad").mapInArrow(run, "items array<string>")


def _items(tokens: DataFrame, least: float) -> dict[str, str]:
    """Frequent token -> its item: the shortest of the tokens that occur in the same urls.

    Tokens with equal counts and equal sums of two hashes of the token sets they occur in are taken to occur together.
    """
    one, two = (F.pmod(F.xxhash64("items", F.lit(k)), F.lit(1 << 40)) for k in (1, 2))
    seen = tokens.select(F.explode("items").alias("token"), one.alias("one"), two.alias("two")).where(F.col("token") != _BAD)
    often = seen.groupBy("token").agg(F.count("*").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).where(F.col("n") >= least)
    same = often.groupBy("n", "one", "two").agg(F.collect_list("token").alias("tokens")).select("tokens").collect()  # at most a url's tokens / min_support
    return {t: min(r.tokens, key=lambda x: (len(x), x)) for r in same for t in r.tokens}


def mine(labelled: DataFrame, m: Mining = Mining()) -> tuple[list[Rule], dict[str, str]]:
    """(url, bad int) -> rules over items, the surest first, and the item of each frequent token.

    All labelled urls are counted, with all their tokens. No rule and no item come from an empty table.
    """
    urls, stash = labelled.where("url is not null and bad is not null"), Stash(labelled.sparkSession, "urls")
    tokens, first = stash.put(_itemized(urls, str).where(F.size(F.array_remove("items", _BAD)) > 0))
    n = tokens.count()
    item_of = _items(tokens, m.min_support * n) if n else {}
    found = []
    if item_of:
        sent = labelled.sparkSession.sparkContext.broadcast(item_of)
        items, second = stash.put(_itemized(urls.where(F.instr("url", "://") > 0), lambda t: sent.value.get(t)))
        model = FPGrowth(itemsCol="items", minSupport=m.min_support, minConfidence=m.min_confidence).fit(items)
        found = model.associationRules.where(F.col("consequent")[0] == _BAD).select("antecedent", "confidence", "support").collect()
        stash.drop(second)
    stash.drop(first)
    rules: list[Rule] = []
    for r in sorted(found, key=lambda r: (len(r.antecedent), sorted(r.antecedent))):
        covers = round(r.support * n / r.confidence)
        lower = r.confidence - m.z * math.sqrt(r.confidence * (1 - r.confidence) / covers + m.z**2 / (4 * covers**2))
        if lower < m.min_lower_bound or any(set(a) <= set(r.antecedent) and c >= r.confidence for a, c, _ in rules):
            continue
        rules.append((tuple(sorted(r.antecedent)), r.confidence, covers))
    return sorted(rules, key=lambda r: (-r[1], -r[2], r[0])), item_of


class RuleIndex:
    """Rules by their rarest item: only rules whose rarest item a url has are compared with it."""

    def __init__(self, rules: list[Rule], item_of: dict[str, str] | None = None):
        uses: dict[str, int] = defaultdict(int)
        for items, _, covers in rules:
            for t in items:
                uses[t] += covers
        self.by_item: dict[str, list[tuple[float, tuple[str, ...]]]] = defaultdict(list)
        for items, confidence, _ in rules:
            self.by_item[min(items, key=lambda t: (uses[t], t))].append((confidence, items))
        self.item_of = {t: i for t, i in (item_of or {}).items() if i in uses}

    def best(self, tokens: list[str]) -> tuple[float, tuple[str, ...]] | None:
        """The surest rule that the tokens fulfil."""
        have = {self.item_of.get(t, t) for t in tokens}
        return max((r for t in have for r in self.by_item.get(t, ()) if have.issuperset(r[1])), default=None)


def url_verdicts(pages: DataFrame, labels: DataFrame, m: Mining = Mining(), rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, url, ...), labels (doc_id, quality, toxic, ...) -> page_id, host, path, rule, verdict, mined_rule, confidence.

    A url that fits a fixed rule has its verdict; else it is blocked if a mined rule fits and allowed otherwise.
    A page takes the label of the document that its url numbers: bad if quality is 0 or toxic is 1 (nulls tell
    nothing; of several labels the worst counts). Urls that are null or without :// have an empty host and path, no
    tokens, and are allowed. Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    known = labels.select("doc_id", ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("bad")).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("bad").alias("bad"))
    numbered = pages.select("url", document_of(F.col("url")).alias("doc_id")).where("doc_id is not null")
    sent = pages.sparkSession.sparkContext.broadcast(RuleIndex(*mine(numbered.join(known, "doc_id").select("url", "bad"), m)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [sent.value.best(url_tokens(u.as_py())) for u in b.column(1)]
            fit = [h and " & ".join(h[1]) for h in hits]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fit, pa.string()), pa.array([h and h[0] for h in hits], pa.float64())], ["page_id", "url", "mined_rule", "confidence"])

    judged = pages.select("page_id", "url").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, mined_rule string, confidence double")
    parts = judged.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "mined_rule", "confidence")
    fixed = parts.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fixed.verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return fixed.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule", "confidence")

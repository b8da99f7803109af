"""The library's functions by name in `spark.sql`: SQL-defined functions for column expressions, a Python table function for packs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from corpusmill.functions import text
from corpusmill.operators.sharding import ShardSpec
from corpusmill.operators.tokens import _opens

#: Rewards of (prompt, completion), as in functions.rewards.
REWARDS = {
    "length_target": "greatest(0D, 1D - abs(length(completion) - 200) / 200D)",
    "numeric_match": r"coalesce(cast(try_element_at(regexp_extract_all(prompt, '-?\\d+(?:\\.\\d+)?', 0), -1) = try_element_at(regexp_extract_all(completion, '-?\\d+(?:\\.\\d+)?', 0), -1) as double), 0D)",
    "nonempty": r"cast(completion rlike '(?U)\\S' as double)",
}


def _quoted(value: str) -> str:
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, use: str) -> str:
    """text.let: use, an expression of the name, with the value computed once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _redaction(of: str, ascii: bool) -> str:
    """The SQL of text.redacted: each kind in turn where its anchor is, cards by their check digits."""
    numbers = "x"
    for kind in text.PII_PATTERNS:
        p, mark = map(_quoted, text.pattern_and_mark(kind, ascii))
        if kind in text.LITERALS:
            there = " or ".join(f"contains(x, {_quoted(v)})" for v in text.LITERALS[kind])
            of = _let("x", of, f"if({there}, regexp_replace(x, {p}, {mark}), x)")
        elif kind == "credit_card":
            digits = "regexp_replace(c, '[^0-9]', '')"
            card = f"if(length({digits}) between 13 and 19 and luhn_check({digits}), {mark}, c)"
            runs = f"transform(regexp_extract_all(y, {p}, 0), c -> {card})"
            numbers = _let("y", numbers, _let("runs", runs, f"array_join(transform(split(y, {p}, -1), (gap, i) -> gap || coalesce(get(runs, i), '')), '')"))
        else:
            numbers = f"regexp_replace({numbers}, {p}, {mark})"
    return _let("x", of, f"if(x rlike {_quoted(text.DIGITS)}, {numbers}, x)")


def owner_sql(spec: ShardSpec, key: str = "key") -> str:
    """ShardSpec.owner_of as SQL: a lookup in the bucket table."""
    bucket = f"cast(conv(substring(md5(concat_ws('/', '{spec.seed}', {key})), 1, 13), 16, 10) as bigint) % {spec.num_buckets}"
    return f"get(array({', '.join(map(str, spec.owners()))}), cast({bucket} as int))"


@udtf(returnType="row_id bigint, len bigint, pack_no bigint, offset bigint")
class PackRows:
    """pack_rows(limit, TABLE(rows) PARTITION BY part ORDER BY row_id): in-order packs of (row_id, len) within a partition."""

    def __init__(self):
        self.pack, self.fill = -1, None

    def eval(self, limit: int, row: Row) -> Iterator[tuple]:
        if _opens(self.fill, row.len, limit):
            self.pack, self.fill = self.pack + 1, 0
        yield row.row_id, row.len, self.pack, self.fill
        self.fill += row.len


def register(spark: SparkSession, spec: ShardSpec = ShardSpec(1), ascii: bool = False) -> list[str]:
    """Makes the functions known to the session and returns their names: the rewards, redact(text), owner_of(key) of a spec, pack_rows.

    ascii: redact has the word borders and digits of ASCII, as in text.redacted.
    """
    made = {name: ("prompt string, completion string", "double", body) for name, body in REWARDS.items()}
    made["redact"] = ("content string", "string", _redaction("content", ascii))
    made["owner_of"] = ("key string", "int", owner_sql(spec))
    for name, (arguments, kind, body) in made.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {kind} return {body}")
    spark.udtf.register("pack_rows", PackRows)
    return [*made, "pack_rows"]

"""Readers and writers: chat, preference and prompt files, manifests, job records, metrics."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusmill.functions import chat, text
from corpusmill.operators.runs import reconcile
from corpusmill.operators.stored import stored

class CorruptManifestError(ValueError):
    """A checkpoint manifest that is no list of entries with step and path."""


#: A line -> the rows that it gives, each as the values of a schema's columns.
Parse = Callable[[str], Iterable[tuple]]


def parsed_lines(spark: SparkSession, path: str, parse: Parse, schema: str) -> DataFrame:
    """row_id, path, line_no and the schema's columns: what `parse` makes of the lines, in order of file and line.

    Files are read once, in splits. A split numbers its own lines and rows and tells, in a row of its own, how many it had; the result is
    written, and the numbers of the splits before are added when it is read. row_id counts rows from 0 over all files.
    """
    own = StructType.fromDDL(f"path string, block long, k long, r long, ends boolean, {schema}")
    kinds = to_arrow_schema(own)
    names = own.names[5:]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lines, rows = None, 0, 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

        end = lambda: out.append((*place, lines, rows, True, *[None] * len(names)))
        for b in batches:
            for file, block, line in zip(*(c.to_pylist() for c in b.columns)):
                if place != (file, block):
                    if place is not None:
                        end()
                    place, lines, rows = (file, block), 0, 0
                lines += 1
                for values in parse(line):
                    out.append((*place, lines, rows, False, *values))
                    rows += 1
            yield batch()
        if place is not None:
            end()
            yield batch()

    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    table = stored(read.mapInArrow(number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)))
    before = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    ahead = table.where("ends").select(
        "path", "block", F.coalesce(F.sum("k").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lines_ahead"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("rows_ahead"),
    )
    return table.where("not ends").join(ahead, ["path", "block"]).select((F.col("rows_ahead") + F.col("r")).alias("row_id"), "path", (F.col("lines_ahead") + F.col("k")).alias("line_no"), *names)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id, path, line_no, line: the lines that are not blank."""
    return parsed_lines(spark, path, lambda line: [(line,)] if line.strip() else [], "line string")


#: The roles of a chat.
ROLES = ("system", "user", "assistant", "tool")


class _Unfit(ValueError):
    """What is wrong with a line."""


def _turns(value) -> list[tuple[str, str]]:
    """A list of messages as (role, content)."""
    if not isinstance(value, list) or not value:
        raise _Unfit("needs messages, a list with a turn at least")
    for m in value:
        if not isinstance(m, dict) or not isinstance(m.get("content"), str):
            raise _Unfit("a message needs role and content")
        if m.get("role") not in ROLES:
            raise _Unfit(f"role {m.get('role')!r} is none of {', '.join(ROLES)}")
    return [(m["role"], m["content"]) for m in value]


def _object(line: str) -> dict:
    try:
        row = json.loads(line)
    except (ValueError, RecursionError) as e:
        raise _Unfit(f"invalid JSON: {e}") from e
    if not isinstance(row, dict):
        raise _Unfit("needs messages, or prompt and completion, in an object")
    return row


def _chat_turns(row: dict) -> list[tuple[str, str]]:
    if "messages" in row:
        turns = _turns(row["messages"])
    elif "prompt" in row and "completion" in row:
        turns = [("user", str(row["prompt"])), ("assistant", str(row["completion"]))]
    else:
        raise _Unfit("needs messages, or prompt and completion")
    if all(role != "assistant" for role, _ in turns):
        raise _Unfit("no assistant turn")
    return turns


def _preference(row: dict) -> tuple[list[tuple[str, str]], str, str]:
    if "chosen" not in row or "rejected" not in row:
        raise _Unfit("needs prompt, chosen and rejected")
    prompt = row.get("prompt")
    if not isinstance(prompt, (list, str)):
        raise _Unfit("needs prompt, chosen and rejected; the prompt is a text or a list of messages")
    return [("user", prompt)] if isinstance(prompt, str) else _turns(prompt), str(row["chosen"]), str(row["rejected"])


def _sound(text: str) -> str:
    """The text with U+FFFD for each lone surrogate, which no column can hold."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if _LONE.search(text) else text


_LONE = re.compile("[\ud800-\udfff]")


def _checked(rows: DataFrame, path: str) -> DataFrame:
    """Rows without the error column; the first error, or no row at all, is a ValueError. Only numbers and errors are read for it."""
    seen = rows.agg(F.count("*").alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("row_id", "error"))).alias("bad")).first()
    if seen.bad:
        raise ValueError(seen.bad.error)
    if not seen.n:
        raise ValueError(f"{path} has no rows")
    return rows.drop("error")


def _loaded(spark: SparkSession, path: str, of: Callable[[dict], tuple], schema: str, strict: bool) -> DataFrame:
    """row_id, the schema's columns and whether the line held a lone surrogate, from lines of JSON objects."""
    width = len(StructType.fromDDL(schema).names)

    def parse(line: str) -> Iterator[tuple]:
        if line.strip():
            try:
                values = of(_object(line))
            except _Unfit as e:
                yield *[None] * width, None, _sound(str(e))
                return
            told: list = []
            lone = False
            for v in values:
                parts = [x for turn in v for x in turn] if isinstance(v, list) else [v]
                lone = lone or any(_LONE.search(x) for x in parts)
                told.append([{"role": r, "content": _sound(c)} for r, c in v] if isinstance(v, list) else _sound(v))
            yield *told, lone, None

    rows = parsed_lines(spark, path, parse, f"{schema}, lone_surrogate boolean, why string")
    error = F.when(F.col("why").isNotNull(), F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), "why"))
    out = rows.select("row_id", *StructType.fromDDL(schema).names, error.alias("error"), "lone_surrogate")
    return _checked(out, path) if strict else out


def load_chat(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """row_id, messages, lone_surrogate of a JSON-lines file of chats (`messages`) or pairs (`prompt` and `completion`), mixed as they come.

    strict: a line that is no JSON, has neither form, an unknown role or no assistant turn fails with its place, an empty file with a
    ValueError. Otherwise such lines stay, with messages null and an error.
    """
    return _loaded(spark, path, lambda row: (_chat_turns(row),), f"messages {chat.MESSAGES}", strict)


def load_preferences(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """row_id, prompt (messages), chosen, rejected; a prompt given as text is one user message."""
    return _loaded(spark, path, _preference, f"prompt {chat.MESSAGES}, chosen string, rejected string", strict).drop("lone_surrogate")


def load_prompts(spark: SparkSession, path: str) -> DataFrame:
    """row_id, prompt: the lines of a text file in order, without white space around them and without blank ones."""
    return parsed_lines(spark, path, lambda line: [(p,) for x in line.splitlines() if (p := x.strip())], "prompt string").select("row_id", "prompt")


def load_jobs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Job records of a folder of JSON documents, or of JSON lines; unreadable ones are left out and running ones have failed."""
    schema = "id string, type string, status string, base_model string, created_at string, started_at string, finished_at string, current_step long, total_steps long, error string, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return reconcile(rows.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record"))


def manifest_entries(text: str, path: str) -> list[dict]:
    """Entries of a manifest's text: step, path and finite metrics."""
    try:
        entries = json.loads(text)
        if not isinstance(entries, list):
            raise TypeError("no list")
        finite = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < float("inf")
        return [{"step": int(e["step"]), "path": str(e["path"]), "metrics": {k: float(v) for k, v in (e.get("metrics") or {}).items() if finite(v)}} for e in entries]
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise CorruptManifestError(f"{path}: {e}") from e


def load_manifest(path: str) -> list[dict]:
    """Entries of a checkpoint manifest, a small file of one run on this machine. Missing file: none."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return manifest_entries(f.read(), path)


def replace_json(path: str, value) -> None:
    """Writes a JSON file whole or not at all: a temporary file beside it takes its place."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def redacted_messages(m: Column) -> Column:
    """The messages with personal data replaced in each."""
    return F.transform(m, lambda x: F.struct(x["role"].alias("role"), text.redacted(x["content"]).alias("content")))


def write_chat(examples: DataFrame, path: str, redact: bool = False) -> None:
    """JSON lines of {"messages": [...]}; redact replaces personal data in each message."""
    m = redacted_messages(F.col("messages")) if redact else F.col("messages")
    examples.select(F.to_json(F.struct(m.alias("messages"))).alias("value")).write.text(path)


def redaction_total(examples: DataFrame) -> DataFrame:
    """One row: how many matches a redacted copy of the examples replaces."""
    per = F.transform("messages", lambda x: F.aggregate(F.map_values(text.pii_counts(x["content"])), F.lit(0).cast("long"), lambda a, n: a + n))
    return examples.agg(F.coalesce(F.sum(F.aggregate(per, F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias("redactions"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """JSON lines without null fields, added to those there."""
    metrics.write.mode("append").option("ignoreNullFields", True).json(path)


def put_metrics(metrics: DataFrame, path: str, batch_id: int) -> None:
    """JSON lines of a stream's batch in a folder of its own, in place of what an earlier try of the batch left there."""
    metrics.write.mode("overwrite").option("ignoreNullFields", True).json(f"{path}/batch={batch_id}")


def fan_out(sinks: list) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch to all sinks, each a function of (batch, batch_id)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write


Sink = Callable[[DataFrame, int], None]


def no_sink(batch: DataFrame, batch_id: int) -> None:
    """Keeps nothing."""


def chosen_sink(tracker: Sink | None = None, run_dir: str | None = None) -> Sink:
    """The tracker if there is one, else JSON lines in the run's folder, else none. A batch that is written again replaces itself."""
    if tracker is not None:
        return tracker
    return (lambda batch, batch_id: put_metrics(batch, f"{run_dir}/metrics", batch_id)) if run_dir else no_sink


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Job records as JSON lines in place of those there; the table must not be read from the same folder."""
    jobs.write.mode("overwrite").option("ignoreNullFields", False).json(path)

"""Checkpoint folders of runs on any storage that Hadoop reads: snapshots, manifests, and retention of one run or of all under a root."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.runs import Retention, bytes_freed, last_writes, retention_plan, retention_summary
from corpusmill.operators.stored import Scratch, stored
from corpusmill.sources import shared
from corpusmill.sources.files import manifest_entries

MANIFEST = "checkpoints.json"
ENTRIES = "array<struct<step:long,path:string,metrics:map<string,double>>>"


@dataclass
class Applied:
    """What a retention did, or with dry_run would do: steps by action, bytes freed, and the plan in words."""

    keep: list[int] = field(default_factory=list)
    delete: list[int] = field(default_factory=list)
    missing: list[int] = field(default_factory=list)
    bytes_freed: int = 0
    summary: str = ""


def _entries(spark: SparkSession, manifest: str) -> list[dict]:
    text = shared.read_text(spark, manifest)
    return [] if text is None else manifest_entries(text, manifest)


def apply_retention(spark: SparkSession, manifest: str, policy: Retention = Retention(), metric: str = "eval_loss", dry_run: bool = False) -> Applied:
    """Plans over the manifest's entries (of a step the last one), deletes what the plan drops and rewrites the manifest.

    Entries whose file is gone are missing and leave the manifest. A file that can't be deleted does not fail the run.
    """
    entries = sorted({e["step"]: e for e in _entries(spark, manifest)}.values(), key=lambda e: e["step"])
    if not entries:
        return Applied()
    there = {e["step"]: shared.exists(spark, e["path"]) for e in entries}
    rows = spark.createDataFrame([("run", e["step"], e["metrics"].get(metric), there[e["step"]], shared.size(spark, e["path"])) for e in entries], "run string, step long, metric double, there boolean, bytes long")
    plan = retention_plan(rows.where("there"), policy).unionByName(rows.where("not there").selectExpr("run", "step", "'missing' as action", "'' as reasons"))
    freed = bytes_freed(plan, rows).first()
    done = Applied(bytes_freed=freed.bytes if freed else 0, summary=retention_summary(plan).first().summary)
    for r in plan.orderBy("step").collect():
        getattr(done, r.action).append(r.step)
    if dry_run:
        return done
    of_step, files = {e["step"]: e for e in entries}, shared.Files(spark)
    for step in done.delete:
        _removed(files, of_step[step]["path"])
    shared.replace_text(spark, manifest, json.dumps([of_step[step] for step in done.keep]))
    return done


def _removed(files: shared.Files, path: str) -> bool:
    try:
        return files.delete(path)
    except Exception:  # a file that can't be deleted stays; the next retention meets it again
        return False


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """run, step, seq, path, metrics: the entries of all manifests root/<run>/checkpoints.json, read by Spark."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", MANIFEST).text(root)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    told = files.select(run.alias("run"), F.posexplode(F.from_json("value", ENTRIES)).alias("seq", "e"))
    return told.select("run", "e.step", F.col("seq").cast("long").alias("seq"), "e.path", "e.metrics")


def _sizes(spark: SparkSession, root: str) -> DataFrame:
    """place, bytes of each snapshot, a file or a folder, under root/<run>/: told by the listing, no content is read.

    A session of its own deals the files evenly to tasks, whatever their sizes: by those, and the cost Spark assumes for opening a file, a task would have a few.
    """
    apart = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    apart.conf.set("spark.sql.files.openCostInBytes", 1 << 30)
    apart.conf.set("spark.sql.files.maxPartitionBytes", 1 << 60)
    files = apart.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    kept = F.regexp_extract("path", r"^[a-z0-9]*:?/*(.*?/[^/]+/step-\d+[^/]*)", 1)
    return stored(files.select(kept.alias("place"), "length").where("place <> ''").groupBy("place").agg(F.sum("length").alias("bytes")), spark)


def plan_all(spark: SparkSession, root: str, policy: Retention = Retention(), metric: str = "eval_loss") -> DataFrame:
    """run, step, path, metrics, action, reasons, bytes for the snapshots of all runs under a root: one plan, whatever the number of runs."""
    entries = last_writes(manifests(spark, root))
    place = F.regexp_extract("path", r"^[a-z0-9]*:?/*(.*)$", 1)
    seen = entries.withColumn("place", place).join(_sizes(spark, root), "place", "left")
    rows = seen.select("run", "step", "path", "metrics", F.col("metrics")[metric].alias("metric"), "bytes")
    plan = retention_plan(rows.where("bytes is not null"), policy)
    gone = rows.where("bytes is null").select("run", "step", F.lit("missing").alias("action"), F.lit("").alias("reasons"))
    return plan.unionByName(gone).join(rows.drop("metric"), ["run", "step"])


def retain_all(spark: SparkSession, root: str, policy: Retention = Retention(), metric: str = "eval_loss", threads: int = 16, dry_run: bool = False) -> dict[str, int]:
    """Applies plan_all: snapshots go first, then each touched manifest is replaced by one that names what is kept.

    Tasks delete on a shared local file system, the driver's threads on any other storage, of which executors have no client in Python. A run that is interrupted
    is finished by the next: snapshots that are gone by then are missing and leave the manifest. Returns how many were kept, deleted and missing, and the bytes freed.
    """
    with Scratch(spark) as put:
        plan = put(plan_all(spark, root, policy, metric))
        told = {r.action: r for r in plan.groupBy("action").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()}
        counts = {a: told[a].n if a in told else 0 for a in ("keep", "delete", "missing")} | {"bytes": (told["delete"].b if "delete" in told else 0) or 0}
        if not dry_run and counts["delete"] + counts["missing"]:
            touched = plan.where("action <> 'keep'").select("run").distinct()
            kept = plan.where("action = 'keep'").join(touched, "run", "left_semi").select("run", "step", "path", "metrics")
            entries = F.transform(F.array_sort(F.collect_list(F.struct("step", "path", F.to_json("metrics").alias("metrics")))), lambda e: e)  # a run's kept snapshots
            left = touched.join(kept.groupBy("run").agg(entries.alias("entries")), "run", "left")

            def replace(row) -> None:
                shared.replace_text(spark, f"{root.rstrip('/')}/{row.run}/{MANIFEST}", json.dumps([{"step": e.step, "path": e.path, "metrics": json.loads(e.metrics or "{}")} for e in row.entries or []]))

            shared.delete_all(plan.where("action = 'delete'"), put, threads)
            with ThreadPoolExecutor(threads) as pool:
                for chunk in shared._chunks(left.toLocalIterator()):
                    list(pool.map(replace, chunk))
    return counts


@dataclass
class Checkpoints:
    """Snapshots of a run under root/run, step by step, and their manifest."""

    root: str
    run: str
    policy: Retention | None = None
    metric: str = "eval_loss"

    @property
    def manifest(self) -> str:
        return f"{self.root.rstrip('/')}/{self.run}/{MANIFEST}"

    def save(self, spark: SparkSession, step: int, state: dict, metrics: dict | None = None) -> str:
        """Writes the state and appends it to the manifest; then applies the policy, if there is one."""
        path = f"{self.root.rstrip('/')}/{self.run}/step-{step:06d}.state"
        shared.replace_text(spark, path, json.dumps({**state, "step": step}))
        shared.replace_text(spark, self.manifest, json.dumps([*_entries(spark, self.manifest), {"step": step, "path": path, "metrics": metrics or {}}]))
        if self.policy is not None:
            apply_retention(spark, self.manifest, self.policy, self.metric)
        return path

    def latest(self) -> dict | None:
        """The entry written last."""
        return next(reversed(_entries(SparkSession.active(), self.manifest)), None)

    def load(self, path: str) -> dict:
        return json.loads(shared.read_text(SparkSession.active(), path))

"""Reports of the lint and of drift as JSON and as text. Findings and features are few rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from corpusmill.plans.validate import RANK


class Findings:
    """A lint's findings, collected: one row for each code."""

    def __init__(self, found: DataFrame, examples: int, stats: dict | None = None, path: str = ""):
        self.rows = [r.asDict() for r in found.collect()]
        self.examples, self.stats, self.path = examples, stats or {}, path

    def of(self, severity: str) -> list[dict]:
        return [r for r in self.rows if r["severity"] == severity]

    def at_or_above(self, severity: str) -> list[dict]:
        return [r for r in self.rows if RANK[r["severity"]] >= RANK[severity]]

    @property
    def ok(self) -> bool:
        return not self.of("error")

    def by_code(self, code: str) -> dict | None:
        return next((r for r in self.rows if r["code"] == code), None)

    def has(self, code: str) -> bool:
        return self.by_code(code) is not None

    def to_json(self) -> str:
        return json.dumps({"path": self.path, "num_examples": self.examples, "ok": self.ok, "findings": self.rows, "stats": self.stats})

    def text(self) -> str:
        lines = [f"{self.examples} examples, {len(self.of('error'))} errors, {len(self.of('warning'))} warnings"]
        return "\n".join(lines + [f"{r['severity']:<8}{r['code']:<26}{r['count']} rows, first {', '.join(map(str, r['examples'])) or '-'}" for r in self.rows])


class Drift:
    """A drift report, collected: one row for each feature."""

    def __init__(self, report: DataFrame, baseline: int, candidate: int, notes: list[str] | None = None):
        self.rows = [r.asDict() for r in report.collect()]
        self.baseline, self.candidate, self.notes = baseline, candidate, notes or []

    @property
    def severity(self) -> str:
        return max((r["severity"] for r in self.rows), key=RANK.__getitem__, default="info")

    @property
    def ok(self) -> bool:
        return self.severity != "error"

    def drifted(self) -> list[dict]:
        return [r for r in self.rows if r["severity"] != "info"]

    def to_json(self) -> str:
        return json.dumps({"severity": self.severity, "baseline_rows": self.baseline, "candidate_rows": self.candidate, "notes": self.notes, "features": self.rows})

    def text(self) -> str:
        lines = [f"drift: {self.severity}; {self.baseline} rows against {self.candidate}"]
        lines += [f"{r['severity']:<8}{r['feature']:<16}psi {r['psi']:.3f}, jsd {r['jsd']:.3f}{', ' + r['detail'] if r['detail'] else ''}" for r in self.rows]
        return "\n".join(lines + [f"note: {n}" for n in self.notes])

"""Stages, gates and artifacts of a run, as a JSON manifest and an event log; cycle state that resumes."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.sources.tables import file_digests, load_json, write_json


def now() -> str:
    return datetime.now(UTC).isoformat()


class GateFailed(RuntimeError):
    """A quality gate did not pass."""


class Recorder:
    """Records one run in a folder of the driver."""

    def __init__(self, folder: str | Path, config: dict | None = None):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.manifest = {"run_id": uuid.uuid4().hex, "status": "running", "started_at": now(), "config": config or {}, "stages": [],
            "quality_gates": [], "artifacts": []}
        self._save()

    def _save(self):
        write_json(self.manifest, self.folder / "workflow_manifest.json")

    def event(self, kind: str, **payload) -> None:
        with (self.folder / "workflow_events.jsonl").open("a", encoding="utf-8") as f:
            f.write(json.dumps({"timestamp": now(), "type": kind, **payload}, ensure_ascii=False, default=str) + "\n")

    @contextmanager
    def stage(self, name: str):
        """Times a stage; metrics put into the yielded dict are kept with it."""
        metrics: dict = {}
        row = {"name": name, "status": "running", "started_at": now(), "metrics": metrics}
        self.manifest["stages"].append(row)
        self.event("stage_started", stage=name)
        began = time.monotonic()
        try:
            yield metrics
        except BaseException as e:
            row |= {"status": "failed", "error": repr(e), "elapsed_seconds": time.monotonic() - began}
            self.manifest["status"] = "failed"
            self.event("stage_failed", stage=name, error=repr(e), elapsed_seconds=row["elapsed_seconds"])
            self._save()
            raise
        row |= {"status": "completed", "elapsed_seconds": time.monotonic() - began}
        self.event("stage_completed", stage=name, elapsed_seconds=row["elapsed_seconds"])
        self._save()

    def gate(self, name: str, passed: bool, evidence=None) -> None:
        """Records a check; one that fails ends the run."""
        self.manifest["quality_gates"].append({"name": name, "passed": bool(passed), "evidence": evidence})
        self.event("quality_gate", name=name, passed=bool(passed))
        if not passed:
            self.manifest["status"] = "failed"
        self._save()
        if not passed:
            raise GateFailed(name)

    def collect_artifacts(self, spark: SparkSession, path: str) -> None:
        self.manifest["artifacts"] = [r.asDict() for r in file_digests(spark, path).orderBy("path").collect()]  # one row a file of this run
        self._save()

    def complete(self) -> dict:
        self.manifest |= {"status": "completed", "finished_at": now()}
        self.event("run_completed")
        self._save()
        return self.manifest


class CycleState:
    """Stages of a closed loop; a state that was running or failed is resumed, and a finished stage is not run again."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        old = load_json(self.path, {})
        self.value = old if old.get("status") in ("running", "failed") else {"cycle_id": uuid.uuid4().hex, "started_at": now(), "stages": []}
        self.value["status"] = "running"
        self.save()

    def save(self):
        write_json(self.value, self.path)

    def run(self, name: str, work):
        """Runs a stage once; returns its result, or what was kept of it."""
        for row in self.value["stages"]:
            if row["name"] == name and row["status"] == "completed":
                return row.get("result")
        self.value["stages"] = [r for r in self.value["stages"] if r["name"] != name]
        row = {"name": name, "status": "running", "started_at": now()}
        self.value["stages"].append(row)
        self.save()
        try:
            row["result"] = work()
        except BaseException as e:
            row |= {"status": "failed", "error": repr(e)}
            self.value["status"] = "failed"
            self.save()
            raise
        row |= {"status": "completed", "finished_at": now()}
        self.save()
        return row["result"]

    def finish(self):
        self.value |= {"status": "completed", "finished_at": now()}
        self.save()


def run_seconds(spark: SparkSession, root: str) -> DataFrame:
    """(run, seconds): the summed stage times in the manifests of the run folders below ``root``; no run gives no rows."""
    path, kind = f"{root}/*/record/workflow_manifest.json", "stages array<struct<name string, elapsed_seconds double>>"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], "run string, seconds double")
    kept = spark.read.schema(kind).option("multiLine", True).json(path)
    seconds = F.aggregate(F.coalesce("stages", F.array().cast("array<struct<name:string,elapsed_seconds:double>>")), F.lit(0.0), lambda s,
        x: s + F.coalesce(x["elapsed_seconds"], F.lit(0.0)))
    return kept.select(F.element_at(F.split("_metadata.file_path", "/"), -3).alias("run"), seconds.alias("seconds"))

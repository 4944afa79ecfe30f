"""Linear jobs: named steps in order, each a monitored run within its time; a failure
ends the job. `wired_*` are the jobs over specs, each step with what it calls."""

from __future__ import annotations

import os
import shlex
import subprocess
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.operators import expectations, history, monitoring
from lodestrata.operators.monitoring import RunLog, monitored
from lodestrata.plans.table import VersionedTable
from lodestrata.sources.specs import EntitySpec, MaintenanceSpec
from lodestrata.streaming.conformed import await_all
from lodestrata.streaming.runner import start_entities


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[], object]
    limit_minutes: float = 40


class JobFailed(RuntimeError):
    pass


def within(minutes: float, call: Callable[[], object], spark: SparkSession | None = None) -> object:
    """call()'s result. After so many minutes its Spark jobs are cancelled and
    TimeoutError is raised; what it does besides Spark can't be ended from here."""
    group, out = uuid.uuid4().hex, {}

    def run() -> None:
        try:
            if spark is not None:
                spark.sparkContext.setJobGroup(group, f"limit {minutes} minutes", interruptOnCancel=True)
            out["value"] = call()
        except BaseException as error:
            out["error"] = error

    thread = (InheritableThread if spark is not None else threading.Thread)(target=run, daemon=True)
    thread.start()
    thread.join(60 * minutes)
    if thread.is_alive():
        if spark is not None:
            spark.sparkContext.cancelJobGroup(group)
        raise TimeoutError(f"not done after {minutes} minutes")
    if "error" in out:
        raise out["error"]
    return out["value"]


def _checked(step: Step, spark: SparkSession | None = None) -> object:
    """The step's result; an exit code other than 0 is a failure."""
    out = within(step.limit_minutes, step.run, spark)
    if isinstance(out, int) and not isinstance(out, bool) and out != 0:
        raise JobFailed(f"{step.name} ended with {out}")
    return out


def run_job(name: str, steps: list[Step], log: RunLog) -> list[tuple[str, str]]:
    """(step, state) of all steps; raises JobFailed, with those, at the first failure."""
    states: list[tuple[str, str]] = []
    for k, step in enumerate(steps):
        try:
            monitored(log, f"{name}.{step.name}")(_checked)(step, log.spark)
            states.append((step.name, "succeeded"))
        except Exception as error:
            states += [(step.name, "failed"), *((s.name, "skipped") for s in steps[k + 1 :])]
            raise JobFailed(states) from error
    return states


def hourly(freshness: Callable, merge: Callable, gate: Callable) -> list[Step]:
    return [Step("freshness", freshness, 10), Step("merge", merge, 40), Step("quality_gate", gate, 20)]


def nightly(reconcile: Callable, optimize: Callable) -> list[Step]:
    return [Step("reconcile", reconcile, 10), Step("optimize", optimize, 180)]


def backfill(raw: Callable, conformed: Callable) -> list[Step]:
    return [Step("raw", raw, 360), Step("conformed", conformed, 360)]


def merge_entities(spark: SparkSession, specs: list[EntitySpec], root: str, key: bytes | None = None) -> dict[str, int]:
    """Bring the conformed tables up to date with their raw tables, once."""
    queries = start_entities(spark, specs, root, key, available_now=True)
    await_all(spark, list(queries.values()))
    return {"rows_written": sum(p["numInputRows"] for q in queries.values() for p in q.recentProgress)}


def rebuild_entity(spark: SparkSession, spec: EntitySpec, since: str | None = None) -> dict[str, int]:
    """Fold all rows of the raw table (since a date of _date, if given) into the target."""
    from lodestrata.streaming.conformed import conform_batch

    raw = VersionedTable(spark, spec.source, ("_date",)).read(between={"_date": (since, None)} if since else None)
    rows, _ = conform_batch(raw, spec)
    fold = lambda current, new: history.record_history(current, new, list(spec.keys), F.current_timestamp()) if spec.history == 2 else history.upsert(current, new, list(spec.keys), spec.order_column)
    VersionedTable(spark, spec.target).merge(fold, rows, None, list(spec.keys), F.col("_is_current") if spec.history == 2 else None)
    return {"rows_written": rows.count()}


def check_freshness(states: DataFrame, slas: DataFrame) -> int:
    """1 if a pipeline is late by more than half its SLA, else 0."""
    return int(not monitoring.freshness(states, slas, F.current_timestamp()).where("verdict = 'P1'").isEmpty())


def maintain(spark: SparkSession, specs: list[MaintenanceSpec]) -> list[dict]:
    """Optimize and vacuum each table; a table that fails keeps no other from its turn."""
    out = []
    for spec in specs:
        done = {"path": spec.path, "error": None}
        try:
            table = VersionedTable(spark, spec.path)
            done |= table.optimize(list(spec.z_order) or None, spec.target_mb << 20, spec.where)
            done["vacuumed"] = len(table.vacuum(spec.vacuum_hours, dry_run=False)) if spec.vacuum_hours else 0
        except Exception as error:
            done["error"] = f"{type(error).__name__}: {error}"[:300]
        out.append(done)
    return out


def wired_hourly(spark: SparkSession, specs: list[EntitySpec], root: str, monitor: monitoring.Monitor, gated: list[dict]) -> list[Step]:
    """Freshness of the pipelines, the merges, and the quality gate over tables
    (path, suite, layer)."""

    def freshness() -> int:
        return check_freshness(monitoring.run_states(monitor.log.table.read()), monitor.slas) if monitor.log.table.exists() else 0

    def gate() -> int:
        return expectations.gate(gated, lambda path: VersionedTable(spark, path).read())[0]

    return hourly(freshness, lambda: merge_entities(spark, specs, root), gate)


def wired_nightly(spark: SparkSession, monitor: monitoring.Monitor, specs: list[MaintenanceSpec]) -> list[Step]:
    def optimize() -> int:
        return int(any(x["error"] for x in maintain(spark, specs)))

    return nightly(lambda: {"rows_written": monitor.reconcile()}, optimize)


def submit(command: list[str], overlay: dict[str, str] | None = None, minutes: float = 60) -> int:
    """Run a command with settings laid over the environment; its exit code, 124 if it
    isn't done after so many minutes (it is ended then)."""
    try:
        return subprocess.run(command, env=os.environ | (overlay or {}), timeout=60 * minutes, check=False).returncode
    except subprocess.TimeoutExpired:
        return 124


def submit_command(script: str, packages: list[str] = (), conf: dict[str, str] | None = None, arguments: list[str] = ()) -> list[str]:
    """A spark-submit command line for a script file."""
    out = ["spark-submit"]
    if packages:
        out += ["--packages", ",".join(packages)]
    for k, v in (conf or {}).items():
        out += ["--conf", f"{k}={v}"]
    return [*out, script, *arguments]


def printable(command: list[str]) -> str:
    return shlex.join(command)

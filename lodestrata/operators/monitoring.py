"""Run monitoring over tables of runs, set-wise for all pipelines at once.

Runs are appended as rows (a `running` one at the start, one at the end); the
state of a run is its last row by `recorded_at`.
"""

from __future__ import annotations

import functools
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestrata.operators.conform import latest

RUNS = "run_id string, pipeline_name string, dag_id string, started_at_utc timestamp, ended_at_utc timestamp, duration_seconds double, status string, rows_read long, rows_written long, rows_errored long, error_message string, source_table string, target_table string, spark_job_id string, extra_json string, recorded_at timestamp"
ANOMALIES = "anomaly_id string, pipeline_name string, run_id string, anomaly_type string, detected_at_utc timestamp, severity string, observed_value double, expected_value double, z_score double, description string"
INCIDENTS = "incident_id string, pipeline_name string, run_id string, severity string, fired_at_utc timestamp, title string, description string, dedup_key string, sinks array<string>, codes map<string,int>"
RANK = {"P1": 1, "P2": 2, "P3": 3}
ROLLING, LEAST_HISTORY = 30, 7
SEASONAL_LEAST, ALL_LEAST = 8, 4
#: Seasonality -> what a bucket's values share besides the pipeline.
SEASONS = {"day_of_week_hour": ["_weekday", "_hour"], "hour_of_day": ["_hour"], "none": []}


def run_states(runs: DataFrame) -> DataFrame:
    return latest(runs, ["run_id"], ["recorded_at"])


def z_score(value: Column, mean: Column, stdev: Column, n: Column) -> Column:
    """Standard score by the sample deviation; of one value it is 0. Without
    deviation: 0 at the mean, else infinite. Null without history."""
    s = F.when(n == 1, F.lit(0.0)).otherwise(stdev)
    return F.when(n == 0, None).when(s == 0, F.when(value == mean, 0.0).when(value > mean, float("inf")).otherwise(float("-inf"))).otherwise((value - mean) / s)


def rolling_scores(runs: DataFrame, value: str, rows: int = ROLLING) -> DataFrame:
    """runs with n, mean, stdev of the last `rows` runs before each of its pipeline, and z."""
    w = Window.partitionBy("pipeline_name").orderBy("started_at_utc", "run_id").rowsBetween(-rows, -1)
    v = F.col(value).cast("double")
    scored = runs.withColumns({"n": F.count(v).over(w), "mean": F.avg(v).over(w), "stdev": F.stddev_samp(v).over(w)})
    return scored.withColumn("z", z_score(v, F.col("mean"), F.col("stdev"), F.col("n")))


def volume_anomalies(runs: DataFrame) -> DataFrame:
    """Succeeded runs whose volume is over 3 deviations off (P2), or over 5 (P1), with enough history."""
    z = rolling_scores(runs.where("status = 'succeeded'"), "rows_written").where((F.col("n") >= LEAST_HISTORY) & (F.abs("z") > 3))
    return z.select("run_id", "pipeline_name", F.when(F.col("z") < 0, "volume_drop").otherwise("volume_spike").alias("anomaly_type"), F.when(F.abs("z") > 5, "P1").otherwise("P2").alias("severity"), F.col("rows_written").cast("double").alias("observed_value"), F.col("mean").alias("expected_value"), F.col("z").alias("z_score"))


def duration_anomalies(runs: DataFrame) -> DataFrame:
    """The same for durations, slow ones only."""
    z = rolling_scores(runs.where("status = 'succeeded'"), "duration_seconds").where((F.col("n") >= LEAST_HISTORY) & (F.col("z") > 3))
    return z.select("run_id", "pipeline_name", F.lit("duration_anomaly").alias("anomaly_type"), F.when(F.col("z") > 5, "P1").otherwise("P2").alias("severity"), F.col("duration_seconds").alias("observed_value"), F.col("mean").alias("expected_value"), F.col("z").alias("z_score"))


def run_checks(states: DataFrame, slas: DataFrame) -> DataFrame:
    """Incidents of finished runs: failures (P1), too few rows and too long runs (P2)."""
    joined = states.join(slas, "pipeline_name", "left")
    checks = {"run_failed": (F.col("status") == "failed", "P1"), "min_rows": ((F.col("status") == "succeeded") & (F.col("rows_written") < F.col("min_rows")), "P2"), "max_duration": (F.col("duration_seconds") > 60 * F.col("max_duration_minutes"), "P2")}
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(name).alias("anomaly_type"), F.lit(level).alias("severity"))) for name, (cond, level) in checks.items())))
    return joined.select("run_id", "pipeline_name", F.explode(found).alias("c")).select("run_id", "pipeline_name", "c.*")


def seasonal_scores(series: DataFrame, at: Column, seasonality: str = "day_of_week_hour", most: float = 3.0) -> DataFrame:
    """series (pipeline_name, ts, value) with a robust score against the values of
    the same bucket of SEASONS (if there are SEASONAL_LEAST), else against all of the
    pipeline's (if ALL_LEAST), else null, and the verdict is_anomalous: whether the
    score is over `most` either way (false without a score). `at`: rows before it
    are history."""
    rows = series.withColumns({"_weekday": F.weekday("ts"), "_hour": F.hour("ts")})
    past = rows.where(F.col("ts") < at)
    centres = []
    for keys, name in ((["pipeline_name", *SEASONS[seasonality]], "seasonal"), (["pipeline_name"], "all")):
        med = past.groupBy(*keys).agg(F.count("value").alias(f"{name}_n"), F.median("value").alias(f"{name}_median"))
        dev = past.join(med, keys).groupBy(*keys).agg(F.median(F.abs(F.col("value") - F.col(f"{name}_median"))).alias(f"{name}_mad"))
        centres.append((keys, med.join(dev, keys)))
    out = rows.where(F.col("ts") >= at)
    for keys, centre in centres:
        out = out.join(centre, keys, "left")
    seasonal = F.coalesce(F.col("seasonal_n") >= SEASONAL_LEAST, F.lit(False))
    enough = F.coalesce(F.col("all_n") >= ALL_LEAST, F.lit(False))
    pick = lambda what: F.when(seasonal, F.col(f"seasonal_{what}")).when(enough, F.col(f"all_{what}"))
    out = out.withColumns({"basis": F.when(seasonal, "seasonal").when(enough, "all"), "median": pick("median"), "mad": pick("mad")})
    scored = out.withColumn("score", robust_score(F.col("value"), F.col("median"), F.col("mad")))
    return scored.withColumn("is_anomalous", F.coalesce(F.abs("score") > most, F.lit(False))).drop("_weekday", "_hour", *(f"{a}_{b}" for a in ("seasonal", "all") for b in ("n", "median", "mad")))


def robust_score(value: Column, median: Column, mad: Column) -> Column:
    return F.when(mad == 0, F.when(value == median, 0.0).otherwise(float("inf"))).otherwise(F.lit(0.6745) * (value - median) / mad)


def freshness(states: DataFrame, slas: DataFrame, as_of: Column) -> DataFrame:
    """Each pipeline of the SLA table: minutes since its last success and the
    verdict ok, P2 (late), P1 (late by over half the SLA) or never_succeeded."""
    last = states.where("status = 'succeeded'").groupBy("pipeline_name").agg(F.max("ended_at_utc").alias("last_success"))
    age = (F.unix_micros(as_of) - F.unix_micros("last_success")) / F.lit(60e6)
    limit = F.col("freshness_sla_minutes")
    verdict = F.when(F.col("last_success").isNull(), "never_succeeded").when(age <= limit, "ok").when(age - limit > 0.5 * limit, "P1").otherwise("P2")
    return slas.join(last, "pipeline_name", "left").select("pipeline_name", "last_success", age.alias("age_minutes"), "freshness_sla_minutes", verdict.alias("verdict"))


def stale_runs(runs: DataFrame, as_of: Column, minutes: int = 120, days: int = 7, most: int = 100) -> DataFrame:
    """Runs of the last days that still run after `minutes`; the `most` oldest."""
    states = run_states(runs)
    age = F.unix_micros(as_of) - F.unix_micros("started_at_utc")
    return states.where((F.col("status") == "running") & (age > minutes * 60_000_000) & (age <= days * 86_400_000_000)).orderBy("started_at_utc", "run_id").limit(most)


def superseding(stale: DataFrame, as_of: Column) -> DataFrame:
    """Rows that mark stale runs as failed; appended, they are the runs' last."""
    seconds = (F.unix_micros(as_of) - F.unix_micros("started_at_utc")) / F.lit(1e6)
    return stale.withColumns({"status": F.lit("failed"), "ended_at_utc": as_of.cast("timestamp"), "duration_seconds": seconds, "error_message": F.lit("no end was recorded"), "recorded_at": as_of.cast("timestamp")})


def health(runs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Counts, success rate and durations of each pipeline's runs of the last hours."""
    states = run_states(runs).where(F.unix_micros("started_at_utc") >= F.unix_micros(as_of) - hours * 3_600_000_000)
    done = F.count_if(F.col("status") == "succeeded")
    return states.groupBy("pipeline_name").agg(
        F.count("*").alias("runs"), done.alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(done / F.count("*"), 4).alias("success_rate"), F.avg("duration_seconds").alias("avg_duration"), F.max("duration_seconds").alias("max_duration"), F.min("duration_seconds").alias("min_duration"),
    )


def newest(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return anomalies.orderBy(F.desc("detected_at_utc"), "anomaly_id").limit(n)


def incidents(anomalies: DataFrame, at: Column, pager: str = "P1", chat: str = "P2") -> DataFrame:
    """An incident of each anomaly at P2 or worse, with the sinks it goes to: all
    are stored, those at `chat` or worse are posted, those at `pager` or worse page."""
    rank = F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))[F.col("severity")]
    sinks = F.array_compact(F.array(F.lit("store"), F.when(rank <= RANK[chat], "chat"), F.when(rank <= RANK[pager], "pager")))
    return anomalies.where(rank <= RANK["P2"]).select("pipeline_name", "run_id", "severity", at.alias("fired_at_utc"), F.col("anomaly_type").alias("title"), F.concat_ws("-", F.lit("pipeline"), "pipeline_name", "anomaly_type").alias("dedup_key"), sinks.alias("sinks"))


def run_anomalies(states: DataFrame) -> DataFrame:
    """Volume and duration anomalies of all runs, in one frame."""
    return volume_anomalies(states).unionByName(duration_anomalies(states))


def post_run_checks(states: DataFrame, slas: DataFrame) -> DataFrame:
    """The five checks of finished runs: failure, least rows, greatest duration, and the
    two anomalies. Checks against an SLA have no score."""
    columns = ("run_id", "pipeline_name", "anomaly_type", "severity", "observed_value", "expected_value", "z_score")
    ruled = run_checks(states, slas)
    return run_anomalies(states).select(*columns).unionByName(ruled.select(*(F.col(c) if c in ruled.columns else F.lit(None).cast("double").alias(c) for c in columns)))


class Monitor:
    """The monitoring tables under a folder, divided by day: runs, anomalies, incidents,
    scores. Whole frames are appended; `sinks` (by name) get incidents one by one."""

    def __init__(self, spark: SparkSession, root: str, slas: DataFrame | None = None, sinks: dict | None = None, clock=lambda: datetime.now(timezone.utc)):
        from lodestrata.plans.table import VersionedTable

        self.spark, self.clock, self.sinks = spark, clock, sinks or {}
        self.slas = spark.createDataFrame([], "pipeline_name string, freshness_sla_minutes int, max_duration_minutes int, min_rows long") if slas is None else slas
        self.tables = {name: VersionedTable(spark, f"{root}/{name}", ("day",)) for name in ("anomalies", "incidents", "scores")}
        self.log = RunLog(spark, f"{root}/runs", clock)

    def _add(self, name: str, rows: DataFrame, at: Column) -> None:
        self.tables[name].append(rows.withColumn("day", F.to_date(at)))

    def add_anomalies(self, found: DataFrame, at: Column) -> None:
        """Store what checks found."""
        told = F.concat_ws(" ", "anomaly_type", F.lit("of"), "pipeline_name")
        self._add("anomalies", found.select(F.expr("uuid()").alias("anomaly_id"), "pipeline_name", "run_id", "anomaly_type", at.alias("detected_at_utc"), "severity", "observed_value", "expected_value", "z_score", told.alias("description")), at)

    def add_incidents(self, found: DataFrame, at: Column) -> list[dict]:
        """Store the incidents of what checks found, and hand those of them that name a
        known sink to it; they are few, since a run has five checks."""
        rows = incidents(found, at).withColumns({"incident_id": F.expr("uuid()"), "description": F.concat_ws(" ", "title", F.lit("of"), "pipeline_name")})
        from lodestrata.operators.sinks import deliver

        sent = deliver([r.asDict() for r in rows.collect()], {"store": lambda _: 0, **self.sinks})
        names = ("incident_id", "pipeline_name", "run_id", "severity", "fired_at_utc", "title", "description", "dedup_key", "sinks", "codes")
        if sent:
            self._add("incidents", self.spark.createDataFrame([tuple(x.get(n) for n in names) for x in sent], INCIDENTS), at)
        return sent

    def add_score(self, report, at: datetime, run_id: str | None = None, path: str | None = None) -> None:
        """Store the score of a quality report."""
        n = len(report.outcomes)
        good = sum(o.success for o in report.outcomes)
        ddl = "run_id string, dataset_name string, suite_name string, layer string, evaluated_at_utc timestamp, data_quality_score double, threshold double, passed_threshold boolean, severity string, total_expectations long, passed_expectations long, failed_expectations long, row_count long, report_path string"
        row = (run_id or uuid.uuid4().hex, report.dataset, report.suite, report.layer, at, report.score, report.threshold, report.passed, report.severity, n, good, n - good, report.row_count, path)
        self._add("scores", self.spark.createDataFrame([row], ddl), F.col("evaluated_at_utc"))

    def end(self, run: str, status: str = "succeeded", **facts) -> list[dict]:
        """End a run, check it, store what was found, and tell the sinks; the incidents."""
        name = self.log.open[run]["pipeline_name"] if run in self.log.open else None
        self.log.end(run, status, **facts)
        states = run_states(self.log.table.read().where(F.col("pipeline_name") == name))
        found = post_run_checks(states, self.slas).where(F.col("run_id") == run).persist()
        at = F.lit(self.clock())
        try:
            self.add_anomalies(found, at)
            return self.add_incidents(found, at)
        finally:
            found.unpersist()

    def reconcile(self, minutes: int = 120) -> int:
        """Mark runs that never ended as failed, with an incident (P2) each; how many."""
        now = F.lit(self.clock()).cast("timestamp")
        if not self.log.table.exists():
            return 0
        stale = stale_runs(self.log.table.read(), now, minutes).persist()
        try:
            n = stale.count()
            if n:
                found = stale.select("run_id", "pipeline_name", F.lit("stale_run").alias("anomaly_type"), F.lit("P2").alias("severity"), *(F.lit(None).cast("double").alias(c) for c in ("observed_value", "expected_value", "z_score")))
                self.add_anomalies(found, now)
                self.add_incidents(found, now)
                self.log.table.append(superseding(stale, now))
        finally:
            stale.unpersist()
        return n


class RunLog:
    """Start and end rows of runs, appended to a versioned table that is divided by day."""

    def __init__(self, spark: SparkSession, path: str, clock=lambda: datetime.now(timezone.utc)):
        from lodestrata.plans.table import VersionedTable

        self.spark, self.table, self.clock, self.open = spark, VersionedTable(spark, path, ("day",)), clock, {}

    def _put(self, **values) -> None:
        names = [x.strip().split(" ")[0] for x in RUNS.split(",")]
        row = self.spark.createDataFrame([tuple(values.get(n) for n in names)], RUNS)
        self.table.append(row.withColumn("day", F.to_date("started_at_utc")))

    def start(self, pipeline: str, **facts) -> str:
        run = uuid.uuid4().hex
        row = {"run_id": run, "pipeline_name": pipeline, "started_at_utc": self.clock(), "status": "running", "rows_read": 0, "rows_written": 0, "rows_errored": 0} | facts
        self.open[run] = row
        self._put(**row, recorded_at=self.clock())
        return run

    def end(self, run: str, status: str = "succeeded", extra: dict | None = None, **facts) -> None:
        if run not in self.open:
            raise KeyError(f"no run {run} is open")
        row, now = self.open.pop(run), self.clock()
        self._put(**row | {"status": status, "ended_at_utc": now, "duration_seconds": (now - row["started_at_utc"]).total_seconds(), "extra_json": json.dumps(extra or {})} | facts, recorded_at=now)


def monitored(log: RunLog, pipeline: str):
    """Decorator: a call is a run; if it returns a dict, that holds the run's facts."""

    def wrap(job):
        @functools.wraps(job)
        def call(*args, **kwargs):
            run = log.start(pipeline)
            try:
                out = job(*args, **kwargs)
            except Exception as error:
                log.end(run, "failed", error_message=str(error)[:1000])
                raise
            log.end(run, **{k: v for k, v in out.items() if k.startswith("rows_")} if isinstance(out, dict) else {})
            return out

        return call

    return wrap

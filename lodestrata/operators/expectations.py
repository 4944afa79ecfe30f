"""Data quality: a suite of expectations compiled into one fused aggregation.

Row-level checks count violations; nulls violate only not-null and otherwise take
no part. Distinct counts don't ride in the fused aggregation (Spark would expand
every row once per distinct column): all unique checks are one second pass, which
counts values by column and then the columns' values.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

THRESHOLDS = {"bronze": 0.90, "silver": 0.95, "gold": 0.99}
P1, P2, P3 = "P1", "P2", "P3"
RESULT = "expectation_type string, column string, success boolean, observed_value string, element_count long, unexpected_count long, unexpected_percent double, details map<string,string>"


@dataclass
class Outcome:
    expectation_type: str
    column: str | None
    success: bool
    observed_value: str | None = None
    element_count: int = 0
    unexpected_count: int = 0
    unexpected_percent: float = 0.0
    details: dict = field(default_factory=dict)


@dataclass
class Report:
    dataset: str
    suite: str
    layer: str
    score: float
    threshold: float
    passed: bool
    severity: str
    row_count: int
    outcomes: list[Outcome]

    def as_dict(self) -> dict:
        return asdict(self)


def number(column: str) -> Column:
    """The value as a double; null where it isn't one."""
    return F.col(f"`{column}`").try_cast("double")


def violation(kind: str, kw: dict) -> Column:
    """Whether a row violates a row-level expectation."""
    name = kw["column"]
    c = F.col(f"`{name}`")
    if kind == "expect_column_values_to_not_be_null":
        return c.isNull()
    if kind == "expect_column_values_to_be_in_set":
        return c.isNotNull() & ~c.cast("string").isin([str(x) for x in kw["value_set"]])
    if kind == "expect_column_values_to_match_regex":
        return c.isNotNull() & ~c.cast("string").rlike(f"^(?:{kw['regex']})")
    if kind == "expect_column_values_to_be_between":
        n, low, high = number(name), kw.get("min_value"), kw.get("max_value")
        bad = n.isNull()
        if low is not None:
            bad |= n < low
        if high is not None:
            bad |= n > high
        return c.isNotNull() & bad
    raise KeyError(kind)


ROW_LEVEL = ("expect_column_values_to_not_be_null", "expect_column_values_to_be_in_set", "expect_column_values_to_match_regex", "expect_column_values_to_be_between")
AGGREGATES: dict[str, Callable[[str], Column]] = {"expect_column_mean_to_be_between": lambda c: F.avg(number(c)), "expect_column_sum_to_be_between": lambda c: F.sum(number(c))}


def within(value, low, high) -> bool:
    return value is not None and (low is None or value >= low) and (high is None or value <= high)


def _static(df: DataFrame, kind: str, kw: dict) -> Outcome | None:
    """Expectations on the schema; they read no rows."""
    if kind == "expect_column_to_exist":
        return Outcome(kind, kw["column"], kw["column"] in df.columns, str(kw["column"] in df.columns).lower())
    if kind == "expect_table_columns_to_match_ordered_list":
        return Outcome(kind, None, df.columns == list(kw["column_list"]), json.dumps(df.columns))
    if kind == "expect_column_values_to_be_of_type":
        dtype = dict(df.dtypes).get(kw["column"])
        if dtype is None:
            return Outcome(kind, kw["column"], False, details={"evaluation_error": "no such column"})
        return Outcome(kind, kw["column"], kw["type_"].lower() in dtype.lower(), dtype)
    return None


def evaluate(df: DataFrame, expectations: list[dict]) -> tuple[list[Outcome], int]:
    """An outcome for each expectation, in order, and the number of rows. An
    unknown type, a missing argument or column fails that expectation only."""
    out: dict[int, Outcome] = {}
    exprs: list[Column] = [F.count("*").alias("n")]
    later: list[tuple[int, str, dict]] = []
    for i, e in enumerate(expectations):
        kind, kw = e.get("expectation_type", ""), e.get("kwargs", {})
        try:
            found = _static(df, kind, kw)
            if found:
                out[i] = found
                continue
            if "column" in kw and kw["column"] not in df.columns:
                raise KeyError(f"no column {kw['column']}")
            if kind in ROW_LEVEL:
                exprs += [F.count_if(violation(kind, kw)).alias(f"v{i}"), F.count(f"`{kw['column']}`").alias(f"c{i}")]
                if kind.endswith("between"):
                    exprs += [F.min(number(kw["column"])).alias(f"l{i}"), F.max(number(kw["column"])).alias(f"h{i}")]
            elif kind == "expect_column_values_to_be_unique":
                exprs.append(F.count(f"`{kw['column']}`").alias(f"c{i}"))
            elif kind in AGGREGATES:
                exprs.append(AGGREGATES[kind](kw["column"]).alias(f"a{i}"))
            elif kind != "expect_table_row_count_to_be_between":
                raise KeyError(f"unsupported expectation {kind}")
            later.append((i, kind, kw))
        except (KeyError, TypeError) as error:
            out[i] = Outcome(kind, kw.get("column"), False, details={"evaluation_error": str(error)})
    row = df.agg(*exprs).first().asDict()
    n = row["n"]
    distinct = distinct_counts(df, sorted({kw["column"] for _, kind, kw in later if kind == "expect_column_values_to_be_unique"}))
    for i, kind, kw in later:
        column = kw.get("column")
        if kind == "expect_table_row_count_to_be_between":
            out[i] = Outcome(kind, None, within(n, kw.get("min_value", 0), kw.get("max_value")), str(n), n)
        elif kind in AGGREGATES:
            out[i] = Outcome(kind, column, within(row[f"a{i}"], kw.get("min_value"), kw.get("max_value")), None if row[f"a{i}"] is None else repr(row[f"a{i}"]), n)
        else:
            present = row[f"c{i}"]
            if kind == "expect_column_values_to_be_unique":
                bad, base = present - distinct[column], n
            else:
                bad, base = row[f"v{i}"], n if kind == ROW_LEVEL[0] else present
            share = 1.0 if not base else (base - bad) / base
            observed = {"min": row[f"l{i}"], "max": row[f"h{i}"]} if kind.endswith("between") else {"regex": kw.get("regex"), "match_rate": share} if kind.endswith("regex") else share
            out[i] = Outcome(kind, column, share >= kw.get("mostly", 1.0), json.dumps(observed), base, bad, 0.0 if not base else 100.0 * bad / base)
    return [out[i] for i in range(len(expectations))], n


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How many different values, but null, each column has; one pass over all of them."""
    if not columns:
        return {}
    if len(columns) == 1:
        return {columns[0]: df.select(f"`{columns[0]}`").where(F.col(f"`{columns[0]}`").isNotNull()).distinct().count()}
    values = [F.struct(F.lit(i).alias("i"), (F.hex(c) if kind == "binary" else c.cast("string") if not kind.startswith(("array", "map", "struct")) else F.when(c.isNotNull(), F.to_json(F.struct(c)))).alias("v")) for i, (c, kind) in enumerate((F.col(f"`{x}`"), dict(df.dtypes)[x]) for x in columns)]
    each = df.select(F.explode(F.array(*values)).alias("x")).select("x.i", "x.v").where("v is not null")
    found = each.groupBy("i", "v").agg(F.lit(1)).groupBy("i").agg(F.count("*").alias("n")).collect()  # a row a column
    return dict.fromkeys(columns, 0) | {columns[r["i"]]: r["n"] for r in found}


def score(outcomes: list[Outcome]) -> float:
    return sum(o.success for o in outcomes) / len(outcomes) if outcomes else 0.0


def severity(value: float, threshold: float) -> str:
    return P3 if value >= threshold else P2 if value >= threshold - 0.05 else P1


def validate(df: DataFrame, suite: dict, dataset: str, layer: str = "silver", threshold: float | None = None, raise_on_failure: bool = False) -> Report:
    """Evaluate a suite and judge its score. Raises only below the threshold, at P1, and if asked."""
    outcomes, n = evaluate(df, suite["expectations"])
    limit, value = THRESHOLDS[layer] if threshold is None else threshold, score(outcomes)
    report = Report(dataset, suite.get("name", ""), layer, value, limit, value >= limit, severity(value, limit), n, outcomes)
    if raise_on_failure and not report.passed and report.severity == P1:
        raise ValueError(f"{dataset}: quality {value:.4f} is below {limit}")
    return report


def results_frame(spark: SparkSession, report: Report) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(o)[k] if k != "details" else {a: str(b) for a, b in o.details.items()} for k in ("expectation_type", "column", "success", "observed_value", "element_count", "unexpected_count", "unexpected_percent", "details")) for o in report.outcomes], RESULT)


def violations(df: DataFrame, expectations: list[dict]) -> DataFrame:
    """The violating rows with violated_expectations: the names `type:column`. Unique
    checks mark every row of a repeated value. Lazy; no row-level check, no rows."""
    flags, rows = [], df
    for i, e in enumerate(expectations):
        kind, kw = e["expectation_type"], e.get("kwargs", {})
        label = F.lit(f"{kind}:{kw.get('column')}")
        if kw.get("column") not in df.columns:
            continue
        if kind in ROW_LEVEL:
            flags.append(F.when(violation(kind, kw), label))
        elif kind == "expect_column_values_to_be_unique":
            c = F.col(f"`{kw['column']}`")
            rows = rows.withColumn(f"_u{i}", F.count(c).over(Window.partitionBy(c)))
            flags.append(F.when(c.isNotNull() & (F.col(f"_u{i}") > 1), label))
    names = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    marked = rows.withColumn("violated_expectations", names).select(*df.columns, "violated_expectations")
    return marked.where(F.size("violated_expectations") > 0) if flags else marked.limit(0)


def sampled(df: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """A Bernoulli sample, for an approximate look at a suite."""
    return df.sample(fraction=fraction, seed=seed)


def load_suite(folder: str, name: str) -> dict:
    path = Path(folder) / f"{name}.json"
    if not path.exists():
        raise FileNotFoundError(f"no suite {name}; there are: {', '.join(sorted(p.stem for p in Path(folder).glob('*.json')))}")
    return json.loads(path.read_text()) | {"name": name}


def load_all(folder: str) -> dict[str, dict]:
    """All suites of a folder by name."""
    return {p.stem: load_suite(folder, p.stem) for p in sorted(Path(folder).glob("*.json"))}


def write_report(spark: SparkSession, report: Report, folder: str) -> tuple[str, str]:
    """The report as JSON and as a small page; their paths. Written wherever Spark writes."""
    from html import escape

    from lodestrata.plans.files import Files

    base, disk = f"{folder.rstrip('/')}/{report.dataset}-{report.suite or 'suite'}", Files(spark)
    cells = "".join(f"<tr><td>{escape(o.expectation_type)}</td><td>{escape(o.column or '')}</td><td>{'ok' if o.success else 'failed'}</td><td>{o.unexpected_count}</td></tr>" for o in report.outcomes)
    disk.write(f"{base}.json", json.dumps(report.as_dict(), indent=2))
    disk.write(f"{base}.html", f"<h1>{escape(report.dataset)}: {report.score:.4f} ({report.severity})</h1><table>{cells}</table>")
    return f"{base}.json", f"{base}.html"


def run_suite(df: DataFrame, suite: dict | str, dataset: str, layer: str = "silver", threshold: float | None = None, folder: str = "", reports: str = "", monitor=None, run_id: str | None = None, raise_on_failure: bool = False) -> Report:
    """A validation as a whole: load the suite (a name in `folder`, or itself), evaluate
    it, write the report, store the score, alert below the threshold, and then raise if
    that is at P1 and asked for."""
    suite = load_suite(folder, suite) if isinstance(suite, str) else suite
    spark = df.sparkSession
    report = validate(df, suite, dataset, layer, threshold)
    path = write_report(spark, report, reports)[0] if reports else None
    if monitor is not None:
        monitor.add_score(report, monitor.clock(), run_id, path)
        if not report.passed:
            found = spark.createDataFrame([(run_id, dataset, "quality_below_threshold", report.severity, report.score, report.threshold, None)], "run_id string, pipeline_name string, anomaly_type string, severity string, observed_value double, expected_value double, z_score double")
            monitor.add_anomalies(found, F.lit(monitor.clock()))
            monitor.add_incidents(found, F.lit(monitor.clock()))
    if raise_on_failure and not report.passed and report.severity == P1:
        raise ValueError(f"{dataset}: quality {report.score:.4f} is below {report.threshold}")
    return report


def gate(tables: list[dict], read: Callable[[str], DataFrame]) -> tuple[int, list[dict]]:
    """Exit code and a verdict for each table (path, suite, layer): 1 if any is at
    P1 below its threshold or can't be evaluated; no tables pass."""
    verdicts = []
    for t in tables:
        try:
            report = validate(read(t["path"]), t["suite"], t["path"], t.get("layer", "silver"), t.get("threshold"))
            verdicts.append({"path": t["path"], "score": report.score, "severity": report.severity, "error": None, "blocks": not report.passed and report.severity == P1})
        except Exception as error:
            verdicts.append({"path": t["path"], "score": None, "severity": P1, "error": str(error), "blocks": True})
    return int(any(v["blocks"] for v in verdicts)), verdicts


def score_history(scores: DataFrame, dataset: str, as_of: Column, days: int = 30) -> DataFrame:
    """A dataset's scores of the last days, newest first."""
    return scores.where((F.col("dataset_name") == dataset) & (F.col("evaluated_at_utc") >= as_of - F.make_dt_interval(F.lit(days)))).orderBy(F.desc("evaluated_at_utc"), "run_id")

"""Where rows and alerts go: partitioned files, alert payloads, exposition text."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HOURLY = ("year", "month", "day", "hour")


def with_hour_columns(df: DataFrame, at: Column) -> DataFrame:
    """The partition columns of an instant (UTC), months to hours with two digits."""
    return df.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd"), "hour": F.date_format(at, "HH")})


def write_hourly(df: DataFrame, at: Column, path: str) -> None:
    """Append as Parquet under year=/month=/day=/hour=; rows of an hour meet in as
    many files as their size asks for."""
    rows = with_hour_columns(df, at)
    rows.hint("rebalance", *HOURLY).write.mode("append").partitionBy(*HOURLY).option("compression", "snappy").parquet(path)


def query(spark: SparkSession, statement: str, **values) -> DataFrame:
    """A statement over temporary views or tables, its values bound, not pasted in."""
    return spark.sql(statement, args=values)


def chat_payload(incident: dict) -> str:
    mark = {"P1": "[page]", "P2": "[warn]"}.get(incident["severity"], "[info]")
    return json.dumps({"text": f"{mark} {incident['title']}: {incident['pipeline_name']} (run {incident.get('run_id') or '-'})"})


def pager_payload(incident: dict, routing_key: str) -> str:
    level = {"P1": "critical", "P2": "warning"}.get(incident["severity"], "info")
    return json.dumps({"routing_key": routing_key, "event_action": "trigger", "dedup_key": incident["dedup_key"], "payload": {"summary": incident["title"], "source": incident["pipeline_name"], "severity": level}})


def deliver(incidents: list[dict], sinks: dict[str, Callable[[dict], int]]) -> list[dict]:
    """Send each incident to the sinks it names; the response codes by sink (-1: it
    raised, None: no such sink). A sink that fails keeps no other from being tried."""
    out = []
    for incident in incidents:
        codes = {}
        for name in incident.get("sinks", ()):
            try:
                codes[name] = sinks[name](incident) if name in sinks else None
            except Exception:
                codes[name] = -1
        out.append(incident | {"codes": codes})
    return out


def exposition(counters: dict[str, float], labels: dict[str, str] | None = None, prefix: str = "lodestrata") -> str:
    """Counters as Prometheus text."""
    tags = ",".join(f'{k}="{v}"' for k, v in sorted((labels or {}).items()))
    return "".join(f"# TYPE {prefix}_{k} counter\n{prefix}_{k}{'{' + tags + '}' if tags else ''} {v:g}\n" for k, v in sorted(counters.items()))

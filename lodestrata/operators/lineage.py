"""Lineage events as rows: one event a run state, with input and output datasets."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENT = "eventType string, eventTime timestamp, run struct<runId:string>, job struct<namespace:string,name:string>, inputs array<struct<namespace:string,name:string>>, outputs array<struct<namespace:string,name:string>>, errorMessage string"


class Lineage:
    """Collects events and appends them through a sink; a sink that fails never fails the job."""

    def __init__(self, spark: SparkSession, namespace: str, sink=None):
        self.spark, self.namespace, self.sink, self.lost = spark, namespace, sink, 0

    def emit(self, kind: str, job: str, run: str | None = None, inputs: list[str] = (), outputs: list[str] = (), error: str | None = None) -> tuple:
        names = lambda xs: [(self.namespace, x) for x in xs]
        event = (kind, datetime.now(timezone.utc), (run or uuid.uuid4().hex,), (self.namespace, job), names(inputs), names(outputs), error)
        if self.sink is not None:
            try:
                self.sink(self.spark.createDataFrame([event], EVENT))
            except Exception:
                self.lost += 1
        return event


def events_of(runs: DataFrame, namespace: str) -> DataFrame:
    """START, COMPLETE and FAIL events of a table of runs."""
    dataset = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(namespace).alias("namespace"), F.col(c).alias("name")))).otherwise(F.array())
    kind = F.when(F.col("status") == "running", "START").when(F.col("status") == "failed", "FAIL").otherwise("COMPLETE")
    at: Column = F.when(F.col("status") == "running", F.col("started_at_utc")).otherwise(F.col("ended_at_utc"))
    return runs.select(kind.alias("eventType"), at.alias("eventTime"), F.struct(F.col("run_id").alias("runId")).alias("run"), F.struct(F.lit(namespace).alias("namespace"), F.col("pipeline_name").alias("name")).alias("job"), dataset("source_table").alias("inputs"), dataset("target_table").alias("outputs"), F.col("error_message").alias("errorMessage"))

"""Raw rows into conformed tables, batch by batch: validate, latest per key, mask, merge."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lodestrata.operators.conform import latest, validated
from lodestrata.operators.history import record_history, upsert
from lodestrata.operators.masking import masked, rules
from lodestrata.plans.table import VersionedTable
from lodestrata.sources.specs import EntitySpec


def conform_batch(batch: DataFrame, spec: EntitySpec, key: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """(the latest valid row of each key, masked; quarantined rows)."""
    clean, bad = validated(batch, list(spec.keys), list(spec.required))
    ties = [c for c in spec.ties if c in batch.columns and c != spec.order_column]
    rows = latest(clean, list(spec.keys), [spec.order_column, *ties])
    if spec.masking:
        rows, _ = masked(rows, rules(list(spec.masking)), key)
    return rows, bad


def conformed_batch_writer(spec: EntitySpec, target: VersionedTable, quarantine: VersionedTable, at: Column | None = None, key: bytes | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function; each batch is one commit, made once. Of the target only
    files with keys of the batch are rewritten, for type 2 those with their current rows."""
    app = f"conformed-{spec.name}"

    def fold(current: DataFrame | None, updates: DataFrame) -> DataFrame:
        if spec.history == 2:
            return record_history(current, updates, list(spec.keys), at if at is not None else F.current_timestamp())
        return upsert(current, updates, list(spec.keys), spec.order_column)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            rows, bad = conform_batch(batch, spec, key)
            quarantine.append(bad, (f"{app}-quarantine", batch_id))
            target.merge(fold, rows, (app, batch_id), list(spec.keys), F.col("_is_current") if spec.history == 2 else None)
        finally:
            batch.unpersist()

    return write


def start_conformed(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 60, available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def start_table_stream(table: VersionedTable, write: Callable[[DataFrame, int], None], checkpoint: str, after: int = -1, commits_per_batch: int = 10, seconds: int = 60, available_now: bool = False) -> StreamingQuery:
    """Stream a versioned table's appended rows, from the commit after `after` on, into
    a foreachBatch function. The log's entries are the stream, so its checkpoint says
    which commits were handled; commits that only rewrite or remove rows are skipped."""
    table.disk.make_folder(f"{table.path}/_log")
    log = table.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", commits_per_batch).load(f"{table.path}/_log")

    def rows_of(batch: DataFrame, batch_id: int) -> None:
        names = [r["path"].rsplit("/", 1)[1] for r in batch.select("path").collect()]  # commits_per_batch at most
        found = [table._entry(n) for n in sorted(int(x.removesuffix(".json")) for x in names) if n > after]
        added = [x["name"] for c in found if c.operation in ("APPEND", "CREATE") for x in c.added]
        if added:
            write(table._scan(added, table.schema(found[-1].version)), batch_id)

    return start_conformed(log.select("path"), rows_of, checkpoint, seconds, available_now)


class Progress(StreamingQueryListener):
    """Counters over all queries of a session, the rows a second of each query's last
    batch, and how far each source is behind (topic/partition -> messages)."""

    def __init__(self):
        self.started, self.ended, self.failed, self.idle, self.batches, self.rows, self.state_rows = 0, 0, 0, 0, 0, 0, 0
        self.rate: dict[str, float] = {}
        self.lag: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.started += 1
        self.rate[str(event.id)] = 0.0

    def onQueryProgress(self, event):
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        self.state_rows = sum(x.numRowsTotal for x in p.stateOperators)
        self.rate[str(p.id)] = p.processedRowsPerSecond
        for source in p.sources:
            self.lag |= lag_of(source.endOffset, source.latestOffset)

    def onQueryIdle(self, event):
        self.idle += 1

    def onQueryTerminated(self, event):
        self.ended += 1
        self.failed += event.exception is not None

    def counters(self) -> dict[str, float]:
        names = ("started", "ended", "failed", "idle", "batches", "rows", "state_rows")
        return {x: getattr(self, x) for x in names} | {"rows_per_second": sum(self.rate.values()), "lag": sum(self.lag.values())}


def lag_of(end, latest) -> dict[str, int]:
    """Messages between two offsets as a message source gives them (topic -> partition
    -> offset, as JSON); none for other sources."""
    try:
        a, b = (json.loads(x) if isinstance(x, str) else x for x in (end, latest))
        return {f"{topic}/{k}": max(0, n - a.get(topic, {}).get(k, 0)) for topic, parts in b.items() for k, n in parts.items()}
    except (AttributeError, TypeError, ValueError):
        return {}


def await_all(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Wait for bounded queries; stop the rest if one fails."""
    try:
        for q in queries:
            q.awaitTermination()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()

"""Many queries together: one for each topic or entity, ended together."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.sinks import exposition
from lodestrata.plans.table import VersionedTable
from lodestrata.sources.registry import SchemaRegistry
from lodestrata.sources.specs import EntitySpec, TopicSpec, raw_paths
from lodestrata.streaming.conformed import Progress, conformed_batch_writer, start_table_stream
from lodestrata.streaming.raw import raw_batch_writer, start_raw


def start_topics(spark: SparkSession, specs: list[TopicSpec], source: Callable[[SparkSession, TopicSpec], DataFrame], registry: SchemaRegistry, root: str, available_now: bool = False) -> dict[str, StreamingQuery]:
    """A query from each topic's stream into its raw table and quarantine."""
    out = {}
    for spec in specs:
        at = raw_paths(root, "", spec.topic)
        write = raw_batch_writer(spec, registry, VersionedTable(spark, at["data"], ("_date",)), VersionedTable(spark, at["quarantine"]))
        out[spec.topic] = start_raw(source(spark, spec), write, at["checkpoint"], spec.trigger_seconds, available_now)
    return out


def start_entities(spark: SparkSession, specs: list[EntitySpec], root: str, key: bytes | None = None, available_now: bool = False) -> dict[str, StreamingQuery]:
    """A query from each entity's raw table (its path: `source`) into its conformed table."""
    out = {}
    for spec in specs:
        bad = VersionedTable(spark, spec.quarantine or f"{root}/quarantine/{spec.name}")
        write = conformed_batch_writer(spec, VersionedTable(spark, spec.target), bad, key=key)
        out[spec.name] = start_table_stream(VersionedTable(spark, spec.source), write, f"{root}/checkpoint/{spec.name}", seconds=spec.trigger_seconds, available_now=available_now)
    return out


class Runner:
    """Waits for queries; if one fails, or when it is told to stop, it stops them all."""

    def __init__(self, queries: dict[str, StreamingQuery]):
        self.queries, self.told = queries, threading.Event()

    def stop(self, *_) -> None:
        self.told.set()

    def on_signals(self, *numbers: int) -> "Runner":
        for n in numbers or (signal.SIGTERM, signal.SIGINT):
            signal.signal(n, self.stop)
        return self

    def wait(self, every: float = 0.5) -> dict[str, str]:
        """State of each query: ended or stopped. Raises what a failed one raised."""
        try:
            while any(q.isActive for q in self.queries.values()) and not self.told.is_set():
                failed = [q.exception() for q in self.queries.values() if not q.isActive and q.exception()]
                if failed:
                    break
                self.told.wait(every)
        finally:
            running = [name for name, q in self.queries.items() if q.isActive]
            for name in running:
                self.queries[name].stop()
        for q in self.queries.values():
            if q.exception():
                raise q.exception()
        return {name: "stopped" if name in running else "ended" for name in self.queries}


class Reporter:
    """Hands the counters as exposition text to a sink every so many seconds, and once at the end."""

    def __init__(self, progress: Progress, sink: Callable[[str], None], seconds: float = 30, labels: dict[str, str] | None = None):
        self.progress, self.sink, self.seconds, self.labels = progress, sink, seconds, labels
        self.over, self.thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.over.wait(self.seconds):
            self.sink(exposition(self.progress.counters(), self.labels))

    def __enter__(self) -> "Reporter":
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        self.sink(exposition(self.progress.counters(), self.labels))

"""Message streams into the raw layer: decode, route, append, all of it once.

A micro-batch is committed under (application, batch id), so one that is sent
again after a restart writes nothing. Quarantined rows go to a table of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.plans.table import VersionedTable
from lodestrata.sources.avro import decoded
from lodestrata.sources.registry import SchemaRegistry
from lodestrata.sources.specs import TopicSpec
from lodestrata.sources.wire import BAD_PAYLOAD, META, RECORD, routed


def message_stream(spark: SparkSession, options: dict[str, str], topic: str) -> DataFrame:
    """A message broker's topic, where Spark's connector is on the class path."""
    return spark.readStream.format("kafka").options(**options).option("subscribe", topic).load()


def file_stream(spark: SparkSession, folder: str, files_per_batch: int | None = 1, bytes_per_batch: str | None = None) -> DataFrame:
    """Records of the same shape from a folder of Parquet files. A batch is bounded by
    files or by bytes; its age by the trigger."""
    bound = ("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else ("maxFilesPerTrigger", files_per_batch or 1000)
    return spark.readStream.schema(RECORD).option(*bound).parquet(folder)


def decoded_rows(raw: DataFrame, reader: dict, writers: dict[int, dict], as_of: Column | None = None) -> DataFrame:
    """All rows with meta columns, `decoded` and quarantine_reason (null: sound)."""
    rows = decoded(routed(raw, sorted(writers), as_of), reader, writers)
    return rows.withColumn("quarantine_reason", F.coalesce("quarantine_reason", F.when(F.col("decoded").isNull(), BAD_PAYLOAD)))


def routes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded rows with meta columns, quarantined rows with raw value and reason)."""
    good = rows.where("quarantine_reason is null").select("decoded.*", *META)
    return good, rows.where("quarantine_reason is not null").select("value", *META, "schema_id", "quarantine_reason")


def decode_batch(raw: DataFrame, reader: dict, writers: dict[int, dict], as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Both routes of a batch; persist `decoded_rows` where both are written."""
    return routes(decoded_rows(raw, reader, writers, as_of))


def raw_batch_writer(spec: TopicSpec, registry: SchemaRegistry, data: VersionedTable, quarantine: VersionedTable) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. A batch is decoded once; known ids are read from the
    registry each time."""
    app = f"raw-{spec.topic}"

    def write(batch: DataFrame, batch_id: int) -> None:
        _, reader = registry.latest(spec.subject)
        rows = decoded_rows(batch, reader, registry.writers(spec.subject)).persist()
        try:
            good, bad = routes(rows)
            quarantine.append(bad, (f"{app}-quarantine", batch_id))
            data.append(good.withColumn("_date", F.to_date(F.timestamp_millis("_kafka_timestamp_ms"))), (app, batch_id))
        finally:
            rows.unpersist()

    return write


def start_raw(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 30, available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()

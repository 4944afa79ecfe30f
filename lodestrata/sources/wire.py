"""Schema-registry framing: one zero byte, a four-byte big-endian schema id, payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, StringType, TimestampType

RECORD = StructType(
    [
        StructField("value", BinaryType()),
        StructField("topic", StringType()),
        StructField("partition", LongType()),
        StructField("offset", LongType()),
        StructField("timestamp", TimestampType()),
    ]
)
META = ("_kafka_topic", "_kafka_partition", "_kafka_offset", "_kafka_timestamp_ms", "_ingested_utc")
NULL_VALUE, BAD_FRAME, UNKNOWN_ID, BAD_PAYLOAD = "null_value", "invalid_wire_format", "unknown_schema_id", "undecodable_payload"


def framed(value: str = "value") -> Column:
    """Whether the header is right; false for null and short values."""
    return F.coalesce((F.length(value) >= 5) & (F.hex(F.substring(value, 1, 1)) == "00"), F.lit(False))


def schema_id(value: str = "value") -> Column:
    """The header's schema id; null where there is no header."""
    return F.when(framed(value), F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long"))


def payload(value: str = "value") -> Column:
    return F.when(framed(value), F.expr(f"substring({value}, 6)"))


def frame(payload_column: Column, id_column: Column) -> Column:
    """The opposite: header and payload as one binary value."""
    return F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(id_column.cast("long")), 8, "0"), F.hex(payload_column.cast("binary"))))


def with_meta(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """value and the five meta columns, milliseconds kept."""
    return raw.select(
        "value",
        F.col("topic").alias("_kafka_topic"),
        F.col("partition").cast("long").alias("_kafka_partition"),
        F.col("offset").cast("long").alias("_kafka_offset"),
        F.unix_millis(F.col("timestamp").cast("timestamp")).alias("_kafka_timestamp_ms"),
        (as_of if as_of is not None else F.current_timestamp()).alias("_ingested_utc"),
    )


def routed(raw: DataFrame, known_ids: list[int], as_of: Column | None = None) -> DataFrame:
    """with_meta and schema_id, payload and quarantine_reason (null: valid). No
    row is lost: null values, bad frames and unknown ids each have a reason."""
    rows = with_meta(raw, as_of).withColumn("schema_id", schema_id())
    reason = (
        F.when(F.col("value").isNull(), NULL_VALUE)
        .when(~framed(), BAD_FRAME)
        .when(~F.col("schema_id").isin(list(known_ids)), UNKNOWN_ID)
    )
    return rows.withColumn("quarantine_reason", reason).withColumn("payload", F.when(F.col("quarantine_reason").isNull(), payload()))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined); without a reason column all rows are valid."""
    if "quarantine_reason" not in rows.columns:
        return rows, rows.limit(0)
    return rows.where("quarantine_reason is null").drop("quarantine_reason"), rows.where("quarantine_reason is not null")


def dead_letters(quarantined: DataFrame, source: str) -> DataFrame:
    """Raw value with the error's context as headers, as a message sink takes it."""
    pairs = [("error", F.col("quarantine_reason")), ("source", F.lit(source)), ("topic", F.col("_kafka_topic")), ("partition", F.col("_kafka_partition").cast("string")), ("offset", F.col("_kafka_offset").cast("string"))]
    return quarantined.select("value", F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(F.coalesce(v, F.lit("")) for _, v in pairs))).alias("headers"))

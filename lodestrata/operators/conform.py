"""From raw to conformed rows: validation, the latest row of each key, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

NULL_KEY, MISSING = "null_primary_key", "missing_required"


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns], F.lit(False))


def with_reason(batch: DataFrame, keys: list[str], required: list[str] = ()) -> DataFrame:
    """The column quarantine_reason: a null key comes before a missing column; null if neither."""
    return batch.withColumn("quarantine_reason", F.when(_any_null(list(keys)), NULL_KEY).when(_any_null(list(required)), MISSING))


def validated(batch: DataFrame, keys: list[str], required: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows with their reason)."""
    rows = with_reason(batch, keys, required)
    return rows.where("quarantine_reason is null").drop("quarantine_reason"), rows.where("quarantine_reason is not null")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by `order` (nulls first). One partial
    aggregation before the shuffle, so a hot key sends a row a task."""
    rest = [c for c in df.columns if c not in order and c not in keys]
    ranked = F.struct(*(F.struct(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")).alias(f"o{i}") for i, c in enumerate(order)))
    held = F.struct(*(F.col(f"`{c}`") for c in [*order, *rest]))
    best = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.max_by(held, ranked).alias("_held"))
    flat = [F.col(f"`{c}`") if c in keys else F.col(f"_held.`{c}`").alias(c) for c in df.columns]
    return best.select(*flat)


def latest_by_window(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same by row_number; for rows that can't be held in an aggregate."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def reason_profile(quarantined: DataFrame) -> DataFrame:
    """Rows by reason, most first."""
    return quarantined.groupBy("quarantine_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "quarantine_reason")


def high_watermarks(records: DataFrame) -> DataFrame:
    """The next offset to read of each topic and partition."""
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """End offset less committed offset of each topic and partition (never committed: all)."""
    both = ends.join(committed, ["topic", "partition"], "left")
    return both.select("topic", "partition", (F.col("end_offset") - F.coalesce("next_offset", F.lit(0))).alias("lag"))


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text an earlier row (by key) has, with that row's key."""
    first = df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("_h")).agg(F.min(key).alias("first_key"), F.count("*").alias("copies")).where("copies > 1")
    return df.withColumn("_h", F.sha2(text, 256)).join(first, "_h").where(F.col(key) > F.col("first_key")).select(key, "first_key", "copies")

"""Slowly changing dimensions as joins that give a table's next rows.

Type 1 keeps the current row of each key. Type 2 keeps all states with
_valid_from, _valid_to and _is_current; closing the old state and opening the new
one are one result, so they are one commit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.functions.hashing import row_hash

VALIDITY = ("_valid_from", "_valid_to", "_is_current", "_row_hash")


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])


def upsert(current: DataFrame | None, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Type 1: updates replace rows of equal keys (nulls are equal) and add new
    ones. With `order`, an update older than the row it meets is ignored."""
    if current is None:
        return updates
    if order is None:
        kept = current.alias("t").join(updates.alias("s"), _same("t", "s", keys), "left_anti")
        return kept.unionByName(updates, allowMissingColumns=True)
    seen = current.select(*keys, F.col(order).alias("_seen"))
    fresh = updates.alias("s").join(seen.alias("t"), _same("s", "t", keys), "left").where(F.col("_seen").isNull() | (F.col(f"s.{order}") >= F.col("_seen"))).select("s.*")
    kept = current.alias("t").join(fresh.alias("s"), _same("t", "s", keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def history_skeleton(df: DataFrame) -> DataFrame:
    """No rows, with the columns of a type 2 table."""
    return opened(df.limit(0), F.lit(None).cast("timestamp"))


def opened(updates: DataFrame, at: Column) -> DataFrame:
    return updates.withColumns({"_valid_from": at.cast("timestamp"), "_valid_to": F.lit(None).cast("timestamp"), "_is_current": F.lit(True), "_row_hash": row_hash(updates)})


def record_history(current: DataFrame | None, updates: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Type 2: where the fingerprint differs, the current row is closed at `at` and
    the update opened; equal updates change nothing. Updates hold one row a key. Only
    live rows are joined, once; closed history passes by."""
    new = opened(updates, at)
    if current is None:
        return new
    kinds = dict(zip(current.columns, (f.dataType for f in current.schema))) | {f.name: f.dataType for f in new.schema if f.name not in current.columns}

    def row(side: str, columns: list[str], **other: Column) -> Column:
        values = {c: F.col(f"{side}.`{c}`") if c in columns else F.lit(None) for c in kinds} | other
        return F.struct(*(values[c].cast(t).alias(c) for c, t in kinds.items()))

    live = current.where("_is_current").withColumn("_there", F.lit(True)).alias("t")
    both = live.join(new.withColumn("_there", F.lit(True)).alias("s"), _same("t", "s", keys), "full_outer")
    old, fresh = F.col("t._there").isNotNull(), F.col("s._there").isNotNull()
    changed = old & fresh & (F.col("t._row_hash") != F.col("s._row_hash"))
    kept = F.when(changed, row("t", current.columns, _valid_to=at, _is_current=F.lit(False))).when(old, row("t", current.columns))
    added = F.when(fresh & (~old | changed), row("s", new.columns))
    states = both.select(F.explode(F.array_compact(F.array(kept, added))).alias("x")).select("x.*")
    closed = current.where("not _is_current").select(*(F.col(f"`{c}`") if c in current.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    return closed.unionByName(states)


def history_of(changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The same table from all changes at once: runs of equal fingerprints become
    one state, which the next one ends."""
    w = Window.partitionBy(*keys).orderBy(at)
    hashed = changes.withColumn("_row_hash", row_hash(changes, sorted(c for c in changes.columns if not c.startswith("_") and c != at)))
    starts = hashed.withColumn("_last", F.lag("_row_hash").over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col("_row_hash"))).drop("_last")
    return starts.withColumns({"_valid_from": F.col(at), "_valid_to": F.lead(at).over(w)}).withColumn("_is_current", F.col("_valid_to").isNull())


def offending_keys(history: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without exactly one current row."""
    return history.groupBy(*keys).agg(F.count_if("_is_current").alias("current_rows")).where("current_rows <> 1")

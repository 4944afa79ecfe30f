"""Shared plumbing of the training-data operators.

Nothing here decides anything about documents: it reads tables, writes
intermediate tables to the folder all executors share, and cuts Arrow batches
into bounded pieces so that a Python worker's memory does not depend on the
number of rows in a batch.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.session import shared_folder as shared_dir, ship, table  # noqa: F401

#: Bytes of text that a Python worker holds in numpy form at a time.
CHUNK_BYTES = 2 << 20

#: Makes Spark drop a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is
    cut, and any executor can read any part again after another one is lost.
    `discard` removes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = (weakref.ref(out), path)
    return out


_STORED: dict[int, tuple] = {}


def discard(*frames: DataFrame) -> None:
    """Remove the tables of materialized frames that no later step reads."""
    for frame in frames:
        held, path = _STORED.pop(id(frame), (lambda: None, None))
        if held() is frame:
            target = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it off the taken ones."""
    held, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


#: A key that holds more than one in so many rows is frequent; there are fewer such keys than that.
SHARE = 1000


def joined_evenly(left: DataFrame, right: DataFrame, key: str, frequent: DataFrame) -> DataFrame:
    """left.join(right, key), where `right` has a row a key at most. The keys in
    `frequent` (distinct, at most SHARE by the way they are chosen) are joined by
    broadcast, so that no task gets all of a hot key's rows; others are shuffled."""
    marked = left.join(F.broadcast(frequent.select(key, F.lit(True).alias("_hot"))), key, "left")
    hot = marked.where("_hot").drop("_hot").join(F.broadcast(right.join(F.broadcast(frequent.select(key)), key, "left_semi")), key)
    return marked.where("_hot is null").drop("_hot").join(right, key).unionByName(hot)


def dealt_out(df: DataFrame, key: str, groups: int) -> DataFrame:
    """df dealt by `key` (about `groups` values, each much work for few bytes) to as
    many tasks as there are groups or cores, where Spark would join small partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(groups, max(3 * cores, -(-groups // 16)))), key)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut so that each piece holds at most `limit`
    bytes of `column`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = byte_lengths(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(column: pa.Array) -> list[str]:
    """The strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column one after the other, and the offsets of the rows."""
    raw = [x.encode() if isinstance(x, str) else (x or b"") for x in column.to_pylist()]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

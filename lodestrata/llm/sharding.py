"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at many places of a ring of 64-bit hashes. A key belongs to the
first place clockwise from its hash. A shard holds no more than its capacity:
keys of an arc whose shard is full continue clockwise to the next place whose
shard has room. Capacities are the table's rows dealt as evenly as can be, so
counts differ by one at most, and a key moves only where a shard overflows or the
number of shards changes.

The arcs are cut into cells by a hash of id and content, and only the cells' row
counts (a bounded number: shards * places * salts) reach the driver, which works out
which ranks of each cell go to which shard. Rows are then numbered within their cell.
Rows that are equal in id, size and content are counted first and numbered together,
so a place depends on what the table holds, never on the order or the files it
comes in, and a row that is repeated very often is one row until the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.llm.common import materialize, mix64, ship


def ring(shards: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The places on the ring in ascending order, and their shards."""
    with np.errstate(over="ignore"):
        at = mix64(np.arange(1, shards * places + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    owner = np.repeat(np.arange(shards), places)
    order = np.lexsort((owner, at))
    return at[order], owner[order]


def plan(counts: np.ndarray, owner: np.ndarray, salts: int, shards: int) -> dict[str, np.ndarray]:
    """Which ranks of each cell go to which shard, and to which slots.

    counts: rows of each cell, arc by arc in clockwise order. Each arc's rows fill
    its own shard first; then what is over goes clockwise to shards with room."""
    total = int(counts.sum())
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    used = np.zeros(shards, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []
    for cell, n in enumerate(counts.tolist()):
        shard = int(owner[cell // salts])
        take = min(n, int(room[shard]))
        if take:
            out.append((cell, 0, take, shard, int(used[shard])))
            used[shard] += take
            room[shard] -= take
        if take < n:
            over.append((cell, take, n))
    for cell, start, stop in over:
        arc = cell // salts
        while start < stop:
            arc = (arc + 1) % len(owner)
            shard = int(owner[arc])
            take = min(stop - start, int(room[shard]))
            if take:
                out.append((cell, start, start + take, shard, int(used[shard])))
                used[shard] += take
                room[shard] -= take
                start += take
    columns = np.array(out, np.int64).reshape(-1, 5)
    return dict(zip(("cell", "first", "stop", "shard", "slot"), columns.T))


#: Places of equal rows that are written out by one task.
RUN = 1 << 16


def shard_documents(docs: DataFrame, shards: int = 24, places: int = 64, salts: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    A null text has no bytes: size 8, CRC 0. Texts may be of any length: only their
    size and CRC are kept. A null doc_id is a key of its own. Repeated rows are rows:
    each gets a slot. Ties on the ring (equal ids) are ordered by CRC and size; rows
    that tie in all of these are equal in all that is returned. An empty table gives
    no rows; other columns play no part. Text is read once and not shuffled; a cell's
    rows, not a key's, meet in one task.
    """
    spark = docs.sparkSession
    ship(spark)
    at, owner = ring(shards, places)

    def cells(batches):
        for batch in batches:
            arc = np.searchsorted(at, batch.column(3).to_numpy(zero_copy_only=False)) % len(at)
            salt = batch.column(4).to_numpy(zero_copy_only=False) % salts
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(arc * salts + salt, pa.int32()), batch.column(5)], ["doc_id", "size", "text_crc32", "spot", "cell", "n"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    salted = kinds.select("doc_id", "size", "text_crc32", F.xxhash64("doc_id").alias("spot"), F.pmod(F.xxhash64("text_crc32", "size", "doc_id"), F.lit(1 << 20)).alias("salt"), "n")
    kinds = materialize(salted.mapInArrow(cells, "doc_id long, size long, text_crc32 long, spot long, cell int, n long"), "cells")
    counts = np.zeros(len(at) * salts, np.int64)
    for cell, n in kinds.groupBy("cell").agg(F.sum("n")).collect():  # shards * places * salts rows at most
        counts[cell] = n
    dealt = plan(counts, owner, salts, shards)
    ranges = spark.createDataFrame(pa.table({"_cell": pa.array(dealt["cell"], pa.int32()), **{k: pa.array(dealt[k], pa.int64()) for k in ("first", "stop", "slot")}, "shard": pa.array(dealt["shard"], pa.int32())}))
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("spot", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = kinds.withColumn("upto", upto).withColumn("rank", F.col("upto") - F.col("n"))
    # ranges: at most one row a cell, and one more for each shard that fills up
    meet = (F.col("cell") == F.col("_cell")) & (F.col("rank") < F.col("stop")) & (F.col("upto") > F.col("first"))
    low, high = F.greatest("rank", "first"), F.least("upto", "stop")
    placed = ranked.join(F.broadcast(ranges), meet).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + low - F.col("first")).alias("a"), (F.col("slot") + high - F.col("first")).alias("b"))
    # equal rows are dealt out by runs of places, so that one row repeated without end isn't one task's work
    runs = placed.select("doc_id", "size", "text_crc32", "shard", "b", F.explode(F.sequence("a", F.col("b") - 1, F.lit(RUN).cast("long"))).alias("a")).hint("rebalance")
    each = runs.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence("a", F.least(F.col("a") + RUN, "b") - 1)).alias("slot"))
    return each.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows of two results with numbers of shards that differ by one stand on
    another shard (moved), and how many of them not on the new one (between_old).
    Rows that tie in all of doc_id, size and CRC count as staying where they can."""
    keys = ["doc_id", "size", "text_crc32"]
    new = after.agg(F.max("shard")).first()[0]
    a = before.groupBy(*keys, "shard").agg(F.count("*").alias("n")).alias("a")
    b = after.groupBy(*keys, "shard").agg(F.count("*").alias("m")).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "shard")]
    gained = F.greatest(F.col("m") - F.coalesce("n", F.lit(0)), F.lit(0))
    both = b.join(a, same[0] & same[1] & same[2] & same[3], "left").select(F.col("b.shard").alias("shard"), gained.alias("moved"))
    return both.agg(F.sum("moved").alias("moved"), F.sum(F.when(F.col("shard") < new, F.col("moved")).otherwise(0)).alias("between_old"))

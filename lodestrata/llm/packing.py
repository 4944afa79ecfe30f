"""Best-fit packing with a swap-based local search.

A document's ids are cut into pieces of at most `limit` tokens; full pieces fill
a sequence alone, so each document leaves one short piece at most. Short pieces
are dealt to blocks of bounded size by a hash. A block starts from best-fit
decreasing and then improves by local search: pieces move, or are exchanged one
for one or two for one, between its underfull bins wherever that increases the
sum of squared fills, until bins run empty. Blocks leave at most a few underfull
bins; these are packed again over all blocks, in blocks of their own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.bpe import CHUNK, library_coder
from lodestrata.llm.common import dealt_out, materialize, ship, text_chunks

#: Short pieces a block holds on average.
BLOCK = 4096

def token_pieces(docs: DataFrame, path: str, pattern: str, limit: int = 1024, end_id: int = 2, with_ids: bool = False, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its text's ids (null: none) and then `end_id`; one longer than
    `limit` is cut into full pieces from its end on, so that the first is short.
    With `added`, added tokens of the file that stand in a text give their own ids,
    as the tokenizers library has it by default; else they are ordinary text.
    Repeated rows give repeated pieces; other columns play no part.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        _, encode = library_coder(path, pattern, added)
        for part in text_chunks(batches, "text", CHUNK):
            ids, counts = encode(part.column(1))
            ends = np.cumsum(counts)
            n_pieces = -(-(counts + 1) // limit)
            row = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            first = (counts + 1) - (n_pieces - 1) * limit
            start = np.where(piece > 0, first[row] + (piece - 1) * limit, 0)
            length = np.where(piece > 0, limit, first[row])
            last, base = np.array([end_id], "<u4").tobytes(), ends - counts
            data = memoryview(ids.view(np.uint8))
            raw = []
            for r, k, a, b in zip(row.tolist(), piece.tolist(), (base[row] + start).tolist(), length.tolist()):
                closing = k == n_pieces[r] - 1
                raw.append(bytes(data[4 * a : 4 * (a + b - closing)]) + last * bool(closing))
            columns = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indices."""
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect_left(room, (lengths[i], -1))
        free, b = room.pop(k) if k < len(room) else (limit, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if free > lengths[i]:
            insort(room, (free - lengths[i], b))
    return bins


def local_search(lengths: list[int], bins: list[list[int]], limit: int) -> list[list[int]]:
    """Raise the sum of squared fills by moves and exchanges between underfull
    bins. The emptiest bin gives to fuller ones: each gets the largest piece that
    fits, or the exchange (one for one, two of the giver's for one, or one for
    two) that fills it most. Bins that run empty are dropped.

    The search ends when no pair of underfull bins has a gain left, or when there
    are as few bins as the lengths' sum allows. It does end: what the fuller bin
    gains raises the sum of squares by two at least, and that is at most
    bins * limit ** 2. The first round looks at all pairs, later ones only at pairs
    of which a bin has changed."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_ = [k for k in range(len(bins)) if fill[k] < limit]
    bins = [list(b) for b in bins]
    least = -(-sum(lengths) // limit)
    stale = set(open_)  # bins that have changed since their pairs were looked at
    while stale and sum(map(bool, bins)) > least:
        open_ = sorted((k for k in open_ if 0 < fill[k] < limit), key=fill.__getitem__)
        moved: set[int] = set()
        for g, giver in enumerate(open_):
            for taker in open_[:g:-1]:
                if giver not in stale and taker not in stale and giver not in moved and taker not in moved:
                    continue
                if not fill[giver]:
                    break
                if fill[taker] == limit or fill[taker] < fill[giver]:
                    continue
                trade = best_trade(lengths, bins[giver], bins[taker], limit - fill[taker])
                if trade:
                    moved |= {giver, taker}
                    for source, target, what in ((giver, taker, trade[0]), (taker, giver, trade[1])):
                        for i in what:
                            bins[source].remove(i)
                            bins[target].append(i)
                            fill[source] -= lengths[i]
                            fill[target] += lengths[i]
        stale = moved
    return [b for b in bins if b]


def best_trade(lengths: list[int], giver: list[int], taker: list[int], gap: int) -> tuple[tuple, tuple] | None:
    """What goes from giver to taker, and back, so that the taker gains most within its gap."""
    mine, theirs = {lengths[i]: i for i in giver}, {lengths[i]: i for i in taker}
    sizes = sorted(mine)
    best, trade = 0, None
    k = bisect_right(sizes, gap)
    if k:
        best, trade = sizes[k - 1], ((mine[sizes[k - 1]],), ())
    twos = sorted({lengths[giver[x]] + lengths[giver[y]]: (giver[x], giver[y]) for x in range(len(giver)) for y in range(x)}.items())
    sums = [t for t, _ in twos]
    for out, i in theirs.items():
        k = bisect_right(sizes, gap + out)
        if k and sizes[k - 1] - out > best:
            best, trade = sizes[k - 1] - out, ((mine[sizes[k - 1]],), (i,))
        k = bisect_right(sums, gap + out)
        if k and sums[k - 1] - out > best:
            best, trade = sums[k - 1] - out, (twos[k - 1][1], (i,))
    for x in range(len(taker)):
        for y in range(x):
            out = lengths[taker[x]] + lengths[taker[y]]
            if sizes[-1] - out <= best:
                continue
            k = bisect_right(sizes, gap + out)
            if k and sizes[k - 1] - out > best:
                best, trade = sizes[k - 1] - out, ((mine[sizes[k - 1]],), (taker[x], taker[y]))
    return trade


def pack(pieces: DataFrame, limit: int = 1024, block: int = BLOCK) -> DataFrame:
    """Give each piece (columns doc_id, piece, length and any others) a
    sequence_id and an offset; sequences hold at most `limit`, without gaps.

    Pieces of equal doc_id and number (repeated rows) are packed each for itself.
    Shuffles only lengths and row numbers; a group of a block has about `block`
    rows whatever the table's size or the documents' sources.
    """
    spark = pieces.sparkSession
    ship(spark)
    rows = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = rows.where(F.col("length") >= limit).select("_row", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = rows.where(F.col("length") < limit).select("_row", F.col("length").cast("int").alias("length"))

    def packed(source: DataFrame, level: int, keep: float) -> DataFrame:
        """`keep`: bins filled below that share are given back (sequence_id null)."""
        n = source.count()
        blocks = max(1, -(-n // block))

        def one(group: pa.Table) -> pa.Table:
            group = group.sort_by([("length", "descending"), ("_row", "ascending")])
            lengths = group.column("length").to_pylist()
            bins = local_search(lengths, best_fit(lengths, limit), limit)
            ids = group.column("_row").to_pylist()
            sequence, offset = [None] * len(ids), [0] * len(ids)
            for members in bins:
                at, name = 0, min(ids[i] for i in members)
                kept = sum(lengths[i] for i in members) >= keep * limit
                for i in members:
                    sequence[i], offset[i] = name if kept else None, at
                    at += lengths[i]
            return pa.table({"_row": pa.array(ids, pa.int64()), "length": pa.array(lengths, pa.int32()), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

        dealt = source.select(F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(blocks)).alias("_block"), "_row", "length")
        return materialize(dealt_out(dealt, "_block", blocks).groupBy("_block").applyInArrow(one, "_row long, length int, sequence_id long, offset long"), f"packed{level}")

    first = packed(short, 1, 0.97)
    again = packed(first.where("sequence_id is null").select("_row", "length"), 2, 0.0)
    placed = first.where("sequence_id is not null").unionByName(again).drop("length")
    return rows.join(whole.unionByName(placed), "_row").drop("_row")


def pack_documents(docs: DataFrame, path: str, pattern: str, limit: int = 1024, end_id: int = 2, added: bool = False, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of
    docs; `with_ids`: also its ids (binary, little-endian unsigned 32-bit).

    A null or empty text is one piece, the end id alone. A text of any length is cut
    into whole pieces, none is dropped. Repeated rows, also those of one doc_id or a
    null one, are packed each for itself; pieces of equal length go by their row's
    number. An empty table gives no rows; only doc_id and text are read.
    """
    return pack(token_pieces(docs, path, pattern, limit, end_id, with_ids, added), limit)

"""Removal of repeated strings by suffix arrays.

Every string of LENGTH bytes that starts at two places, in one document or in
several, is removed wherever it stands. Each such string holds an anchor: the
GRAM-byte string of least hash in it, the leftmost of equal ones. So equal strings
share their anchor and its place in them, and it is enough to compare strings by
anchor:

1. each distinct text gives its anchors, and the run of strings that belong to each;
   anchors that follow each other and are equal (in periodic text) are one run;
2. anchors that occur once are dropped (an aggregation and a join on the anchor);
3. the contexts of the others (the bytes of an anchor's run) are collected once each;
   a context that occurs twice is repeated as a whole;
4. contexts are dealt to shards of bounded size by anchor; each shard's suffix array
   is built by induced sorting, and the permuted common prefixes of neighbours tell
   which strings repeat. Where an anchor has too many different contexts for a
   shard, their strings are dealt anew by anchor, its place in the string (in steps
   of a width) and the bytes that all strings with the anchor there have in common,
   and are suffix-sorted in parts; the narrower the width, the longer those bytes,
   up to the whole string;
5. the runs found are put back on their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.common import SHARE, dealt_out, discard, joined_evenly, materialize, mix64, ship, text_chunks

LENGTH = 200
GRAM = 64
#: Bytes of contexts a shard holds on average, and those of one anchor at most.
SHARD, MOST = 1 << 20, 2 << 20
#: Widths in which an anchor's places are told apart, one after the other.
WIDTHS = (42, 11, 3, 1)
#: Starts of strings that are worked on at a time.
PIECE = 1 << 21

_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_FACTORS = mix64(np.arange(11, 19, dtype=np.uint64)) | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes (a power of two) from each place on."""
    h, step, i = _BYTES[data], 1, 0
    while step < size:
        h = h[:-step] * _FACTORS[i] + h[step:]
        step, i = 2 * step, i + 1
    return mix64(h)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` keys from each place on."""
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    rest = width - step
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def owners(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the anchor of the string at each start, and where that anchor is."""
    hashes = gram_hashes(data, GRAM)
    keys = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64)
    owner = (sliding_min(keys, length - GRAM + 1) & _PLACE).astype(np.int64)
    return hashes[owner], owner


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For texts that lie one after the other in `data`: text, anchor hash, first
    start, number of starts and number of anchors of each run of strings whose
    anchors are equal."""
    begins = np.concatenate([[0], ends[:-1]])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    last = int(ends[-1]) if len(ends) else 0
    for a in range(0, last - length + 1, PIECE):
        b = min(a + PIECE, last - length + 1)
        anchor, owner = owners(data[a : b + length - 1], length)
        starts = np.arange(a, b)
        text = np.searchsorted(ends, starts, side="right")
        valid = starts + length <= ends[np.minimum(text, len(ends) - 1)]
        change, moves = valid.copy(), valid.copy()
        together = ~valid[:-1] | (text[1:] != text[:-1])
        change[1:] &= (anchor[1:] != anchor[:-1]) | together
        moves[1:] &= (owner[1:] != owner[:-1]) | together
        first = np.flatnonzero(change)
        bounds = np.append(np.flatnonzero(change | ~valid), b - a)
        stop = bounds[np.searchsorted(bounds, first, side="right")]
        moved = np.concatenate([[0], np.cumsum(moves)])
        found.append((text[first], anchor[first], starts[first] - begins[text[first]], stop - first, moved[stop] - moved[first]))
    return tuple(map(np.concatenate, zip(*found)))


def common(s: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many symbols from places i and j on agree, at most `limit` each."""
    count = np.zeros(len(i), np.int64)
    active, k = np.flatnonzero(limit > 0), 0
    while len(active) and k < 512:
        active = active[s[i[active] + k] == s[j[active] + k]]
        k += 1
        count[active] = k
        active = active[limit[active] > k]
    for x in active.tolist():
        a, b, most, step = int(i[x]), int(j[x]), int(limit[x]), 1024
        done = k
        while done < most:
            n = min(step, most - done)
            apart = np.flatnonzero(s[a + done : a + done + n] != s[b + done : b + done + n])
            if len(apart):
                done += int(apart[0])
                break
            done, step = done + n, 2 * step
        count[x] = done
    return count


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of s (integers over 0, the last one the only 0) by induced
    sorting: the leftmost-smaller substrings are sorted by induction and named, the
    text of names is sorted recursively where names repeat, and its order induces
    that of all suffixes."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    s = s.astype(np.int32)
    sign = np.sign(np.diff(s))
    place = np.where(sign != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(place[::-1])[::-1]
    small = np.ones(n, bool)  # suffixes less than their successor
    small[:-1] = sign[np.minimum(following, n - 2)] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s)
    order = induce(s, small, lms[stable_order(s[lms])], sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = order[is_lms[order]]
    rank = np.empty(n, np.int64)
    rank[lms] = np.arange(len(lms))
    after = np.append(lms[1:], n - 1)[rank[by_substring]]
    size = after - by_substring + 1
    same = size[1:] == size[:-1]
    twins = np.flatnonzero(same)
    same[twins] = common(s, by_substring[twins], by_substring[twins + 1], size[twins]) == size[twins]
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 == len(lms):
        return induce(s, small, by_substring, sizes)
    text = np.empty(len(lms), np.int64)
    text[rank[by_substring]] = names
    return induce(s, small, lms[suffix_array(text)], sizes)


def stable_order(x: np.ndarray) -> np.ndarray:
    """The stable order of integers from 0 on; by radix where they fit 16 bits."""
    return np.argsort(x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x, kind="stable")


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order. First the
    larger suffixes are placed from the left of their buckets, each after the order
    of its successor, then the smaller ones from the right."""
    n = len(s)
    ends = np.cumsum(sizes)
    place = np.empty(n, np.int32)
    c = s[lms]
    count = np.bincount(c, minlength=len(sizes))
    by = stable_order(c)
    c = c[by]
    place[lms[by]] = ends[c] - count[c] + np.arange(len(c)) - (np.cumsum(count) - count)[c]
    fresh_run = np.ones(n, bool)
    fresh_run[1:] = s[1:] != s[:-1]
    at = np.arange(n, dtype=np.int32)
    back = at - np.maximum.accumulate(np.where(fresh_run, at, 0))  # equal symbols before
    _fill(s, place, ~small, ends - sizes, back, False)
    _fill(s, place, small, ends.copy(), back, True)
    place[n - 1] = 0
    out = np.empty(n, np.int64)
    out[place] = at
    return out


def _fill(s: np.ndarray, place: np.ndarray, kind: np.ndarray, edge: np.ndarray, back: np.ndarray, from_right: bool) -> None:
    """Place the suffixes of a kind by the places of their successors. A bucket can be
    filled once those are filled whose suffixes follow its own, and all such buckets
    are filled together. Within a run of equal symbols a suffix follows one of its own
    bucket, so a run's suffixes are placed by their distance from the run's end."""
    n = len(s)
    heads = np.flatnonzero(kind[:-1] & (s[:-1] != s[1:]))  # a run's last ones
    if not len(heads):
        return
    inner = heads[kind[heads + 1]]
    links = np.unique(s[inner].astype(np.int64) * len(edge) + s[inner + 1])
    level, lower, upper = np.zeros(len(edge), np.int64), links % len(edge), links // len(edge)
    while True:
        raised = level.copy()
        np.maximum.at(raised, upper, level[lower] + 1)
        if (raised == level).all():
            break
        level = raised
    steps = level[s[heads]]
    by = stable_order(steps)
    bounds = np.searchsorted(steps[by], np.arange(int(steps.max()) + 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        who = heads[by[a:b]]
        c, successor = s[who].astype(np.int64), place[who + 1]
        order = np.argsort(c * (n + 1) + (n - successor if from_right else successor))
        who, c = who[order], c[order]
        runs = back[who]
        if runs.any():
            which = np.repeat(np.arange(len(who)), runs + 1)
            ago = np.arange(len(which)) - np.repeat(np.cumsum(runs + 1) - runs - 1, runs + 1)
            order = np.argsort((c[which] * (int(runs.max()) + 1) + ago) * len(who) + which)
            which, ago = which[order], ago[order]
            who, c = who[which] - ago, c[which]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.append(first, len(c)))
        within = np.arange(len(c)) - np.repeat(first, count)
        if from_right:
            place[who] = edge[c] - 1 - within
            edge[c[first]] -= count
        else:
            place[who] = edge[c] + within
            edge[c[first]] += count


def permuted_common_prefixes(s: np.ndarray, order: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: its predecessor in the suffix array, and how many bytes the
    two have in common, at most to the nearer end of their contexts (`room`). Where
    the bytes before both agree, the count is one less than at the place before."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    known = (before > 0) & (place > 0)
    known[1:] &= (room[:-1] > 0) & (s[:-1] == s[np.maximum(before[1:] - 1, 0)]) & (before[:-1] == before[1:] - 1)
    lone = np.flatnonzero(~known)
    count = np.zeros(n, np.int64)
    limit = np.where(before[lone] >= 0, np.minimum(room[lone], room[np.maximum(before[lone], 0)]), 0)
    count[lone] = common(s, lone, np.maximum(before[lone], 0), limit)
    last = np.maximum.accumulate(np.where(known, 0, place))
    count = np.maximum(count[last] - (place - last), 0)
    return before, count


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context the starts of its strings of `length` bytes that also
    stand in another of the contexts (or elsewhere in it)."""
    sizes = np.array([len(x) for x in contexts], np.int64)
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 1
    s = np.append(raw, 0).astype(np.uint16)
    begins = ends - sizes
    text = np.repeat(np.arange(len(contexts)), sizes + 1)
    room = np.append(ends[text] - np.arange(len(raw)), 0)
    order = suffix_array(s)
    before, common = permuted_common_prefixes(s, order, room)
    hit = common >= length
    mark = hit.copy()
    mark[before[hit]] = True
    at = np.flatnonzero(mark)
    bounds = np.searchsorted(at, np.append(begins, len(raw)))
    return [at[a:b] - begin for a, b, begin in zip(bounds[:-1], bounds[1:], begins)]


def _runs(starts: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Maximal byte ranges covered by strings at the starts (ascending)."""
    if not len(starts):
        return [], []
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist()


_CUT = "owner {}, start int, anchor long, context_key binary, context binary, several boolean"


def _cut_rows(rows: list[tuple], owner: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = (owner, pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["owner", "start", "anchor", "context_key", "context", "several"])


def _key(context: bytes) -> bytes:
    return hashlib.blake2b(context, digest_size=16).digest()


def finer(context: bytes, width: int, length: int = LENGTH) -> list[tuple[int, bytes, bytes]]:
    """The context's strings dealt anew: (start, group, piece). A piece holds the
    strings that follow each other and have the same anchor at a place in them that
    is the same in steps of `width`; the group names the anchor's step and the bytes
    that any string with the anchor in that step holds around it, so equal strings
    fall into pieces of one group."""
    anchor, owner = owners(np.frombuffer(context, np.uint8), length)
    starts = np.arange(len(owner))
    step = (owner - starts) // width
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (step[1:] != step[:-1])]))
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(owner)]):
        low = int(owner[a] - step[a] * width)
        core = context[low : low + length + 1 - width]
        out.append((a, int(step[a]).to_bytes(2, "big") + core, context[a : b + length - 1]))
    return out


def repeated_spans(cuts: DataFrame, length: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """owner, a, b: byte ranges of the owners that repeated strings cover. cuts: owner,
    start, anchor, context_key and context of each place (the context may be missing
    where the same owner has it elsewhere), and whether it has several anchors, so
    that a string may stand in it twice."""
    once = cuts.groupBy("context_key").agg(F.first("anchor").alias("anchor"), F.first("context", ignorenulls=True).alias("context"), F.max("several").alias("several"), F.count("*").alias("places"))
    once = materialize(once, "distinct")
    by_anchor = once.groupBy("anchor").agg(F.count("*").alias("contexts"), F.max("several").alias("several"), F.sum(F.when(F.col("places") == 1, 1).otherwise(0)).alias("single"), F.sum(F.length("context")).alias("bytes"))
    by_anchor = materialize(by_anchor.where("(contexts > 1 or several) and single > 0").select("anchor", "bytes"), "counts")
    n, total = once.agg(F.sum("places"), F.sum(F.length("context"))).first()
    # fewer than SHARE anchors hold more than one in SHARE of all bytes, and as many contexts of all places
    giant = {r["anchor"]: r["bytes"] for r in by_anchor.where(F.col("bytes") * SHARE > (total or 0)).collect()}
    copied = once.where(F.col("places") * SHARE > (n or 0))
    candidates = once.select("anchor", "context_key", "context", "places")
    # giants are known to be compared, so no join has to say so
    large = F.col("anchor").isin(list(giant))
    some = candidates.where(~large).join(by_anchor, "anchor").unionByName(candidates.where(large).withColumn("bytes", F.when(F.col("anchor").isin([k for k, v in giant.items() if v > MOST]), MOST + 1).otherwise(0).cast("long")))
    compared = materialize(some, "compared")
    mild, hot = compared.where(F.col("bytes") <= MOST), compared.where(F.col("bytes") > MOST)
    volume, n_hot = compared.agg(F.sum(F.when(F.col("bytes") <= MOST, F.length("context"))), F.count_if(F.col("bytes") > MOST)).first()
    shards = max(1, -(-(volume or 0) // SHARD))

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by("context_key")
        contexts, places = group.column("context").to_pylist(), group.column("places").to_pylist()
        rows = [(key, *_runs(starts, length)) for key, starts, n in zip(group.column("context_key").to_pylist(), repeated_starts(contexts, length), places) if n == 1 and len(starts)]
        return pa.table({"context_key": pa.array([x[0] for x in rows], pa.binary()), "begins": pa.array([x[1] for x in rows], pa.list_(pa.int32())), "stops": pa.array([x[2] for x in rows], pa.list_(pa.int32()))})

    dealt = mild.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "context_key", "context", "places")
    spans = dealt_out(dealt, "shard", shards).groupBy("shard").applyInArrow(shard, "context_key binary, begins array<int>, stops array<int>")
    whole = once.where("places > 1").select("context_key", F.array(F.lit(0)).alias("begins"), F.array(F.length("context")).alias("stops"))
    spans = whole.unionByName(spans)
    if n_hot:
        width = widths[0]

        def deal(batches):
            for part in text_chunks(batches, "context", 1 << 18):
                out: list[tuple] = []
                for owner, anchor, context in zip(*(c.to_pylist() for c in part.columns)):
                    seen: set[bytes] = set()
                    for start, group, piece in finer(context, width, length):
                        key = _key(piece)
                        name = int.from_bytes(hashlib.blake2b(group, digest_size=8, key=anchor.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)
                        out.append((owner, start, name, key, None if key in seen else piece, False))
                        seen.add(key)
                        if len(out) >= 8192:
                            yield _cut_rows(out, pa.binary())
                            out = []
                yield _cut_rows(out, pa.binary())

        pieces = materialize(hot.select("context_key", "anchor", "context").mapInArrow(deal, _CUT.format("binary")), "pieces")
        found = repeated_spans(pieces, length, widths[1:])
        again = found.join(once.where("places = 1").select(F.col("context_key").alias("owner")), "owner", "left_semi").groupBy("owner").agg(F.collect_list(F.struct("a", "b")).alias("x"))
        spans = spans.unionByName(again.select(F.col("owner").alias("context_key"), F.col("x.a").alias("begins"), F.col("x.b").alias("stops")))
    spans = materialize(spans, "spans")
    placed = joined_evenly(cuts.select("owner", "start", "context_key"), spans, "context_key", copied.select("context_key"))
    out = placed.select("owner", F.explode(F.arrays_zip("begins", "stops")).alias("span"), "start").select("owner", (F.col("start") + F.col("span.begins")).alias("a"), (F.col("start") + F.col("span.stops")).alias("b"))
    out = materialize(out, "placed")
    discard(once, by_anchor, compared, spans, cuts)
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """text_key (MD5 of the text), n_bytes, n_removed, n_spans, kept (the bytes
    left) and kept_text (without the rests of characters that were cut) of each
    distinct text of docs; join it to documents by text_key.

    Equal texts of `length` bytes or more are repeated as a whole. Null texts have
    no row (see `digest`); shorter texts, and the empty one, lose nothing. Of very
    long texts a worker holds a few at a time, one at least. Only the text is read;
    an empty table gives no rows.
    """
    ship(docs.sparkSession)
    keyed = docs.where("text is not null").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    texts = keyed.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = materialize(texts.withColumn("id", F.monotonically_increasing_id()), "texts")

    def find(batches):
        for part in text_chunks(batches, "text", PIECE):
            raw = [x.encode() for x in part.column(1).to_pylist()]
            data = np.frombuffer(b"".join(raw), np.uint8)
            text, anchor, start, count, many = anchors(data, np.cumsum([len(x) for x in raw]), length)
            columns = [pa.array(anchor.view(np.int64)), part.column(0).take(pa.array(text)), *(pa.array(x, pa.int32()) for x in (start, count, many))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "id", "start", "n", "many"])

    long_texts = texts.where(F.octet_length("text") >= length)
    found = materialize(long_texts.select("id", "text").mapInArrow(find, "anchor long, id long, start int, n int, many int"), "anchors")
    twice = found.groupBy("anchor").agg(F.sum("many").alias("times"), F.count("*").alias("rows")).where("times > 1")
    twice = materialize(twice, "counts")
    # fewer than SHARE anchors hold more than one in SHARE of all rows; they occur twice, so no join has to say so
    often = F.col("anchor").isin([r["anchor"] for r in twice.where(F.col("rows") * SHARE > found.count()).select("anchor").collect()])
    runs = found.select("anchor", "id", "start", "n", "many")
    runs = runs.where(often).unionByName(runs.where(~often).join(twice.select("anchor"), "anchor", "left_semi"))
    repeated = runs.groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "n", "many")).alias("runs"))

    def cut(batches):
        for part in text_chunks(batches, "text", 1 << 18):
            out: list[tuple] = []
            for i, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw = text.encode()
                for run in runs:
                    context = raw[run["start"] : run["start"] + run["n"] + length - 1]
                    out.append((i, run["start"], run["anchor"], _key(context), context, run["many"] > 1))
                    if len(out) >= 8192:
                        yield _cut_rows(out, pa.int64())
                        out = []
            yield _cut_rows(out, pa.int64())

    cuts = repeated.join(long_texts.select("id", "text"), "id").select("id", "text", "runs")
    cuts = materialize(cuts.mapInArrow(cut, _CUT.format("long")), "contexts")
    discard(found, twice)
    spans = repeated_spans(cuts, length)
    by_text = spans.groupBy(F.col("owner").alias("id")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def remove(batches):
        for part in text_chunks(batches, "text"):
            out = []
            for key, text, copies, spans in zip(*(c.to_pylist() for c in part.columns)):
                raw = text.encode()
                if copies > 1 and len(raw) >= length:
                    merged = [(0, len(raw))]
                else:
                    merged = []
                    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                        else:
                            merged.append((a, b))
                bounds = [0, *(x for span in merged for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                out.append((key, len(raw), len(raw) - len(kept), len(merged), kept))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in columns[4]], pa.string())], ["text_key", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    joined = texts.join(by_text, "id", "left").select("text_key", "text", "copies", "spans")
    return joined.mapInArrow(remove, "text_key binary, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; a
    null text counts as empty. Repeated rows are copies of each other, and very many
    of them are joined by broadcast; other columns play no part."""
    found = without_repeats(docs, length).select("text_key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"))
    out = with_text(rows, found)
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *(F.coalesce(c, zero).alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.coalesce("kept_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("kept_sha256"))


def with_text(rows: DataFrame, by_text: DataFrame) -> DataFrame:
    """rows (with a text_key, null for a null text) with what by_text has for their
    text, or null. Texts that very many rows share are joined by broadcast."""
    by_text = materialize(by_text, "by_text")
    keyed = rows.where("text_key is not null")
    counts = keyed.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1")
    copied = counts.where(F.col("n") * SHARE > keyed.count()).select("text_key")
    none = rows.where("text_key is null")
    lost = none.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in by_text.schema if f.name != "text_key"))
    return joined_evenly(keyed, by_text, "text_key", materialize(copied, "copied")).unionByName(lost)

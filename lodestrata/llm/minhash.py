"""Near-duplicate groups by MinHash: universal hash minima, banding, verification
by signature and then on full sets, and connected components by alternating
large-star and small-star.

Documents with equal shingle sets are one node from the start, so copies are never
compared. A node's signature holds BANDS * ROWS minima; nodes that agree on all
rows of a band share a bucket. Within a bucket no pairs are listed at first: each
node is compared with the lead of one of its buckets (the node that shares most
buckets with others), that which is most like it. Only nodes that then still lie in
different components of a common bucket are paired, if their signatures, sizes and
parities allow the similarity asked for; a large bucket's nodes are dealt to cells,
and each pair of cells is a group of its own. All pairs that count are confirmed on
the full sets.

A set's parities tell for each of PARITIES hash classes whether it holds an odd
number of shingles. Classes in which two sets differ are at most as many as the
shingles that only one of them holds, so a pair with more than the similarity allows
is ruled out for certain, also in large groups whose members are nearly similar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.llm.common import SHARE, discard, joined_evenly, materialize, mix64, ship, text_chunks

BANDS, ROWS = 40, 6
#: Bits of the sketch: one of each minimum.
BITS = BANDS * ROWS
WORDS = (BITS + 63) // 64
PARITIES = 1024
#: Nodes of a bucket that are paired with each other in one group.
CELL = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base, and of its inverse (modulo 2^64)."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_ODD, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of raw, A-Z lower-cased,
    and where they start. A word's hash doesn't depend on its place."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    letter = np.zeros(len(data) + 2, np.int8)
    letter[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(letter)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer than `size`
    words has its whole sequence as one shingle; one without words has none."""
    raw = [(x or "").encode() for x in texts]
    hashes, starts = word_hashes(b" ".join(raw))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))
    mixed = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        mixed = mixed * _ODD + hashes[i : i + len(mixed)]
    mixed = mix64(mixed)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            found = np.unique(mixed[a : b - size + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mix64(whole * _ODD + hashes[i : i + 1])
            found = whole
        else:
            found = np.zeros(0, np.uint64)
        out.append(found)
    return out


class Signer:
    """Minima of BITS universal hash functions (a * x + b) mod 2^32, a odd."""

    def __init__(self, seed: int = 1):
        random = np.random.default_rng(seed)
        self.a = random.integers(0, 1 << 32, BITS, np.uint32) | np.uint32(1)
        self.b = random.integers(0, 1 << 32, BITS, np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(x), 2048):
            values = np.multiply.outer(self.a, x[i : i + 2048])
            values += self.b[:, None]
            np.minimum(out, values.min(axis=1), out=out)
        return out


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number for each band of each signature."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        out = mix64(out * _ODD + rows[:, :, i])
    return out.view(np.int64)


def sketches_of(signatures: np.ndarray) -> np.ndarray:
    """A bit of each minimum, packed into WORDS longs."""
    bits = ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    packed = np.zeros((len(bits), WORDS * 8), np.uint8)
    packed[:, : BITS // 8] = np.packbits(bits, axis=1)
    return packed.view(np.int64)


def parities_of(sets: list[np.ndarray]) -> np.ndarray:
    """The parities of each set, packed into longs."""
    out = np.zeros((len(sets), PARITIES), np.uint8)
    for row, x in zip(out, sets):
        row[:] = np.bincount((x % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(out, axis=1).view(np.int64)


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), text_key, bands, sketch, parity of every row."""
    ship(docs.sparkSession)

    def run(batches):
        sign = Signer()
        for part in text_chunks(batches, "text"):
            sets = shingle_sets(part.column(1).to_pylist(), size)
            signatures = np.stack([sign(x) for x in sets])
            keys = [None if not len(x) else mix64(x ^ np.uint64(0x5851F42D4C957F2D)).sum().tobytes() + mix64(x + np.uint64(0x14057B7EF767814F)).sum().tobytes() for x in sets]
            bands, words = bands_of(signatures), sketches_of(signatures)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), part.column(2), lists(bands), lists(words), lists(parities_of(sets))],
                ["doc_id", "n_shingles", "set_key", "text_key", "bands", "sketch", "parity"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, text_key binary, bands array<long>, sketch array<long>, parity array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, often: DataFrame, size: int) -> DataFrame:
    """id and the whole shingle set of the nodes `wanted` (id, text_key). `often`
    (fewer than SHARE rows: text_key, doc_id): texts that very many rows hold, and a
    row that does; its other copies aren't shuffled."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    hot = F.broadcast(often.select("text_key", F.col("doc_id").alias("_lead")))
    rest = texts.join(hot, "text_key", "left_anti").join(wanted.select("text_key"), "text_key", "left_semi")
    led = texts.join(hot, "text_key").where(F.col("doc_id").eqNullSafe(F.col("_lead"))).groupBy("text_key").agg(F.first("text").alias("text"))
    once = rest.groupBy("text_key").agg(F.first("text").alias("text")).unionByName(led)

    def run(batches):
        for part in text_chunks(batches, "text"):
            sets = shingle_sets(part.column(1).to_pylist(), size)
            ends = np.cumsum([0, *map(len, sets)])
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))], ["id", "shingles"])

    return wanted.join(once, "text_key").select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")), "a")

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                s, t = left[i].values.to_numpy(), right[i].values.to_numpy()
                shared = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and root (the smallest id reachable) of every id in links (a, b), by
    alternating large-star and small-star until the links don't change. Each step
    is an aggregation and a join; nothing but two numbers reaches the driver."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges, old = materialize(small, "links"), edges
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _apart(x: str, y: str, longs: int) -> Column:
    """How many bits two arrays of longs differ in."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(longs)), F.lit(0))


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether sizes, sketches and parities of two nodes allow the similarity. Bits of
    the sketches agree with probability (1 + similarity) / 2, and six standard
    deviations below the mean are allowed. Shingles of only one set are at most
    (100 - percent) / (100 + percent) of the two sizes' sum."""
    agree = (1 + percent / 100) / 2
    least = int(BITS * agree - 6 * (BITS * agree * (1 - agree)) ** 0.5)
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    sketches = _apart(f"{x}sketch", f"{y}sketch", WORDS) <= BITS - least
    return sizes & sketches & (_apart(f"{x}parity", f"{y}parity", PARITIES // 64) * (100 + percent) <= (n + m) * (100 - percent))


def grouped(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, set_key, text_key of every row of docs, and `lead`: of the
    group that it is linked with the least row (is doc_id null, doc_id, text_key); null
    for an empty set."""
    rows = materialize(profiles(docs, size), "profiles")
    some = rows.where("set_key is not null")
    first = {x: F.first(x).alias(x) for x in ("sketch", "parity", "bands")}
    nodes = some.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("lead"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), *first.values())
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    many = F.col("copies") * SHARE > rows.count()

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"), F.col("parity").alias(f"{name}_parity"))

    buckets = nodes.select("id", F.explode("bands").alias("bucket"))
    sizes = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    places = sizes.agg(F.sum("members")).first()[0] or 0
    large = sizes.where(F.col("members") * SHARE > places).select("bucket")
    shared = materialize(joined_evenly(buckets, sizes, "bucket", large).select("bucket", "id", "members"), "buckets")
    central = shared.groupBy("id").agg(F.sum("members").alias("weight"))
    leads = shared.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("lead"))

    # first: each node against the lead that is most like it
    trial = joined_evenly(shared.select("bucket", "id"), leads, "bucket", large).where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    trial = trial.join(side("a"), "a").join(side("b"), "b")
    best = trial.where(_alike("a_", "b_", percent)).groupBy("b").agg(F.min(F.struct(_apart("a_parity", "b_parity", PARITIES // 64).alias("apart"), F.col("a"))).alias("best"))
    pairs = materialize(best.select("best.a", "b"), "pairs")
    wanted = shared.select("id").distinct().join(nodes.select("id", "lead.text_key"), "id")
    sets = materialize(full_sets(docs, wanted, nodes.where(many).select("lead.text_key", "lead.doc_id"), size), "sets")
    links = materialize(verified(pairs, sets, percent), "verified")
    labels = materialize(components(links), "labels")

    # then: whatever shares a bucket with another component
    labelled = shared.select("bucket", "id").join(labels, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / CELL).cast("int").alias("cells")).where("low < high").select("bucket", "cells")
    open_ = joined_evenly(labelled, mixed, "bucket", large).join(nodes.select("id", "n", "sketch", "parity"), "id")
    open_ = materialize(open_.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")), "mixed")
    columns = ("id", "root", "n", "sketch", "parity")
    x = open_.select("bucket", F.col("cell").alias("i"), F.explode(F.sequence("cell", F.col("cells") - 1)).alias("j"), *(F.col(c).alias(f"x_{c}") for c in columns))
    y = open_.select("bucket", F.explode(F.sequence(F.lit(0), "cell")).alias("i"), F.col("cell").alias("j"), *(F.col(c).alias(f"y_{c}") for c in columns))
    same = (x["bucket"] == y["bucket"]) & (x["i"] == y["i"]) & (x["j"] == y["j"])
    crossing = x.join(y, same & (F.col("x_root") != F.col("y_root")) & ((x["i"] < x["j"]) | (F.col("x_id") < F.col("y_id"))) & _alike("x_", "y_", percent))
    pairs = crossing.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    more = materialize(verified(pairs, sets, percent), "verified")
    if not more.isEmpty():
        labels = materialize(components(links.unionByName(more)), "labels")

    named = nodes.select("id", "set_key", "lead", "copies").join(labels, "id", "left")
    linked, alone = named.where("root is not null"), named.where("root is null")
    least = materialize(linked.groupBy("root").agg(F.min("lead").alias("least"), F.count("*").alias("members")), "least")
    wide = least.where(F.col("members") * SHARE > (least.agg(F.sum("members")).first()[0] or 0)).select("root")
    led = joined_evenly(linked, least.drop("members"), "root", wide)
    found = led.select("set_key", F.col("least").alias("lead"), many.alias("many")).unionByName(alone.select("set_key", "lead", many.alias("many")))
    found = materialize(found, "leads")
    discard(nodes, sizes, shared, sets, links, open_, more, labels, least)
    slim = rows.select("doc_id", "n_shingles", "set_key", "text_key")
    out = joined_evenly(slim.where("set_key is not null"), found.drop("many"), "set_key", found.where("many").select("set_key"))
    return out.unionByName(slim.where("set_key is null").withColumn("lead", F.lit(None).cast(found.schema["lead"].dataType)))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Linked are documents whose shingle sets have 100 * intersection >= percent *
    union; component_id is the smallest doc_id reachable. A null text, and one
    without words, has an empty set and is linked with nothing: its component_id
    is its doc_id. A null doc_id loses against any other as component_id. Repeated
    rows are linked, and stay (kept) together, as they carry the same doc_id. Texts
    may be of any length: their whole sets are compared. An empty table gives no
    rows; only doc_id and text are read.

    If minima were independent, a pair of similarity s would be found with
    probability 1 - (1 - s^ROWS)^BANDS: all but 5 in a million at 0.8, all but 2 in
    10^10 at 0.9. The README has the share that is found among all pairs.
    """
    rows = grouped(docs, size, percent)
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id and text_key (MD5 of the text, null for a null one) of the rows that
    stay if one row of each group does, without repeats: the least of the group by
    doc_id (null: last) and then text_key. Rows without words stay."""
    rows = grouped(docs, size, percent)
    is_lead = F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.text_key") == F.col("text_key"))
    return rows.where(F.col("set_key").isNull() | is_lead).select("doc_id", "text_key").distinct()


#: The same groups by all pairs of different sets that share a shingle.
SQL = r"""
with recursive t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
w as (select doc_id, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as w from t),
s as (select doc_id, list_sort(case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end) as s from w),
c as (select s, min(doc_id) as id, len(s) as n from s where len(s) > 0 group by s),
u as (select id, n, unnest(s) as g from c),
p as (select a.id as a, b.id as b, a.n as an, b.n as bn, count(*) as shared from u a join u b on a.g = b.g and a.id < b.id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by all),
l as (select a, b from p where 100 * shared >= 80 * (an + bn - shared)),
e as (select a, b from l union all select b, a from l),
r(id, root) as (select id, id from c union select e.b, r.root from r join e on r.id = e.a),
m as (select id, min(root) as root from r group by id)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(m.root, s.doc_id) as component_id, s.doc_id = coalesce(m.root, s.doc_id) as kept
from s left join c on c.s = s.s left join m on m.id = c.id
"""

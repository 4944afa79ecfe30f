"""Exact top-k inner products by a dual-tree search over cover trees.

Candidates are indexed once: dealt to blocks by the nearest of some pivots (the top
of a cover tree over a bounded sample), and each block is stored as one row, its
vectors in the order of the block's cover tree. Queries are indexed in the same way.
They are then searched for in batches of bounded size: a batch's trees are broadcast,
each task runs them against the blocks it reads, one after the other, so the bounds
found in one block prune the next, and only each task's best k are shuffled. Before
the first block a query's k-th score is that among the sample.

Trees are over directions (vectors at length one); distances are chords. A node of
level i covers its points within RATIO ** -i * 2 of its centre, its children's centres
lie farther apart than the children's level allows them to cover, and a node's centre
is its first child's. Small children share a node, so that points are scored many at
a time. For a node of queries and one of candidates whose centres lie
at an angle t, and whose points lie within angles r and s of them, no cosine exceeds
cos(t - r - s); with the nodes' least and greatest norms that bounds the inner
product. A pair of nodes is pruned when the bound is below the worst k-th score of
the node's queries. Before two leaves are scored, each candidate of the one is held
against the node of queries, and each query against the node of candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.llm.common import dealt_out, discard, materialize, ship

#: Rows of a block on average, and its bytes at most.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Queries searched for together, and their bytes, about.
BATCH, BATCH_BYTES = 16_384, 32 << 20
#: Rows of the sample that pivots and first bounds come from, its bytes, and pivots, at most.
SAMPLE, SAMPLE_BYTES, PIVOTS = 4096, 32 << 20, 512
#: A node of at most so many points isn't divided, and shares a node with such siblings;
#: of queries, which are fewer, so many.
LEAF, QUERY_LEAF = 32, 8
#: How much less each level covers than the one above it.
RATIO = 1.3
#: Added to angles against rounding.
SLACK = 1e-6


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length one (the zero vector: along the first axis), and their norms."""
    largest = np.abs(vectors).max(axis=1, initial=0)
    scaled = vectors / np.where(largest > 0, largest, 1)[:, None]
    norms = np.sqrt((scaled**2).sum(axis=1))
    out = scaled / np.where(norms > 0, norms, 1)[:, None]
    out[norms == 0, :1] = 1
    return out, norms * largest


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between points at length one."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cover_radius(level: int) -> float:
    return 2.0 * RATIO**-level


class CoverTree:
    """A cover tree over directions; points stand in its order (`order` names their
    rows), so a node's are those from lo to before hi, its centre the first of them.
    Nodes as parallel arrays: lo, hi, centre, level, parent, angle (to the farthest
    point), least and most (norms). Children of at most `leaf` points share a node of
    level -1 around their parent's centre."""

    FIELDS = ("order", "lo", "hi", "centre", "level", "parent")
    MEASURES = ("angle", "least", "most")

    def __init__(self, points: np.ndarray, norms: np.ndarray, leaf: int = LEAF):
        order: list[np.ndarray] = []
        nodes: list[list] = []
        stack = [(np.arange(len(points)), chords(points, points[:1])[:, 0], 0, -1)] if len(points) else []
        at = 0
        while stack:
            rows, dist, level, parent = stack.pop()
            if level < 0:  # small children
                nodes.append([at, at + len(rows), nodes[parent][2], -1, parent, float(dist.max())])
                order.append(rows)
                at += len(rows)
                continue
            reach = float(dist.max())
            node = len(nodes)
            nodes.append([at, at + len(rows), at, level, parent, reach])
            while cover_radius(level + 1) >= reach and reach > SLACK:
                level += 1
            nodes[node][3] = level
            if len(rows) <= leaf or reach <= SLACK:
                order.append(rows)
                at += len(rows)
                continue
            groups = net(points, rows, dist, cover_radius(level + 1))
            large = [g for g in groups if len(g[0]) > leaf]
            small = [r for r, _ in groups if len(r) <= leaf]
            if small:
                together = np.concatenate(small)
                stack.append((together, chords(points[together], points[rows[:1]])[:, 0], -1, node))
                if len(groups[0][0]) <= leaf:  # then the centre is the first of them
                    stack[-1], pooled = None, stack[-1]
                    stack[-1:] = [(r, d, level + 1, node) for r, d in large[::-1]] + [pooled]
                    continue
            stack += [(r, d, level + 1, node) for r, d in large[::-1]]
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        table = np.array(nodes, np.float64).reshape(-1, 6)
        self.lo, self.hi, self.centre, self.level, self.parent = (table[:, i].astype(np.int64) for i in range(5))
        self.angle = 2 * np.arcsin(np.minimum(table[:, 5] / 2, 1))
        held = norms[self.order]
        self.least = np.array([held[a:b].min() for a, b in zip(self.lo, self.hi)])
        self.most = np.array([held[a:b].max() for a, b in zip(self.lo, self.hi)])

    @classmethod
    def stored(cls, fields: dict[str, bytes]) -> "CoverTree":
        tree = cls.__new__(cls)
        for name in cls.FIELDS:
            setattr(tree, name, np.frombuffer(fields[name], np.int64))
        for name in cls.MEASURES:
            setattr(tree, name, np.frombuffer(fields[name], np.float64))
        return tree

    def fields(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name)).tobytes() for name in (*self.FIELDS, *self.MEASURES)}

    def children(self) -> list[np.ndarray]:
        by = np.argsort(self.parent, kind="stable")
        bounds = np.searchsorted(self.parent[by], np.arange(len(self.parent) + 1))
        return [by[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def net(points: np.ndarray, rows: np.ndarray, dist: np.ndarray, radius: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """rows divided into groups (rows and distances, the group's centre first): centres,
    the first of which is rows[0], lie farther apart than radius, all others within it
    of their centre. dist: distances from rows[0]."""
    near = dist <= radius
    near[0] = True
    groups, rest = [(rows[near], dist[near])], rows[~near]
    while len(rest):
        head = rest[:256]
        apart = chords(points[head], points[head])
        covered, chosen = np.zeros(len(head), bool), []
        for i in range(len(head)):
            if not covered[i]:
                chosen.append(i)
                covered |= apart[i] <= radius
                covered[i] = True
        centres = head[chosen]
        reach = chords(points[rest], points[centres])
        own = reach.argmin(axis=1)
        own[chosen] = np.arange(len(chosen))  # the centres are the first of rest
        least = reach[np.arange(len(rest)), own]
        least[chosen] = 0
        taken = least <= radius
        by = np.argsort(own[taken], kind="stable")
        members, reaches, owner = rest[taken][by], least[taken][by], own[taken][by]
        bounds = np.searchsorted(owner, np.arange(len(chosen) + 1))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            first = np.flatnonzero(members[a:b] == centres[k])[0]
            by_centre = np.concatenate([[first], np.delete(np.arange(b - a), first)])
            groups.append((members[a:b][by_centre], reaches[a:b][by_centre]))
        rest = rest[~taken]
    return groups


class Side:
    """Vectors in the order of their cover tree, with ids and row numbers."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, null: np.ndarray, rows: np.ndarray, tree: CoverTree):
        self.vectors, self.ids, self.null, self.rows, self.tree = vectors, ids, null, rows, tree
        self.points, self.norms = directions(vectors)
        self.children = tree.children()
        self.largest = float(np.abs(vectors).max(initial=0))

    @classmethod
    def of(cls, vectors: np.ndarray, ids: np.ndarray, null: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> "Side":
        tree = CoverTree(*directions(vectors), leaf)
        return cls(vectors[tree.order], ids[tree.order], null[tree.order], rows[tree.order], tree)


class Best:
    """The best k of each query so far: scores, ids (and whether they are null), descending, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores = k, np.full((n, k), -np.inf)
        self.ids, self.null, self.rows = np.zeros((n, k), np.int64), np.ones((n, k), bool), np.full((n, k), -1, np.int64)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, rows: np.ndarray) -> None:
        """scores (queries `at` x candidates); -inf doesn't count."""
        k, n = self.k, scores.shape[1]
        worst = self.scores[at, k - 1]
        if n > k:
            worst = np.maximum(worst, np.partition(scores, n - k, axis=1)[:, n - k])
        row, column = np.nonzero((scores >= worst[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        changed = np.unique(row)
        old, place = np.nonzero(self.rows[at[changed]] >= 0)
        old = changed[old]
        all_row = np.concatenate([old, row])
        value = np.concatenate([self.scores[at[old], place], scores[row, column]])
        name, none, number = (np.concatenate([mine[at[old], place], theirs[column]]) for mine, theirs in ((self.ids, ids), (self.null, null), (self.rows, rows)))
        order = np.lexsort((number, name, none, -value, all_row))
        all_row = all_row[order]
        rank = np.arange(len(order)) - np.searchsorted(all_row, all_row)
        top = rank < k
        order, all_row, rank = order[top], at[all_row[top]], rank[top]
        self.scores[all_row, rank], self.ids[all_row, rank], self.null[all_row, rank], self.rows[all_row, rank] = value[order], name[order], none[order], number[order]


def bounds(a: Side, i: int, b: Side, nodes: np.ndarray) -> np.ndarray:
    """No inner product of points of a's node i and of b's nodes exceeds these."""
    t, u = a.tree, b.tree
    return _bound(b.points[u.centre[nodes]] @ a.points[t.centre[i]], t.angle[i] + u.angle[nodes], (t.least[i], t.most[i]), (u.least[nodes], u.most[nodes]))


def _bound(cosine: np.ndarray, angles, one: tuple, other: tuple) -> np.ndarray:
    most = np.cos(np.clip(np.arccos(np.clip(cosine, -1, 1)) - angles - SLACK, 0, np.pi))
    top = np.where(most >= 0, one[1] * other[1], one[0] * other[0]) * most
    return top + 1e-9 * (1 + one[1] * other[1])


def search(queries: Side, first: int, candidates: Side, best: Best) -> int:
    """Offer to `best` (whose rows from `first` on are the queries) whatever
    candidates may be among the best; a query's own row isn't offered. Returns how
    many pairs were scored."""
    t, u = queries.tree, candidates.tree
    if not len(t.lo) or not len(u.lo):
        return 0
    scored, heap = 0, []

    def offer(i: int, nodes: np.ndarray) -> None:
        worst = best.scores[first + t.lo[i] : first + t.hi[i], -1].min()
        tops = bounds(queries, i, candidates, nodes)
        for top, j in zip(tops.tolist(), nodes.tolist()):
            if top >= worst:
                heapq.heappush(heap, (-top, i, j))

    offer(0, np.zeros(1, np.int64))
    while heap:
        top, i, j = heapq.heappop(heap)
        worst = best.scores[first + t.lo[i] : first + t.hi[i], -1]
        if -top < worst.min():
            continue
        mine, theirs = queries.children[i], candidates.children[j]
        if not len(mine) and not len(theirs):
            at, b = np.arange(t.lo[i], t.hi[i]), np.arange(u.lo[j], u.hi[j])
            if len(at) > 2:  # one product tells for the whole node of queries
                norms = candidates.norms[b]
                tops = _bound(candidates.points[b] @ queries.points[t.centre[i]], t.angle[i], (t.least[i], t.most[i]), (norms, norms))
                b = b[tops >= worst.min()]
                if not len(b):
                    continue
            norms = queries.norms[at]
            tops = _bound(queries.points[at] @ candidates.points[u.centre[j]], u.angle[j], (norms, norms), (u.least[j], u.most[j]))
            at = at[tops >= worst]
            if not len(at):
                continue
            scores = queries.vectors[at] @ candidates.vectors[b].T
            scores[queries.rows[at][:, None] == candidates.rows[b][None, :]] = -np.inf
            scored += scores.size
            best.offer(first + at, scores, candidates.ids[b], candidates.null[b], candidates.rows[b])
        elif len(mine) and (not len(theirs) or t.angle[i] > u.angle[j]):
            for child in mine.tolist():
                offer(child, np.array([j]))
        else:
            offer(i, theirs)
    return scored


def exact(queries: Side, first: int, candidates: Side, k: int) -> list[tuple[int, int, int, bool, int]]:
    """The best k of each query (its place, score, id, whether that is null, row),
    in whole numbers of any size."""
    points = [[int(x) for x in v] for v in candidates.vectors.tolist()]
    out = []
    for i, v in enumerate(queries.vectors.tolist()):
        whole = [int(x) for x in v]
        scored = [(-sum(x * y for x, y in zip(whole, w)), bool(candidates.null[j]), int(candidates.ids[j]), int(candidates.rows[j])) for j, w in enumerate(points) if candidates.rows[j] != queries.rows[i]]
        out += [(first + i, -s, name, null, row) for s, null, name, row in heapq.nsmallest(k, scored)]
    return out


_TREE = [f"{x} binary" for x in (*CoverTree.FIELDS, *CoverTree.MEASURES)]
INDEX = ", ".join(["dim int", "n long", "vectors binary", "ids binary", "nulls binary", "rows binary", *_TREE])


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(1024 * x) of each component, as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values.reshape(len(column), -1) * 1024)


def _side(row: dict) -> Side:
    kind = bytes(row["vectors"][:1])
    vectors = np.frombuffer(row["vectors"], {b"s": np.int16, b"d": np.float64}[kind], offset=8).astype(np.float64).reshape(row["n"], -1)
    return Side(vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["rows"], np.int64), CoverTree.stored(row))


def index(rows: DataFrame, pivots: dict[int, np.ndarray], name: str, leaf: int = LEAF) -> DataFrame:
    """One row a block of `rows` (vec_id, _row, _dim, embedding): its vectors in the
    order of its cover tree, and the tree. pivots: directions by dimension."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS directions at most

    def nearest(batches):
        for batch in batches:
            dims, column = batch.column(2).to_numpy(), batch.column(3)
            cell = np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims):
                if int(dim) in shared.value:
                    at = np.flatnonzero(dims == dim)
                    for k in range(0, len(at), 4096):
                        part = at[k : k + 4096]
                        cell[part] = (directions(_matrix(column.take(pa.array(part))))[0] @ shared.value[int(dim)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "_row", "_dim", "embedding", "_cell"])

    placed = rows.select("vec_id", "_row", "_dim", "embedding").mapInArrow(nearest, "vec_id long, _row long, _dim int, embedding array<double>, _cell int")
    placed = materialize(placed, "cells")
    sizes = placed.groupBy("_dim", "_cell").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.least(F.lit(BLOCK), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES / 8) / F.col("_dim")))))
    # the cells with most rows, at most two a pivot; any other cell has fewer rows than the table by their number
    large = sizes.orderBy(F.desc("n"), "_dim", "_cell").limit(2 * PIVOTS).select("_dim", "_cell", blocks.alias("_blocks"))
    total = placed.count()
    small = max(1, -(-total // (2 * PIVOTS * BLOCK)))
    salted = placed.join(F.broadcast(large), ["_dim", "_cell"], "left").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.coalesce("_blocks", F.lit(small))))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("_row")
        vectors, column = _matrix(group.column("embedding").combine_chunks()), group.column("vec_id")
        null = column.is_null().to_numpy()
        side = Side.of(vectors, column.fill_null(0).to_numpy(), null, group.column("_row").to_numpy(), leaf)
        narrow = side.largest < 2**15
        raw = (b"s" if narrow else b"d").ljust(8) + np.ascontiguousarray(side.vectors.astype(np.int16 if narrow else np.float64)).tobytes()
        fields = {"dim": vectors.shape[1], "n": len(vectors), "vectors": raw, "ids": side.ids.tobytes(), "nulls": side.null.tobytes(), "rows": side.rows.tobytes(), **side.tree.fields()}
        return pa.table({k: pa.array([v], {int: pa.int64()}.get(type(v), pa.binary())) for k, v in fields.items()}).cast(pa.schema([("dim", pa.int32()), ("n", pa.int64()), *((k, pa.binary()) for k in list(fields)[2:])]))

    dealt = salted.select("_dim", "_cell", "_salt", "vec_id", "_row", "embedding", F.xxhash64("_dim", "_cell", "_salt").alias("_block"))
    groups = dealt_out(dealt, "_block", max(1, -(-total // BLOCK))).groupBy("_block", "_dim", "_cell", "_salt")
    out = materialize(groups.applyInArrow(build, INDEX), name)
    discard(placed)
    return out


def top_of(points: np.ndarray, most: int) -> np.ndarray:
    """Centres of the deepest level of the points' cover tree that has at most so many."""
    centres, level = points[:1], 1
    while True:
        found = net(points, np.arange(len(points)), chords(points, points[:1])[:, 0], cover_radius(level))
        if len(found) > most or level > 60:
            return centres
        centres, level = points[[g[0][0] for g in found]], level + 1


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose
    vec_id is divisible by `every`.

    Rows whose embedding is null or empty, or holds a null, NaN or infinite
    component, take no part; vectors of different length aren't compared. Rows
    that repeat a vec_id are rows of their own: only the query's own row isn't its
    candidate. A null vec_id can't be a query, and loses ties. Scores beyond a
    long are clipped to its range. With fewer candidates than k, all are returned.
    An empty table gives no rows; other columns play no part, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.monotonically_increasing_id().alias("_row")).where(
        "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    sound = materialize(sound.withColumn("_dim", F.size("embedding")), "vectors")
    is_query = F.col("vec_id") % every == 0
    n, n_queries, widest = sound.agg(F.count("*"), F.count_if(is_query), F.max("_dim")).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # a bounded sample: pivots, and a first bound for each query
    some = sound.orderBy(F.xxhash64("_row"), "_row").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))).select("vec_id", "_row", "_dim", "embedding").toArrow()
    samples = {}
    for dim in set(some.column("_dim").to_pylist()):
        part = some.filter(pc.equal(some.column("_dim"), dim))
        ids = part.column("vec_id")
        samples[dim] = (_matrix(part.column("embedding").combine_chunks()), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), part.column("_row").to_numpy())
    tops = lambda rows: {d: top_of(directions(s[0])[0], max(1, min(PIVOTS, rows // BLOCK))) for d, s in samples.items()}
    candidates = index(sound, tops(n), "index")
    wanted = index(sound.where(is_query), tops(n_queries), "queries", QUERY_LEAF)

    results, batch = [], []
    for row in wanted.toLocalIterator():
        batch.append(row.asDict())
        if sum(x["n"] for x in batch) >= BATCH or sum(len(x["vectors"]) for x in batch) >= BATCH_BYTES:
            results.append(_searched(candidates, batch, samples, k))
            batch = []
    if batch:
        results.append(_searched(candidates, batch, samples, k))
    discard(sound, candidates, wanted)
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


def _searched(candidates: DataFrame, batch: list[dict], samples: dict, k: int) -> DataFrame:
    """The best k of each query of a batch (rows of an index) among all candidates."""
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast((batch, samples))  # about BATCH vectors, and SAMPLE

    def run(batches):
        queries, small = shared.value
        sides = [_side(x) for x in queries]
        starts = np.cumsum([0, *(len(x.ids) for x in sides)])
        best, more = Best(int(starts[-1]), k), []
        floor = np.full(int(starts[-1]), -np.inf)
        for side, start in zip(sides, starts):
            vectors, ids, null, rows = small.get(side.vectors.shape[1], (np.zeros((0, side.vectors.shape[1])),) + (np.zeros(0, np.int64),) * 3)
            if len(ids) > k and side.largest * np.abs(vectors).max() * vectors.shape[1] < 2.0**52:
                for i in range(0, len(side.ids), 2048):
                    scores = side.vectors[i : i + 2048] @ vectors.T
                    scores[side.rows[i : i + 2048][:, None] == rows[None, :]] = -np.inf
                    floor[start + i : start + i + len(scores)] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        best.scores[:] = floor[:, None]  # a lower bound; rows still say that nothing is held
        for part in batches:
            for row in part.to_pylist():
                block = _side(row)
                for side, start in zip(sides, starts.tolist()):
                    if side.vectors.shape[1] != block.vectors.shape[1]:
                        continue
                    if side.largest * block.largest * block.vectors.shape[1] < 2.0**52:
                        search(side, start, block, best)
                    else:  # beyond doubles' integers
                        more += exact(side, start, block, k)
        at, place = np.nonzero(best.rows >= 0)
        own, names = np.concatenate([x.rows for x in sides]), np.concatenate([x.ids for x in sides])
        clip = lambda x: max(-(2**63), min(2**63 - 1, x))
        columns = [
            pa.array(np.concatenate([own[at], own[[m[0] for m in more]]]) if more else own[at], pa.int64()),
            pa.array(np.concatenate([names[at], names[[m[0] for m in more]]]) if more else names[at], pa.int64()),
            pa.array([None if none else x for x, none in zip(best.ids[at, place].tolist(), best.null[at, place].tolist())] + [None if m[3] else m[2] for m in more], pa.int64()),
            pa.array(best.scores[at, place].astype(np.int64).tolist() + [clip(m[1]) for m in more], pa.int64()),
            pa.array(best.rows[at, place].tolist() + [m[4] for m in more], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_id", "score", "row"])

    found = candidates.mapInArrow(run, "query_row long, query_id long, vec_id long, score long, row long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]))::bigint as score
    from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

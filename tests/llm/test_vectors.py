import random

import numpy as np
import pytest

from lodestrata.llm import topk
from tests.compare import assert_same


def brute(rows, k, every):
    ok = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in ok]
    out = []
    for a, (q, v) in enumerate(whole):
        if q is not None and q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i is None, i or 0) for b, (i, w) in enumerate(whole) if b != a and len(w) == len(v))[:k]
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(scored)]
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.1))) for c in r.choice(centres)]) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(0, rows[1][1]), (0, rows[1][1]), (None, rows[2][1])]
    rows += [(700, None), (701, []), (702, [None] * 8), (703, [float("nan")] * 8), (704, [float("inf")] * 8), (710, [1.0, 2.0]), (712, [2.0, 1.0])]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<float>, _row string")
    for block, batch, sample in ((2048, 16_384, 4096), (64, 30, 40), (64, 16_384, 4096)):
        for name, value in (("BLOCK", block), ("BATCH", batch), ("SAMPLE", sample)):
            monkeypatch.setattr(topk, name, value)
        got = [tuple(x) for x in topk.top_k(df, 10, 10).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, 10, 10), key=str)


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(3e9 + i)), -1e9, 7.0]) for i in range(12)]
    got = [tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3, 5).collect()]
    want = [(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in brute(rows, 3, 5)]
    assert sorted(got) == sorted(want)


def test_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def clustered(n, dims=64, share=0.7, seed=3):
    """Unit vectors, most of them in tight clusters."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    centres = rng.normal(size=(8, dims))
    at = rng.integers(0, 8, n)
    x = np.where((rng.random(n) < share)[:, None], centres[at] + 0.08 * x, x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("points", [clustered(1500), clustered(900, share=0), np.random.default_rng(3).normal(size=(700, 3)).round(1), np.ones((200, 4)), clustered(50)], ids=["clustered", "random", "few dimensions", "equal", "small"])
def test_cover_tree(points):
    directions, norms = topk.directions(points)
    tree = topk.CoverTree(directions, norms, 16)
    assert sorted(tree.order) == list(range(len(points)))
    x, norms = directions[tree.order], norms[tree.order]
    children = tree.children()
    chord = lambda a, b: np.linalg.norm(x[a][:, None] - x[b][None], axis=2)
    for node, (lo, hi, centre, level) in enumerate(zip(tree.lo, tree.hi, tree.centre, tree.level)):
        inside = np.arange(lo, hi)
        reach = chord(np.array([centre]), inside).max()
        assert 2 * np.arcsin(min(1, reach / 2)) <= tree.angle[node] + topk.SLACK
        assert tree.least[node] == norms[lo:hi].min() and tree.most[node] == norms[lo:hi].max()
        if level < 0:
            assert not len(children[node])
            continue
        assert centre == lo and reach <= topk.cover_radius(level) + topk.SLACK  # covering
        if len(children[node]):
            parts = np.concatenate([np.arange(tree.lo[c], tree.hi[c]) for c in children[node]])
            assert sorted(parts) == list(inside)
            centres = np.array([tree.centre[c] for c in children[node] if tree.level[c] >= 0], np.int64)
            pool = np.concatenate([np.zeros(0, np.int64), *(np.arange(tree.lo[c], tree.hi[c]) for c in children[node] if tree.level[c] < 0)])
            assert centre == tree.lo[children[node]].min() and all(tree.level[c] < 0 or tree.level[c] > level for c in children[node])  # nesting, levels
            apart = chord(centres, centres)[~np.eye(len(centres), dtype=bool)]
            assert apart.min(initial=9) > topk.cover_radius(level + 1) - topk.SLACK  # separation
            assert chord(np.array([centre]), np.append(centres, pool)).max() <= topk.cover_radius(level) + topk.SLACK
            assert all(tree.hi[c] - tree.lo[c] > 16 for c in children[node] if tree.level[c] >= 0)
        else:
            assert hi - lo <= 16 or reach <= 2 * topk.SLACK


@pytest.mark.parametrize("share", [0.7, 0])
def test_nets_cover_and_separate(share):
    points = clustered(800, share=share)
    for radius in (0.5, 1.1, 1.3):
        groups = topk.net(points, np.arange(800), topk.chords(points, points[:1])[:, 0], radius)
        assert sorted(np.concatenate([r for r, _ in groups])) == list(range(800)) and groups[0][0][0] == 0
        centres = points[[r[0] for r, _ in groups]]
        apart = topk.chords(centres, centres)[~np.eye(len(centres), dtype=bool)]
        assert apart.min(initial=9) > radius - topk.SLACK
        for r, d in groups:
            assert np.allclose(topk.chords(points[r], points[r[:1]])[:, 0], d, atol=1e-6) and d.max() <= radius + topk.SLACK


def scored_share(points, queries):
    whole = np.floor(1024 * points)
    side = lambda at, leaf: topk.Side.of(whole[at], at, np.zeros(len(at), bool), at, leaf)
    q, c = side(queries, topk.QUERY_LEAF), side(np.arange(len(points)), topk.LEAF)
    best = topk.Best(len(queries), 10)
    scored = topk.search(q, 0, c, best)
    scores = whole[q.rows] @ whole.T
    scores[np.arange(len(queries)), q.rows] = -np.inf
    for i, row in enumerate(scores):
        assert best.ids[i].tolist() == np.lexsort((np.arange(len(points)), -row))[:10].tolist()
    return scored / (len(points) * len(queries))


def test_pairs_of_nodes_are_pruned():
    points = clustered(2000, share=0.9)
    assert scored_share(points, np.arange(0, 2000, 10)) < 0.5
    assert scored_share(clustered(2000, share=1.0), np.arange(0, 2000, 10)) < 0.2
    # directions without any structure can't be pruned by any bound on angles
    assert scored_share(clustered(1000, share=0), np.arange(0, 1000, 10)) <= 1


def test_query_agrees_with_sql(spark, sf, duck):
    from lodestrata.llm.queries import op10_cover_tree_top_k

    assert_same(op10_cover_tree_top_k(spark, sf), duck.sql(topk.SQL).df())

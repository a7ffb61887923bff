"""Clustering and nearest neighbours against plain computations over all pairs."""

import functools
import hashlib
import math
import operator
import random

import numpy as np
import pytest

from lodestrata.llm import centroids, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string, points string"
DIMS = 64


def vectors(seed, n, spread=0.1, centers=5, dims=DIMS):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centers, dims))
    return (middle[r.integers(0, centers, n)] + spread * r.normal(size=(n, dims))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, "d", "p") for i, e in rows], SCHEMA)


def odd_rows(x):
    """Vectors with ties, repeated rows, null ids, and ones that take no part."""
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, x[0].tolist()), (1001, x[0].tolist()), rows[3], (None, x[5].tolist()), (None, x[6].tolist())]
    return rows, [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [1.0] * 63 + [math.nan]), (2005, [math.inf] + [1.0] * 63), (None, [1.0] * 65)]


def plain_clusters(rows, k=16, rounds=3):
    ids = [i for i, _ in rows]
    points = [[max(-(1 << 26), min(1 << 26, math.floor(64 * float(np.float32(x))))) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda j: (ids[j] is None, hashlib.sha256(f"1:{ids[j]}".encode()).hexdigest() if ids[j] is not None else "", rows[j][1]))
    middle = [points[j] for j in order[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        own = [[] for _ in middle]
        for p in points:
            own[nearest(p)[1]].append(p)
        middle = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, middle, strict=True)]
    found = [nearest(p) for p in points]
    per = [sum(d for d, j in found if j == c) for c in range(len(middle))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted((-1 if i is None else i, j, d, per[j], sum(per), digest[j]) for i, (d, j) in zip(ids, found, strict=True))


@pytest.mark.parametrize("case", ["clustered", "apart", "far", "few", "same"])
def test_clusters_are_those_of_all_pairs(spark, case):
    x = {"clustered": lambda: vectors(1, 300, 0.02), "apart": lambda: vectors(2, 200, 1.0), "far": lambda: vectors(3, 100) * np.float32(3e4) ** np.arange(100)[:, None].clip(0, 3), "few": lambda: vectors(4, 7), "same": lambda: np.repeat(vectors(5, 3), 40, 0)}[case]()
    rows, out = odd_rows(x)
    got = centroids.cluster(frame(spark, rows + out).repartition(3), block=64).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == plain_clusters(rows)


def test_clusters_of_nothing(spark):
    assert centroids.cluster(frame(spark, [])).count() == 0
    assert centroids.cluster(frame(spark, [(1, None), (2, [0.0])])).count() == 0


def test_trees_prune_whole_nodes_and_lose_nothing():
    points = centroids.integers(vectors(7, 4000, 0.01, 8))
    tree, order = centroids.KdTree.build(points)
    assert sorted(order) == list(range(4000)) and (tree.points == points[order]).all()
    for i in range(len(tree.start)):
        own = tree.points[tree.start[i] : tree.stop[i]]
        assert (own.min(0) == tree.low[i]).all() and (own.max(0) == tree.high[i]).all() and (own.sum(0, dtype=np.int64) == tree.sums[i]).all()
    middle = points[:16].astype(np.int64)
    middle[3] = middle[2]  # a tie goes to the smaller number
    nodes, _, leaves, _ = tree.filter(middle)
    whole = sum(tree.stop[nodes] - tree.start[nodes])
    assert whole > 0 and whole + sum(tree.stop[leaves] - tree.start[leaves]) == 4000
    nearest, distance = tree.assigned(middle)
    every = ((tree.points[:, None].astype(np.int64) - middle) ** 2).sum(2)
    assert (nearest == every.argmin(1)).all() and (distance == every.min(1)).all() and 3 not in nearest
    counts, sums = tree.sums_by_centroid(middle)
    assert counts.tolist() == np.bincount(nearest, minlength=16).tolist()
    assert all((sums[c] == tree.points[nearest == c].sum(0)).all() for c in range(16))


def test_distances_are_exact_at_the_bounds():
    r = random.Random(3)
    for bound in (centroids.EXACT, centroids.LARGEST):
        x = np.array([[r.choice([-bound, bound, r.randrange(-bound, bound)]) for _ in range(DIMS)] for _ in range(20)], np.int32)
        c = x[:4].astype(np.int64) * np.array([[1], [-1], [1], [-1]])
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, m, strict=True)) for m in c] for p in x]
        assert centroids.squared(x, c).tolist() == want


def plain_neighbours(rows, k=5):
    """All pairs, in the operator's order of additions; equal (id, vector) rows once, shorter vectors ending in zeros."""
    seen = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    dims = max((len(v) for _, v in seen), default=0)
    seen = [(i, v + (0.0,) * (dims - len(v))) for i, v in seen]
    added = lambda a, b: functools.reduce(operator.add, (x * y for x, y in zip(a, b, strict=True)))
    seen = sorted({(i, tuple(x + 0.0 for x in v)) for i, v in seen})
    out = []
    for i, v in seen:
        if i % 50 == 0:
            found = [(-(added(v, w) / (math.sqrt(added(v, v)) * math.sqrt(added(w, w)))), j) for j, w in seen if j != i]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["clustered", "apart", "scaled", "few", "same", "copies", "one shard"])
def test_neighbours_are_those_of_all_pairs(spark, case):
    x = {
        "clustered": lambda: vectors(11, 1500, 0.05), "apart": lambda: vectors(12, 1200, 1.0, dims=16), "scaled": lambda: np.concatenate([vectors(13, 250), 2 * vectors(13, 250), np.float32(1e19) * vectors(13, 250)]),
        "few": lambda: vectors(14, 7), "same": lambda: np.repeat(vectors(15, 2), 300, 0), "copies": lambda: np.concatenate([np.repeat(vectors(16, 1), 700, 0), vectors(17, 900)]), "one shard": lambda: vectors(18, 150),
    }[case]()
    rows, out = odd_rows(x)
    rows += [(100, x[1].tolist()), (150, (-x[2]).tolist()), (3000, [0.5, -0.0]), (3050, [0.5, 0.0]), (3100, [0.0] * 8)]
    got = neighbours.nearest(frame(spark, rows + out).repartition(3), neighbours.F.col("vec_id") % 50 == 0, piece=1 << 12 if case != "one shard" else 1 << 19, sample=1 << 14).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_neighbours(rows + out)


def test_blocks_of_queries_never_pass_the_driver(spark, monkeypatch):
    """A small table of queries becomes as many blocks as there are pieces, so its size says nothing about what a broadcast would hold."""
    made, plans = neighbours.materialize, []

    def watched(df, name):
        if name == "found":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made(df, name)

    monkeypatch.setattr(neighbours, "materialize", watched)
    x = vectors(19, 1500, 1.0, dims=16)
    assert neighbours.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), neighbours.F.col("vec_id") % 50 == 0, piece=1 << 12, sample=1 << 14).count() == 150
    joins = [[line for line in plan.split("== Initial Plan ==")[0].splitlines() if "Join" in line and "piece" in line] for plan in plans]
    assert len(joins) == 2 and all(len(lines) == 1 and "SortMergeJoin" in lines[0] for lines in joins), joins


def test_neighbours_of_nothing(spark):
    asks = neighbours.F.col("vec_id") % 50 == 0
    assert neighbours.nearest(frame(spark, []), asks).count() == 0
    assert neighbours.nearest(frame(spark, [(0, None), (50, [0.0])]), asks).count() == 0
    assert neighbours.nearest(frame(spark, [(0, [1.0]), (7, None)]), asks).count() == 0


def test_larger_factors_search_less_and_keep_most(spark):
    """The factor trades comparisons for recall; at one nothing is lost."""
    points = neighbours.units(vectors(21, 6000, 0.25, 40, 24))
    tree, order = neighbours.VantageTree.build(points, neighbours.LEAF)
    asked = points[::50]
    exact = np.argsort(-(asked @ points.T), axis=1)[:, :6]
    looked, recall = [], []
    for factor in (1.0, 1.5, 2.0, 4.0):
        piece = neighbours.Piece(tree, points[order], order.astype(np.int64), np.ones(len(order), np.int32))
        query, ids, _ = piece.search(asked, np.full(len(asked), -2.0), 6, factor)
        looked.append(piece.looked / (len(asked) * len(points)))
        recall.append(np.mean([len({*ids[query == i]} & {*exact[i]}) / 6 for i in range(len(asked))]))
    assert recall[0] == 1 and recall[1] >= 0.9 and looked[0] < 0.9
    assert looked == sorted(looked, reverse=True) and looked[3] < looked[0] / 2

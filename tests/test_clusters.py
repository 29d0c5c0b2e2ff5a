"""Density and linkage clusters, and graphs, against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import density as D
from millrace.operators import linkage as L
from millrace.operators.graphs import components


def plain_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_dbscan(rows, eps, least):
    """All pairs: (key, cluster, core) of rows (key, features)."""
    sound = [r for r in rows if all(x is not None and math.isfinite(x) for x in r[1])]
    close = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) <= eps * eps
    core = [sum(close(a, b) for _, b in sound) >= least for _, a in sound]
    cores = [i for i, c in enumerate(core) if c]
    of = plain_components(cores, [(i, j) for i in cores for j in cores if i < j and close(sound[i][1], sound[j][1])])
    name = {}
    for i in cores:
        name[of[i]] = min(name.get(of[i], sound[i][0]), sound[i][0])
    out = [(k, None, False) for k, x in rows if (k, x) not in sound]
    for i, (k, x) in enumerate(sound):
        met = [name[of[j]] for j in cores if close(x, sound[j][1])]
        out.append((k, name[of[i]] if core[i] else min(met, default=None), core[i]))
    return sorted(out, key=str)


def clusters(spark, rows, eps, least):
    d = len(rows[0][1])
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(k, *x, "x", 1) for k, x in rows], f"id long, {', '.join(f'{n} double' for n in names)}, cluster string, n int").repartition(3)
    return sorted(map(tuple, D.dbscan(df, "id", names, eps, least).collect()), key=str)


@pytest.mark.parametrize("d, n, eps, least", [(1, 120, 0.3, 4), (2, 250, 0.5, 5), (2, 200, 0.25, 1), (3, 220, 1.0, 6), (4, 60, 2.0, 3)])
def test_dbscan_equals_all_pairs(spark, d, n, eps, least):
    rng = random.Random(d * n)
    centres = [[rng.uniform(-5, 5) for _ in range(d)] for _ in range(4)]
    rows = [(i, [rng.gauss(c, 0.6) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[i % 7][1]) for i in range(12)] + [(1000, [None] * d), (1001, [float("nan")] + [0.0] * (d - 1)), (1002, [float("inf")] * d)]
    assert clusters(spark, rows, eps, least) == plain_dbscan(rows, eps, least)


def test_dbscan_at_the_edges_of_cells(spark):
    """Points on a lattice whose step is exactly the reach, in halves of it, and both zeros."""
    rows = [(10 * i + j, [float(i), float(j)]) for i in range(-3, 4) for j in range(-3, 4)] + [(500, [0.5, 0.0]), (501, [-0.0, -0.0]), (502, [7.5, 7.5])]
    for least in (1, 3, 5, 6):
        assert clusters(spark, rows, 1.0, least) == plain_dbscan(rows, 1.0, least)


def test_crowds_are_not_paired(spark):
    """A hundred thousand equal points, as many in one cell, and two crowds just out of reach of each other."""
    same = spark.range(100_000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    near = lambda x, first: spark.range(40_000).select((F.col("id") + first).alias("id"), (F.lit(x) + (F.xxhash64("id") % 1000) / 1e6).alias("x"), (F.lit(50.0) + F.col("id") / 1e7).alias("y"))
    lone = spark.createDataFrame([(1_000_000, 1.05, 2.0), (1_000_001, 300.0, 2.0)], "id long, x double, y double")
    got = D.dbscan(same.unionAll(near(10.0, 200_000)).unionAll(near(10.103, 300_000)).unionAll(near(20.0, 400_000)).unionAll(near(20.1, 500_000)).unionAll(lone), "id", ["x", "y"], 0.1, 3)
    counts = {(r.cluster, r.core): r["count"] for r in got.groupBy("cluster", "core").count().collect()}
    assert counts == {(0, True): 100_001, (None, False): 1, (200_000, True): 40_000, (300_000, True): 40_000, (400_000, True): 80_000}


def test_dbscan_of_nothing(spark):
    df = spark.createDataFrame([], "id long, x double")
    assert D.dbscan(df, "id", ["x"], 1.0, 2).collect() == []
    with pytest.raises(ValueError):
        D.dbscan(df, "id", ["x"] * 5, 1.0, 2)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    assert got == plain_components(nodes, [e for e in edges if e[0] != e[1]])


def plain_linkage(rows, clusters):
    """All pairs, the shortest first, until so many groups are left: (key, cluster)."""
    least = {}
    for k, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            least[tuple(x + 0.0 for x in v)] = min(k, least.get(tuple(x + 0.0 for x in v), k))
    points = sorted((k, v) for v, k in least.items())
    edges = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(p, q))), i, j) for i, (_, p) in enumerate(points) for j, (_, q) in enumerate(points) if i < j and len(p) == len(q))
    of, groups = list(range(len(points))), len(points)
    for _, i, j in edges:
        if groups <= clusters:
            break
        if of[i] != of[j]:
            of, groups = [of[i] if r == of[j] else r for r in of], groups - 1
    name = {}
    for r, (k, _) in zip(of, points):
        name[r] = min(k, name.get(r, k))
    at = {v: name[r] for r, (_, v) in zip(of, points)}
    return sorted(((k, None if v is None or tuple(v) not in at else at[tuple(v)]) for k, v in rows), key=str)


def linked(spark, rows, clusters, **how):
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "id long, v array<double>, cluster string").repartition(3)
    return sorted(map(tuple, L.single_linkage(df, "id", "v", clusters, **how).collect()), key=str)


def test_single_linkage_equals_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(10 * (i % 4), 1.5), rng.gauss(0, 1.5), rng.gauss(0, 1)]) for i in range(60)]
    rows += [(200, None), (201, [float("nan"), 0.0, 0.0]), (202, [None, 1.0, 2.0]), (203, rows[4][1]), (204, rows[4][1])]
    for clusters, how in ((4, {}), (9, {"pivots": 5, "block": 16})):
        assert linked(spark, rows, clusters, **how) == plain_linkage(rows, clusters)


def test_ties_on_a_lattice(spark):
    """Every step has the same length, so only the order of ties says what is joined."""
    rows = [(7 * (i * 6 + j) % 37, [float(i), float(j)]) for i in range(6) for j in range(6)]
    for clusters, how in ((3, {"pivots": 3, "block": 12}), (20, {})):
        assert linked(spark, rows, clusters, **how) == plain_linkage(rows, clusters)


def test_linkage_of_little(spark):
    assert linked(spark, [(1, None)], 2) == [(1, None)]
    assert linked(spark, [(3, [1.0]), (2, [1.0]), (1, [5.0])], 5) == [(1, 1), (2, 2), (3, 2)]
    assert linked(spark, [(3, [1.0]), (2, [2.0]), (1, [5.0, 1.0])], 1) == [(1, 1), (2, 2), (3, 2)]
    df = spark.createDataFrame([], "id long, v array<double>")
    assert L.single_linkage(df, "id", "v", 2).collect() == []


def test_only_near_blocks_meet_and_only_once(spark, monkeypatch):
    """Two far lines of points: a block meets its neighbours, and the lines meet, but most pairs of blocks are ruled out."""
    rng, met, near = random.Random(12), [], L._near_pairs
    at = {i: (rng.random() + i + (10_000 if i >= 150 else 0), 0.0) for i in range(300)}
    monkeypatch.setattr(L, "_near_pairs", lambda blocks: met.append((blocks.count(), near(blocks).select("pair").distinct().count())) or near(blocks))
    points = spark.createDataFrame([(i, "", list(v)) for i, v in at.items()], "key long, kind string, v array<double>")
    got = sorted((r.a, r.b) for r in L.spanning_forest(points, pivots=20, block=32).collect())
    assert got == [(i, i + 1) for i in range(299)]
    [(blocks, pairs)] = met
    assert blocks >= 15 and blocks - 1 <= pairs < blocks * (blocks - 1) / 4

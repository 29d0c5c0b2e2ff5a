"""Single-linkage clusters: trees of blocks and of the blocks' near pairs, whose edges hold the forest of least distances, without its longest ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, passing, saved
from .graphs import components
from .neighbours import BLOCK, SLACK, build
from .order import numbered
from .relational import join_groups

_AT = ["kind", "size", "cell", "no"]


def _tree(x: np.ndarray, least: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of least distances over rows in the order of their keys, by Prim's steps: the rows as they come in, how far from the tree, and each one's edge (i < j).

    Ties go by i, then j. A distance counts as the ``least`` of either row at least; rows at no finite distance begin a tree of their own.
    """
    n, xt, i = len(x), np.ascontiguousarray(x.T), np.arange(len(x))
    least, best, to, outside, u = np.broadcast_to(least, n), np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), 0
    order, far, edge = np.zeros(n, int), np.full(n, np.inf), np.zeros(n, int)
    for step in range(1, n):
        outside[u], best[u] = False, np.inf
        with np.errstate(over="ignore"):
            d = np.maximum(np.sqrt(((xt - xt[:, u : u + 1]) ** 2).sum(0)), np.maximum(least, least[u]))
        better, tie = (d < best) & outside, (d == best) & outside
        if tie.any():
            lo, hi, was_lo, was_hi = np.minimum(i, u), np.maximum(i, u), np.minimum(i, to), np.maximum(i, to)
            better |= tie & ((lo < was_lo) | (lo == was_lo) & (hi < was_hi))
        best[better], to[better] = d[better], u
        near = best.min()
        v = int(best.argmin()) if near < np.inf else int(outside.argmax())
        if near < np.inf and len(same := np.flatnonzero(best == near)) > 1:
            v = int(same[np.lexsort((np.maximum(same, to[same]), np.minimum(same, to[same])))[0]])
        order[step], far[step], edge[step], u = v, near, to[v], v
    return order, far, np.minimum(order, edge), np.maximum(order, edge)


def _own_tree(g: pd.DataFrame) -> pd.DataFrame:
    """A block's own edges, and a row (a and b null) with its longest one, a vector, and the box of all of them."""
    g = g.sort_values("key", ignore_index=True)
    x, keys = np.stack(g["v"].to_numpy()), g["key"].to_numpy()
    _, far, i, j = _tree(x)
    joined = np.isfinite(far)
    out = pd.DataFrame({"dist": far[joined], "a": keys[i[joined]], "b": keys[j[joined]], "v": None, "low": None, "high": None}).astype(object)
    out.loc[len(out)] = [float(far[1:].max(initial=0.0)), None, None, x[0], x.min(0), x.max(0)]
    return out.assign(**{c: g[c].iloc[0] for c in _AT})


def _gap(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The least distance that points of boxes can have."""
    with np.errstate(over="ignore"):
        return np.sqrt((np.maximum(0, np.maximum(lows - high, low - highs)) ** 2).sum(1))


def _near_pairs(blocks: DataFrame) -> DataFrame:
    """(pair, kind, size, cell, no, within): two rows for each pair of blocks between which an edge can be; it is not longer than ``within``.

    A tree over one vector of each block joins all points, together with the blocks' own trees. Two points are joined in it by edges of no more
    than the largest step between their blocks in Prim's order, so a longer edge between them is none of the forest. Blocks' boxes, no rows, pass the driver.
    """
    facts, groups, start = blocks.orderBy(*_AT).collect(), [], 0
    while start < len(facts):
        own = [r for r in facts[start:] if (r.kind, r.size) == (facts[start].kind, facts[start].size)]
        order, step, _, _ = _tree(np.array([r.v for r in own], float), np.array([r.dist for r in own], float))
        groups.append((start, order, step, np.array([r.low for r in own], float), np.array([r.high for r in own], float)))
        start += len(own)
    starts = np.array([g[0] for g in groups])
    spark, many = blocks.sparkSession, len(facts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in b["id"]:
                first, order, step, low, high = groups[int(np.searchsorted(starts, at, "right")) - 1]
                k, later = order[at - first], order[at - first + 1 :]
                within = np.maximum.accumulate(step[at - first + 1 :]) * (1 + SLACK) + SLACK
                met = _gap(low[k], high[k], low[later], high[later]) <= within
                for block in (np.full(met.sum(), k), later[met]):
                    yield pd.DataFrame({"pair": (first + k) * many + first + later[met], "block": first + block, "within": within[met]})

    places = spark.createDataFrame([(i, *(r[c] for c in _AT)) for i, r in enumerate(facts)], f"block long, {', '.join(f'{c} {blocks.schema[c].dataType.simpleString()}' for c in _AT)}")
    return spark.range(many).mapInPandas(run, "pair long, block long, within double").join(F.broadcast(places), "block")


def _between(g: pd.DataFrame) -> pd.DataFrame:
    """The edges between two blocks in the tree of those of their points that are within reach of the other block's box."""
    g = g.sort_values("key", ignore_index=True)
    x, keys, side, within = np.stack(g["v"].to_numpy()), g["key"].to_numpy(), (g["block"] == g["block"].iloc[0]).to_numpy(), g["within"].iloc[0]
    near = np.zeros(len(g), bool)
    for own in (side, ~side):
        near[own] = _gap(x[~own].min(0), x[~own].max(0), x[own], x[own]) <= within
    x, keys, side = x[near], keys[near], side[near]
    if not len(x):
        return pd.DataFrame({"dist": [0.0], "a": [0], "b": [0]})[:0]
    _, far, i, j = _tree(x)
    told = (side[i] != side[j]) & (far <= within) & np.isfinite(far)
    return pd.DataFrame({"dist": far[told], "a": keys[i[told]], "b": keys[j[told]]})


def least_forest(edges: DataFrame, keep: Callable[..., None] = lambda *_: None) -> DataFrame:
    """(dist, a, b) of the edges that join all that ``edges`` (dist, a, b, with a < b) join, at the least total; ties go by a, then b.

    Each round joins every component by its least edge, and drops the edges inside components: as many rounds as the number of nodes has bits, at most.
    """
    left, out = saved(edges.select("dist", "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges"), None
    while True:
        ends = left.select("*", F.explode(F.array("ca", "cb")).alias("comp"))
        least = saved(ends.groupBy("comp").agg(F.min(F.struct("dist", "a", "b", "ca", "cb")).alias("e")).select("e.*").distinct(), "edges")
        if least.isEmpty():
            return edges.select("dist", "a", "b").limit(0) if out is None else out
        keep(least)
        out = least.select("dist", "a", "b") if out is None else out.unionAll(least.select("dist", "a", "b"))
        roots = saved(components(least.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "roots")
        one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("ca", "cb"))
        rest = left.join(one, "ca").join(two, "cb").filter("ca_root != cb_root").select("dist", "a", "b", F.col("ca_root").alias("ca"), F.col("cb_root").alias("cb"))
        rest = saved(rest, "edges")
        discard(left, roots)
        left = rest


def spanning_forest(points: DataFrame, pivots: int | None = None, block: int = BLOCK, keep: Callable[..., None] = lambda *_: None) -> DataFrame:
    """(dist, a, b) of the edges that join all points (key: a long, kind, v) of a kind and length at the least total distance; ties go by a, then b.

    An edge of the forest is in the tree of any part of the points that holds both its ends. So the trees of single blocks, and of those pairs
    of blocks that can have an edge, hold all of them; a task has two blocks at a time. The forest is then found among these edges.
    """
    rows = build(points, pivots, block).rows.withColumn("size", F.size("v")).select(*_AT, "key", "v")
    kinds = f"{', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in _AT)}, dist double, a long, b long, v array<double>, low array<double>, high array<double>"
    shared = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are small but long at work, so they are dealt out evenly
    own = saved(rows.repartition(shared, *_AT).groupBy(*_AT).applyInPandas(_own_tree, kinds), "trees")
    pairs = saved(_near_pairs(own.filter("a IS NULL").drop("a", "b")), "pairs")
    between = rows.join(pairs, _AT).repartition(shared, "pair").groupBy("pair").applyInPandas(_between, "dist double, a long, b long")
    return least_forest(own.filter("a IS NOT NULL").select("dist", "a", "b").unionAll(between), keep)


def single_linkage(df: DataFrame, key: str, vector: str, clusters: int, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(key, cluster): rows in ``clusters`` groups, such that nearest groups were joined first; a group is named by its least key.

    Distances are Euclidean. Of equally long joins, those between points of smaller least keys come first. Rows of equal vectors
    are one point and never parted, so there are at most as many clusters as different vectors. A vector
    that is null or holds null, NaN or infinity has no cluster (null); vectors of different lengths are never joined, so each length has
    a cluster at least. Points are compared block by block, see ``spanning_forest``; a vector that very many rows share is one point.
    """
    rows = df.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double") + 0.0).alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    with passing() as keep:
        distinct = rows.filter(sound).groupBy("v").agg(F.min("key").alias("least"), F.count("*").alias("n"))
        points = saved(numbered(distinct, ["least", "v"], "place"), "points")
        many = points.count()
        keep(points)
        if many:
            edges = spanning_forest(points.select(F.col("place").alias("key"), F.lit("").alias("kind"), "v"), pivots, block)
            short = numbered(edges, ["dist", "a", "b"], "place").filter(F.col("place") <= many - clusters).select("a", "b")
            roots = components(short)
            root = points.join(roots, F.col("place") == F.col("node"), "left").select("v", "n", "least", F.coalesce("root", "place").alias("root"))
            named = saved(root.join(root.groupBy("root").agg(F.min("least").alias("cluster")), "root").select("v", "n", "cluster"), "named")
        else:
            named = saved(points.select("v", "n", F.col("least").alias("cluster")), "named")
        keep(named)
        size = named.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    out = join_groups(rows.filter(sound), named, ["v"], "n", size["all"] or 0, size["most"] or 0).select("key", "cluster")
    return out.unionAll(rows.filter(~sound).select("key", F.lit(None).cast(df.schema[key].dataType))).withColumnRenamed("key", key)

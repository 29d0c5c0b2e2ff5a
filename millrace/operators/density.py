"""Clusters of points by density: grid cells stand for the points they hold, so that no crowd of them is paired."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import passing, saved
from .graphs import components
from .relational import join_groups

#: Features up to which cells have few enough neighbours: 5^3 for three, 7^4 at most for four.
MOST_FEATURES = 4
#: Points of a cell that meet others in one piece.
PIECE = 2_000
#: Halvings of a cell after which what is left is compared point by point.
HALVINGS = 24
#: A cell's side is a little shorter than it might be, so that rounding never puts two points of one cell out of reach.
MARGIN = 1e-6


def _total(cols: list[Column]) -> Column:
    return sum(cols[1:], cols[0])


def _sizes(df: DataFrame, size: str) -> tuple[int, int]:
    """(all rows, rows of the largest group) of a table of groups."""
    got = df.agg(F.sum(size).alias("all"), F.max(size).alias("most")).first()
    return got["all"] or 0, got["most"] or 0


class Grid:
    """Cells of points in d dimensions, so small that all points of a cell are within ``eps`` of each other."""

    def __init__(self, d: int, eps: float):
        self.d, self.eps, self.side = d, eps, eps / math.sqrt(d) * (1 - MARGIN)
        self.xs, self.cs = [f"x{i}" for i in range(d)], [f"c{i}" for i in range(d)]
        self.ts = [f"t{i}" for i in range(d)]
        self.far = math.floor(math.sqrt(d) + 1e-9) + 1

    def cells(self, level: int = 0) -> list[Column]:
        """The numbers of a point's cell, halved ``level`` times."""
        return [F.floor(F.col(x) / F.lit(self.side / (1 << level))) for x in self.xs]

    def close(self, a: str, b: str) -> Column:
        gaps = [F.col(f"{a}.{x}") - F.col(f"{b}.{x}") for x in self.xs]
        return _total([g * g for g in gaps]) <= F.lit(self.eps * self.eps)

    def around(self, df: DataFrame, ahead: bool = False) -> DataFrame:
        """Every row with each cell (``ts``) that can hold a point within reach of its own (``cs``); ``ahead``: only those that come after it."""
        for c, t in zip(self.cs, self.ts):
            df = df.select("*", F.explode(F.sequence(F.col(c) - self.far, F.col(c) + self.far)).alias(t))
        apart = _total([F.pow(F.greatest(F.abs(F.col(t) - F.col(c)) - 1, F.lit(0)), 2) for c, t in zip(self.cs, self.ts)])
        df = df.filter(apart <= self.d)
        return df.filter(F.struct(*self.ts) > F.struct(*(F.col(c).alias(t) for c, t in zip(self.cs, self.ts)))) if ahead else df

    def met(self, probes: DataFrame, points: DataFrame, counts: DataFrame) -> DataFrame:
        """Pairs (p, q) of a probe and a point within reach; ``points`` are dealt out in pieces, of which ``counts`` says how many a cell has."""
        asked = self.around(probes).select(F.struct(*probes.columns).alias("p"), *(F.col(t).alias(c) for c, t in zip(self.cs, self.ts)))
        asked = asked.join(counts.select(*self.cs, "pieces"), self.cs).select("p", *self.cs, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        dealt = points.select(F.struct(*points.columns).alias("q"), *self.cs, "piece")
        return asked.join(dealt, [*self.cs, "piece"]).filter(self.close("p", "q")).select("p", "q")


def _linked(grid: Grid, cores: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b) of neighbouring cells that hold core points within reach of each other.

    A pair of boxes is linked if their farthest corners, or one point of each, are within reach, and not if
    their nearest sides aren't; what is neither is halved in every direction. So no crowd of points is paired,
    however many two cells hold; only points that 2^-24 of a cell can't tell apart meet one by one.
    """
    reach = F.lit(grid.eps * grid.eps)
    bounds = [f(x).alias(f"{n}{x}") for x in grid.xs for n, f in (("lo", F.min), ("hi", F.max))]
    one = F.min(F.struct(*grid.xs)).alias("one")

    def boxes(level: int, within: DataFrame) -> DataFrame:
        sub = F.array(*grid.cells(level)).alias("sub")
        return saved(within.groupBy("cell", sub).agg(*bounds, one), "boxes")

    def bounded(pairs: DataFrame) -> DataFrame:
        gap = [F.greatest(F.col(f"p.lo{x}") - F.col(f"q.hi{x}"), F.col(f"q.lo{x}") - F.col(f"p.hi{x}"), F.lit(0.0)) for x in grid.xs]
        span = [F.greatest(F.col(f"p.hi{x}") - F.col(f"q.lo{x}"), F.col(f"q.hi{x}") - F.col(f"p.lo{x}")) for x in grid.xs]
        at = [F.col(f"p.one.{x}") - F.col(f"q.one.{x}") for x in grid.xs]
        sure = F.least(_total([s * s for s in span]), _total([a * a for a in at])) <= reach
        return pairs.filter(_total([g * g for g in gap]) <= reach).select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b"), F.col("p.sub").alias("sa"), F.col("q.sub").alias("sb"), sure.alias("sure"))

    whole = boxes(0, cores).join(cells, "cell")
    asked = grid.around(whole, ahead=True).select(F.struct(*whole.columns).alias("p"), *(F.col(t).alias(c) for c, t in zip(grid.cs, grid.ts)))
    open_ = saved(bounded(asked.join(whole.select(F.struct(*whole.columns).alias("q"), *grid.cs), grid.cs)), "pairs")
    links = []
    for level in range(1, HALVINGS + 1):
        links.append(saved(open_.filter("sure").select("a", "b").distinct(), "links"))
        open_ = saved(open_.join(links[-1], ["a", "b"], "left_anti").select("a", "b", "sa", "sb"), "pairs")
        if open_.isEmpty():
            break
        left = open_.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        sub = boxes(level, cores.join(left, "cell")).withColumn("up", F.transform("sub", lambda s: F.shiftright(s, 1)))
        p, q = (sub.select(F.col("cell").alias(c), F.col("up").alias(f"s{c}"), F.struct("cell", "sub", "one", *(f"{n}{x}" for x in grid.xs for n in ("lo", "hi"))).alias(n)) for c, n in (("a", "p"), ("b", "q")))
        open_ = saved(bounded(open_.join(p, ["a", "sa"]).join(q, ["b", "sb"])), "pairs")
    else:
        at = F.array(*grid.cells(HALVINGS))
        p, q = (cores.select(F.col("cell").alias(c), at.alias(f"s{c}"), F.struct(*grid.xs).alias(n)) for c, n in (("a", "p"), ("b", "q")))
        tight = open_.filter("NOT sure").select("a", "b", "sa", "sb").join(p, ["a", "sa"]).join(q, ["b", "sb"]).filter(grid.close("p", "q"))
        links.append(saved(open_.filter("sure").select("a", "b").unionAll(tight.select("a", "b")).distinct(), "links"))
    out = links[0]
    for more in links[1:]:
        out = out.unionAll(more)
    return out


def dbscan(df: DataFrame, key: str, features: list[str], eps: float, least: int) -> DataFrame:
    """(key, cluster, core) of every row: density clusters of one to four numeric features.

    A row is core if ``least`` rows or more, itself among them, are within ``eps`` of it. Core rows within
    reach of each other are of one cluster, which is named by the least key of its core rows; another row
    belongs to the least cluster of the core rows within its reach, and to none (null) without one.

    Rows with a null, NaN or infinite feature have no cluster and aren't core; rows of equal features are one
    point of that weight. A cell with ``least`` rows is all core and is not compared inside; rows of emptier
    cells meet those of the cells around, so a row meets at most ``least`` times the neighbouring cells others,
    and a cell's rows are dealt out in pieces. Clusters are components of cells, see ``_linked``.
    """
    if not 1 <= len(features) <= MOST_FEATURES:
        raise ValueError(f"one to {MOST_FEATURES} features, not {len(features)}")
    grid = Grid(len(features), float(eps))
    rows = df.select(F.col(key).alias("key"), *((F.col(c).cast("double") + 0.0).alias(x) for c, x in zip(features, grid.xs)))
    sound = F.lit(True)
    for x in grid.xs:
        sound = sound & F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    with passing() as keep:
        points = saved(rows.filter(sound).groupBy(*grid.xs).agg(F.count("*").alias("n"), F.min("key").alias("least")).select("*", *(c.alias(n) for c, n in zip(grid.cells(), grid.cs))), "points")
        cells = saved(points.groupBy(*grid.cs).agg(F.sum("n").alias("size"), F.count("*").alias("points")).withColumn("cell", F.monotonically_increasing_id()).withColumn("pieces", F.ceil(F.col("points") / PIECE)), "cells")
        all_points, most = _sizes(cells, "points")
        piece = F.pmod(F.xxhash64(*grid.xs), F.col("pieces")).alias("piece")
        placed = saved(join_groups(points, cells, grid.cs, "points", all_points, most).select(*grid.xs, "n", "least", *grid.cs, "cell", "size", piece), "points")
        loose = placed.filter(F.col("size") < least).select(*grid.xs, *grid.cs)
        near = grid.met(loose, placed.select(*grid.xs, "n", *grid.cs, "piece"), cells).groupBy("p").agg(F.sum("q.n").alias("near")).filter(F.col("near") >= least)
        dense = saved(near.select(*(F.col(f"p.{x}").alias(x) for x in grid.xs)), "cores")
        crowded, rest = placed.filter(F.col("size") >= least), placed.filter(F.col("size") < least)
        cores = saved(crowded.unionAll(rest.join(dense, grid.xs, "left_semi")), "cores")
        links = saved(_linked(grid, cores.select("cell", *grid.xs), cells.select("cell", *grid.cs)), "links")
        roots = components(links)
        own = cores.groupBy("cell").agg(F.min("least").alias("least"))
        rooted = saved(own.join(roots.select(F.col("node").alias("cell"), "root"), "cell", "left").select("cell", "least", F.coalesce("root", "cell").alias("root")), "roots")
        named = saved(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("cluster")), "root").select("cell", "cluster"), "clusters")
        core_counts = cores.groupBy("cell").agg(F.count("*").alias("points"))
        clustered = saved(join_groups(cores, named.join(core_counts, "cell"), ["cell"], "points", *_sizes(core_counts, "points")).select(*grid.xs, *grid.cs, "piece", "cluster"), "clustered")
        edges = rest.join(dense, grid.xs, "left_anti").select(*grid.xs, *grid.cs)
        border = grid.met(edges, clustered, cells).groupBy("p").agg(F.min("q.cluster").alias("cluster")).select(*(F.col(f"p.{x}").alias(x) for x in grid.xs), "cluster", F.lit(False).alias("core"))
        found = clustered.select(*grid.xs, "cluster", F.lit(True).alias("core")).unionByName(border)
        labels = saved(points.select(*grid.xs, F.col("n").alias("weight")).join(found, grid.xs, "left"), "labels")
        keep(labels)
        total, most = _sizes(labels, "weight")
    out = join_groups(rows.filter(sound), labels, grid.xs, "weight", total, most).select("key", "cluster", F.coalesce("core", F.lit(False)).alias("core"))
    kind = df.schema[key].dataType
    return out.unionAll(rows.filter(~sound).select("key", F.lit(None).cast(kind), F.lit(False))).withColumnRenamed("key", key)

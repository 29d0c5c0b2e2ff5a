"""Graphs as edge tables: connected components, and forests of least weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, saved


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _star(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges as a saved table, and what tells it from others: its size and the sums of two hashes over its rows."""
    table = saved(edges, "edges")
    sums = (F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38,0)")) for i in (1, 2))
    return table, tuple(table.agg(F.count("*"), *sums).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the least node of its component.

    Alternates large and small stars. Each round is two grouped minima joined back to the edges, so a node with many edges is summed
    up before the shuffle and split by the join. Rounds grow with the logarithm of the diameter.
    """
    now, known = _star(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while known[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least(large)
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        new, seen = _star(small)
        discard(now)
        same, now, known = seen == known, new, seen
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

"""Vectors: class prototypes, exact nearest neighbours of a query set, fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import by_cosine


def prototypes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label. Elements are averaged by position, with partial sums before the shuffle."""
    rows = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return rows.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("prototype"))


def nearest(queries: DataFrame, table: DataFrame, key: str, vector: str, k: int, least: float = -1.0, same: str | None = None) -> DataFrame:
    """(q, found, score): the k rows of ``table`` most similar to each query by cosine, itself excluded; with
    ``same``, of those that have the query's value in that column. Exact; see ``neighbours.by_cosine``."""
    return by_cosine(queries, table, key, vector, k, least, same).table


def rank_fusion(key: str, *rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, place)."""
    rows = reduce(DataFrame.unionAll, (r.select(key, (F.lit(1.0) / (F.lit(k) + F.col("place"))).alias("s")) for r in rankings))
    return rows.groupBy(key).agg(F.sum("s").alias("score"))

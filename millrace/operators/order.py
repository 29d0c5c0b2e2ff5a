"""Positions in a global order, without putting all rows into one task."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hashed
from ..sources.scratch import passing, saved

#: Bits that number the rows of a partition in Spark's increasing ids.
ROW_BITS = 33


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Each row's place, from 1, in the order given, which must be total for the result to be the same each time.

    The table is sorted by ranges and written once; the rows of each range are counted, and a range's
    places begin after those of the ranges before it. Only those counts meet in one task.
    """
    ranged = saved(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", ROW_BITS)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return ranged.withColumn("__part", part).join(F.broadcast(starts), "__part").select(*df.columns, place.alias(name))


def positional_split(df: DataFrame, order: list, last: int) -> tuple[DataFrame, DataFrame]:
    """All rows but the last ones of an order, and those."""
    rows = numbered(df, order, "__place")
    cut = rows.count() - last
    return rows.filter(F.col("__place") <= cut).drop("__place"), rows.filter(F.col("__place") > cut).drop("__place")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float, seed: int = 42) -> DataFrame:
    """``sampled``: whether a row is in the sample, which has floor(share * size) rows of every stratum, by the hash of the key.

    A null stratum is one of its own. Ties of the hash go by key.
    """
    rows = numbered(df.withColumn("__hash", hashed(key, seed)), [stratum, "__hash", key], "__place")
    sizes = rows.groupBy(stratum).agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    met = rows.alias("a").join(sizes.select(F.col(stratum).alias("__s"), "__first", "__n"), F.col(stratum).eqNullSafe(F.col("__s")))
    return met.withColumn("sampled", F.col("__place") - F.col("__first") < F.floor(F.lit(share) * F.col("__n"))).select(*df.columns, "sampled")


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds of which each has the same share of every stratum: the rows of a stratum are dealt out in the order of their hash."""
    rows = numbered(df.withColumn("__hash", hashed(key, seed)), [stratum, "__hash", key], "__place")
    sizes = rows.groupBy(stratum).agg(F.min("__place").alias("__first")).select(F.col(stratum).alias("__s"), "__first")
    met = rows.join(sizes, F.col(stratum).eqNullSafe(F.col("__s")))
    return met.withColumn(name, F.pmod(F.col("__place") - F.col("__first"), F.lit(k)).cast("int")).select(*df.columns, name)


def negative_pairs(df: DataFrame, key: str, label: str, each: int, seed: int = 42) -> DataFrame:
    """(a, b): rows of different labels, found among the ``each`` next ones in the order of the keys' hash."""
    rows = numbered(df.select(key, label, hashed(key, seed).alias("__hash")), ["__hash", key], "place").select(key, label, "place")
    ahead = rows.select(F.col(key).alias("a"), F.col(label).alias("__label"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + each)).alias("place"))
    return ahead.join(rows, "place").filter(F.col("__label") != F.col(label)).select("a", F.col(key).alias("b"))


def tied_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, rank): each distinct value with its number of rows and their average rank over the whole table."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counts_before(counts, [value], "n").select(value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def counts_before(df: DataFrame, order: list, n: str, name: str = "before") -> DataFrame:
    """The sum of ``n`` over all rows before each one in a global order; as in ``numbered``, only sums of ranges meet in one task."""
    ranged = saved(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", ROW_BITS)
    sums = ranged.groupBy(part.alias("__part")).agg(F.sum(n).alias("__n"))
    earlier = lambda w: F.coalesce(F.sum(w[0]).over(w[1].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("__part", earlier(("__n", Window.orderBy("__part"))).alias("__before"))
    rows = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    inside = earlier((n, Window.partitionBy("__part").orderBy("__at")))
    return rows.select(*df.columns, (F.col("__before") + inside).alias(name))


def quantiles(df: DataFrame, c: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, on the line between the two values about a place; null values don't count, and of nothing all are None.

    Values are counted and the counts ranked by ranges, so no task holds all different values, as it does with ``percentile``.
    """
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n"))
    with passing():
        ranked = saved(counts_before(counts, ["v"], "n"), "ranked")
        total = ranked.agg(F.sum("n")).first()[0]
        if not total:
            return [None] * len(shares)
        places = [(total - 1) * s for s in shares]
        asked = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
        holds = lambda p: (F.col("before") <= p) & (F.col("before") + F.col("n") > p)
        rows = ranked.filter(reduce(operator.or_, map(holds, asked))).collect()
    at = {p: next(r.v for r in rows if r.before <= p < r.before + r.n) for p in asked}
    out = []
    for p in places:
        low, high = at[math.floor(p)], at[math.ceil(p)]
        out.append(low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return out


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve of a 0/1 label and a score, ties counting half, as a frame of one row; null without both labels."""
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    by_score = known.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    ranked = counts_before(by_score, [score], "n")
    total = ranked.agg(F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2)).alias("s"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return total.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))

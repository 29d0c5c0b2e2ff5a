"""Exact nearest neighbours by pivots: blocks of rows that the triangle inequality rules out are never compared.

Every row belongs to the cell of its nearest pivot, and the rows of a cell, in the order of their distance to
it, are cut into blocks. A query first meets one block near it. What it finds there bounds how far its
neighbours can be, and so which blocks can hold them: those whose distances to their pivot differ from the
query's own distance to that pivot by no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import passing, saved
from .order import numbered

#: Pivots at most, rows of a block, queries that meet a block at once, and blocks of a cell that a query may begin with.
PIVOTS, BLOCK, CHUNK, ENTRIES = 1_024, 4_096, 1_024, 256
#: Rows whose distances to all pivots, or scores with a whole block, a Python worker holds at once.
ROWS = 256
#: Cells in which a query looks for a block to begin with.
TRIED = 8
#: Rounding of distances that never rules out a block.
SLACK = 1e-9


@dataclass
class Index:
    """``rows``: kind, cell, no, dist, key, v and what else was carried; ``blocks``: kind, cell, no, low, high, n."""

    pivots: np.ndarray
    rows: DataFrame
    blocks: DataFrame
    total: int


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to all pivots; rows of another length than the pivots have are at no distance from any."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def _some(batches: Iterator[pd.Series], pivots: np.ndarray) -> Iterator[np.ndarray]:
    """Distances to all pivots, ``ROWS`` rows of the batches at a time; 0 for rows of another length."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            b = batch.iloc[at : at + ROWS]
            out = np.zeros((len(b), len(pivots)))
            own = [i for i, v in enumerate(b) if len(v) == pivots.shape[1]]
            if own and len(pivots):
                out[own] = _distances(np.stack([b.iloc[i] for i in own]), pivots)
            yield out


def _to_pivots(pivots: np.ndarray):
    """An array of distances to all pivots, as a function of a vector column."""

    @F.pandas_udf("array<double>")
    def distances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for d in _some(batches, pivots):
            yield pd.Series(list(d))

    return distances


def _to_nearest(pivots: np.ndarray):
    """The distance to the nearest pivot and its cell, counted from 1 (0 without pivots), as a function of a vector column."""

    @F.pandas_udf("dist double, cell long")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for d in _some(batches, pivots):
            cell = d.argmin(1) if len(pivots) else np.full(len(d), -1)
            yield pd.DataFrame({"dist": d[np.arange(len(d)), cell] if len(pivots) else np.zeros(len(d)), "cell": cell + 1})

    return nearest


def build(table: DataFrame, pivots: int | None = None, block: int = BLOCK) -> Index:
    """Index a table of key, kind and v (array of doubles without nulls) and what else it carries; rows only meet others of their kind and length.

    Pivots are the vectors of the commonest length with the least hashes: about the root of their number, ``PIVOTS`` at
    most, and one if a block holds all rows, unless it is stated. They pass the driver; rows do not.
    """
    size = F.size("v")
    sizes = table.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    total = table.count()
    many = pivots or (1 if total <= block else min(PIVOTS, round(sizes[0]["count"] ** 0.5)))
    rows = table.filter(size == sizes[0]["size"]).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(many).collect() if sizes else []
    points = np.array([r.v for r in rows], float).reshape(len(rows), -1 if rows else 1)
    at = table.withColumn("__d", _to_nearest(points)("v"))
    placed = at.withColumns({"dist": F.col("__d.dist"), "cell": F.col("__d.cell")}).drop("__d")
    ordered = numbered(placed, ["kind", size, "cell", "dist", "key"], "place")
    cut = saved(ordered.withColumn("no", F.floor((F.col("place") - 1) / block)).drop("place"), "indexed")
    blocks = saved(cut.groupBy("kind", "cell", "no", size.alias("size")).agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")), "blocks")
    return Index(points, cut, blocks, total)


def _at(c: str) -> Column:
    """The query's distance to the pivot of a block's cell; cells are counted from 1, and cell 0 has no pivot."""
    return F.coalesce(F.get("to", (F.col(c) - 1).cast("int")), F.lit(0.0))


def asked(queries: DataFrame, index: Index) -> DataFrame:
    """Queries (q, kind, v and more) with ``to``, their distances to all pivots."""
    return saved(queries.withColumn("to", _to_pivots(index.pivots)("v")), "queries")


def entries(queries: DataFrame, index: Index) -> DataFrame:
    """(q, kind, size, cell, no): the block that each query begins with, in its own cell if that has rows of its kind, else in one of the next cells.

    Of a cell with many blocks ``ENTRIES`` can be begun with; which one it is only decides how much is ruled out.
    """
    cell = Window.partitionBy("kind", "size", "cell")
    step = F.greatest(F.floor(F.count("*").over(cell) / ENTRIES), F.lit(1))
    thin = index.blocks.withColumns({"__i": F.row_number().over(cell.orderBy("no")) - 1, "__step": step}).filter(F.col("__i") % F.col("__step") == 0)
    cells = thin.groupBy("kind", "size", "cell").agg(F.sort_array(F.collect_list(F.struct("low", "no"))).alias("starts"))
    nearest = F.transform(F.sort_array(F.transform("to", lambda d, i: F.struct(d.alias("d"), (i + 1).cast("long").alias("c")))), lambda s: s["c"])
    tried = queries.select("q", "kind", F.size("v").alias("size"), "to", F.posexplode(F.concat(F.slice(nearest, 1, TRIED), F.array(F.lit(0).cast("long")))).alias("turn", "cell"))
    met = tried.join(cells, ["kind", "size", "cell"])
    before = F.filter("starts", lambda s: s["low"] <= _at("cell"))
    no = F.get("starts", F.greatest(F.size(before) - 1, F.lit(0)))["no"]
    first = met.groupBy("q", "kind", "size").agg(F.min_by(F.struct("cell", no.alias("no")), "turn").alias("at"))
    return first.select("q", "kind", "size", "at.*")


def reached(queries: DataFrame, index: Index, reach: DataFrame) -> DataFrame:
    """(q, kind, size, cell, no): all blocks that can hold a row within ``reach`` (q, within) of a query; a null bound rules out nothing."""
    bounds = index.blocks.groupBy("kind", "size", "cell").agg(F.min("low").alias("l"), F.max("high").alias("h"))
    rows = queries.select("q", "kind", F.size("v").alias("size"), "to").join(reach, "q")
    gap = lambda low, high: F.greatest(F.col(low) - F.col("d"), F.col("d") - F.col(high))
    near = lambda low, high: F.col("within").isNull() | (gap(low, high) <= F.col("within") + SLACK)
    cells = rows.select("q", "kind", "size", "within", F.posexplode(F.concat(F.array(F.lit(0.0)), "to")).alias("cell", "d")).withColumn("cell", F.col("cell").cast("long"))
    met = cells.join(bounds, ["kind", "size", "cell"]).filter(near("l", "h")).select("q", "kind", "size", "within", "cell", "d")
    return met.join(index.blocks, ["kind", "size", "cell"]).filter(near("low", "high")).select("q", "kind", "size", "cell", "no")


def compared(queries: DataFrame, pairs: DataFrame, index: Index, best: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, carried: list[str]) -> DataFrame:
    """``best(queries, rows)`` for every block and the queries that ``pairs`` (q, kind, size, cell, no; a saved table) sends it.

    ``carried`` are the columns of queries, besides q and v, that it needs; either frame may be empty. About ``CHUNK`` queries
    come at a time, so a task holds one block and as many queries.
    """
    at = ["kind", "size", "cell", "no"]
    counts = pairs.groupBy(*at).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("q"), F.col("chunks")).alias("chunk")
    sent = pairs.join(counts, at).select("q", *at, chunk).join(queries.select("q", "v", *carried), "q")
    rows = index.rows.withColumn("size", F.size("v")).join(counts, at)
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    return sent.groupBy(*at, "chunk").cogroup(dealt.groupBy(*at, "chunk")).applyInPandas(best, schema)


class Found(NamedTuple):
    """The neighbours, and for each query how many rows it was compared with (q, compared), of ``total``."""

    table: DataFrame
    work: DataFrame
    total: int


def _unit(df: DataFrame, key: str, vector: str, same: str | None, name: str) -> DataFrame:
    """(name, kind, v): vectors of length 1; those that have no direction, and null kinds, are in no pair."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    kind = F.col(same).cast("string") if same else F.lit("")
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias(name), kind.alias("kind"), v.alias("v")).filter(F.col("kind").isNotNull())
    return rows.withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf"))).select(name, "kind", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def by_cosine(queries: DataFrame, table: DataFrame, key: str, vector: str, k: int, least: float = -1.0, same: str | None = None, digits: int = 6, pivots: int | None = None, block: int = BLOCK) -> Found:
    """(q, found, score): the k rows of ``table`` most similar to each query, itself excluded, by cosine to ``digits`` digits; ties go by key.

    With ``same``, of those that have the query's value in that column; a null there, and a vector that is null, zero or
    holds null, NaN or infinity, has no neighbours and is none. Scores under ``least`` are left out.

    On vectors of length 1 the order by cosine is that by distance, so blocks are ruled out as the module says.
    """
    with passing() as keep:
        return _by_cosine(_unit(queries, key, vector, same, "name"), _unit(table, key, vector, same, "key"), table.schema[key].dataType.simpleString(), k, float(least), digits, pivots, block, keep)


def _by_cosine(queries: DataFrame, table: DataFrame, kind: str, k: int, least: float, digits: int, pivots: int | None, block: int, keep: Callable[..., None]) -> Found:
    index = build(table, pivots, block)
    q = asked(queries.distinct().withColumn("q", F.monotonically_increasing_id()), index)
    ten = 10.0**digits

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            keys = b["key"].to_numpy(object)
            rank = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
            block = np.stack(b["v"].to_numpy()).T
            for i, (number, name) in enumerate(zip(a["q"], a["name"])):
                if i % ROWS == 0:
                    exact = np.stack(a["v"].iloc[i : i + ROWS].to_numpy()) @ block
                    scores = np.sign(exact) * np.floor(np.abs(exact) * ten + 0.5) / ten
                score = scores[i % ROWS]
                own = np.where((keys == name) | (score < least), -np.inf, score)
                at = np.flatnonzero(own >= (np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf))
                at = at[np.lexsort((rank[at], -own[at]))][:k]
                out += [(number, keys[j], own[j]) for j in at if own[j] > -np.inf]
        return pd.DataFrame(out, columns=["q", "found", "score"])

    run = lambda pairs: saved(compared(q, pairs, index, best, f"q long, found {kind}, score double", ["name"]), "neighbours")
    first = saved(entries(q, index), "pairs")
    begun = run(first)
    if index.blocks.limit(2).count() < 2:
        keep(q, begun, first, index.blocks)
        return _named(q, begun, first, index, k, digits)
    worst = begun.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
    # Rows that round to the same score as the last one found are within reach, too.
    bound = F.sqrt(2 - 2 * F.greatest(F.coalesce("worst", F.lit(-1.0)), F.lit(least)) + 2 / ten)
    reach = q.select("q").join(worst, "q", "left").select("q", bound.alias("within"))
    rest = saved(reached(q, index, reach).join(first, ["q", "kind", "size", "cell", "no"], "left_anti"), "pairs")
    more = run(rest)
    keep(q, begun, more, first, rest, index.blocks)
    return _named(q, begun.unionAll(more), first.unionAll(rest), index, k, digits)


def _named(q: DataFrame, met: DataFrame, pairs: DataFrame, index: Index, k: int, digits: int) -> Found:
    """The k best of all that blocks have found, under the queries' own keys."""
    order = Window.partitionBy("name").orderBy(F.desc("score"), "found")
    named = met.join(q.select("q", "name"), "q").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    work = pairs.join(index.blocks.drop("low", "high"), ["kind", "size", "cell", "no"]).join(q.select("q", "name"), "q").groupBy(F.col("name").alias("q")).agg(F.sum("n").alias("compared"))
    return Found(named.select(F.col("name").alias("q"), "found", F.round("score", digits).alias("score")), work, index.total)

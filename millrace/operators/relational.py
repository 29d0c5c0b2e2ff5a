"""Filters, joins, set operations, top rows and reshaping."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast.
BROADCAST_ROWS = 500_000
#: Labels up to which every text is searched for every label.
FEW_LABELS = 256
#: Labels up to which all of them are sent to all tasks.
KNOWN_LABELS = 50_000
#: A group counts as heavy with more than one of so many rows, so that there are fewer heavy groups than that.
HEAVY = 1_000

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _sized(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast hint only for a table of a stated, small number of rows; Spark decides on all others."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def remove_rows(df: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Drop the rows for which all of (column, comparison, value) hold; a null holds for none."""
    holds = reduce(operator.and_, (F.coalesce(COMPARE[op](F.col(c), F.lit(v)), F.lit(False)) for c, op, v in conditions))
    return df.filter(~holds)


def in_range(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Keep rows inside every closed range; an open bound is None."""
    for c, (low, high) in ranges.items():
        df = df if low is None else df.filter(F.col(c) >= low)
        df = df if high is None else df.filter(F.col(c) <= high)
    return df


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", null_keys_match: bool = False, right_rows: int | None = None) -> DataFrame:
    """Equi-join on columns of equal names; ``null_keys_match`` lets null keys meet."""
    right = _sized(right, right_rows)
    if not null_keys_match:
        return left.join(right, on, how)
    b = right.select(*(F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns))
    out = left.join(b, reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on)), how)
    if how in ("right", "outer", "full"):
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in on})
    return out.drop(*(f"__{c}" for c in on))


def enrich(fact: DataFrame, *dims: tuple[DataFrame, list[str]]) -> DataFrame:
    """A chain of left joins."""
    return reduce(lambda df, d: df.join(d[0], d[1], "left"), dims, fact)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, uses: dict[str, str], default=None) -> DataFrame:
    """Look ``value`` up once for each column of ``uses`` (column -> new column), with a default."""
    for c, new in uses.items():
        t = table.select(F.col(key).alias(f"__{c}"), F.col(value).alias(new))
        df = df.join(t, F.col(c) == F.col(f"__{c}"), "left").drop(f"__{c}")
        df = df if default is None else df.withColumn(new, F.coalesce(new, F.lit(default)))
    return df


def join_back(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Group aggregates on every row of the group: grouped before the shuffle, then joined, so hot groups stay split."""
    return df.join(df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggs.items())), keys, "left")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, largest: int) -> DataFrame:
    """The inner join of ``rows`` and one row for each group of them, of which ``size`` says how many rows it has.

    Groups of more than a ``HEAVY``-th of all ``total`` rows, of which there are fewer than ``HEAVY``, are
    broadcast, so that no task gets such a group whole; the others are shuffled. ``largest`` is the size of
    the largest group.
    """
    least = max(1, total // HEAVY)
    if largest <= least:
        return rows.join(groups, keys)
    heavy = groups.filter(F.col(size) > least)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(groups.filter(F.col(size) <= least), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)


def semi_top(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n most frequent values of ``key``; ties go by value."""
    top = df.groupBy(key).count().orderBy(F.desc("count"), key).limit(n).select(key)
    return df.join(_sized(top, n), key, "left_semi")


def not_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def _heads(text: str, size: int, weights: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of the ``size`` characters from each place on."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = np.zeros(max(0, len(x) - size + 1), np.uint64)
    for i in range(size if len(out) else 0):
        out += x[i : i + len(out)] * weights[i]
    return out ^ (out >> np.uint64(29))


def _mentioned(known: list[str], size: int):
    """The labels that stand in a text, as a function of a text column; each label has ``size`` characters or more."""
    weights = np.random.default_rng(13).integers(1, 1 << 62, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    by_head: dict[int, list[str]] = {}
    for label in known:
        by_head.setdefault(int(_heads(label[:size], size, weights)[0]), []).append(label)
    bits = np.uint64(len(known)).item().bit_length() + 6
    filled = np.zeros(1 << bits, bool)
    filled[(np.fromiter(by_head, np.uint64, len(by_head)) >> np.uint64(64 - bits)).astype(np.int64)] = True

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                heads = _heads(text or "", size, weights)
                met = np.unique(heads[filled[(heads >> np.uint64(64 - bits)).astype(np.int64)]]).tolist()
                out.append([label for h in met for label in by_head.get(h, ()) if label in text])
            yield pd.Series(out, dtype=object)

    return found


def mentions(texts: DataFrame, text: str, labels: DataFrame, label: str, few: int = FEW_LABELS, known_rows: int = KNOWN_LABELS) -> DataFrame:
    """(texts' columns, label) where a text contains a label, at most once for each row and label.

    Up to ``few`` labels are tried on every text. Up to ``known_rows`` are sent to all tasks, which look up the first characters at each
    place of a text, as many as the shortest label has, and try the labels that begin so. More of them meet the texts in an equi-join
    on these first characters, and what meets is verified. Null and empty labels are in no text.
    """
    known = labels.filter(F.length(label) > 0).select(label).distinct()
    n, shortest = known.agg(F.count("*"), F.min(F.length(label))).first()
    if n <= few:
        return texts.join(F.broadcast(known), F.col(text).contains(F.col(label)), "inner")
    if n <= known_rows:
        found = _mentioned([r[0] for r in known.collect()], shortest)
        return texts.withColumn("__found", found(text)).select(*texts.columns, F.explode("__found").alias(label))
    piece = F.greatest(F.lit(192), F.lit(2 * shortest))
    keyed = texts.withColumn("__key", F.xxhash64(text))
    # Texts are cut into overlapping pieces before they are opened, so that no row carries a whole text.
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - shortest) / piece)), lambda i: F.substring(F.col(text), i.cast("int") * piece + 1, piece + shortest - 1))
    opened = keyed.filter(F.length(text) >= shortest).select("__key", F.explode(pieces).alias("__piece"))
    grams = F.transform(F.sequence(F.lit(1), F.length("__piece") - shortest + 1), lambda i: F.substring(F.col("__piece"), i, F.lit(shortest)))
    headed = known.withColumn("__gram", F.substring(label, 1, shortest))
    met = opened.select("__key", F.explode(grams).alias("__gram")).join(_sized(headed, n), "__gram").select("__key", label).distinct()
    return keyed.join(met, "__key").filter(F.col(text).contains(F.col(label))).drop("__key")


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    """The columns whose names begin with any of the prefixes, in the table's order."""
    return [c for c in df.columns if c.startswith(prefixes)]


def split_by_marker(df: DataFrame, marker: str, value) -> tuple[DataFrame, DataFrame]:
    """Rows of one marker and the others, a null marker among them; the marker goes."""
    own = F.col(marker).eqNullSafe(F.lit(value))
    return df.filter(own).drop(marker), df.filter(~own).drop(marker)


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without a null in the given columns."""
    return df.dropna(subset=cols)


def last_per_group(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group."""
    return top_per_group(df, keys, [F.desc(c) for c in order], n)


def union_common(*frames: DataFrame) -> DataFrame:
    """Union all over the columns that every frame has, in the first one's order."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, (f.select(*names) for f in frames))


def union_all(*frames: DataFrame, marker: str | None = None) -> DataFrame:
    """Union all by name, gaps null; ``marker`` numbers the frames so that they can be split again."""
    if marker:
        frames = tuple(f.withColumn(marker, F.lit(i)) for i, f in enumerate(frames))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def pivot(df: DataFrame, ids: list[str], name: str, values: list, agg: Column) -> DataFrame:
    """Long to wide with stated values, so that the schema doesn't depend on the data."""
    return df.groupBy(*ids).pivot(name, values).agg(agg)


def one_hot(df: DataFrame, c: str, values: list, drop_first: bool = False, null_dummy: bool = False) -> DataFrame:
    chosen = sorted(values)[1 if drop_first else 0 :]
    df = df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in chosen})
    return df.withColumn(f"{c}_null", F.col(c).isNull().cast("int")) if null_dummy else df


def split_column(df: DataFrame, c: str, sep: str, names: list[str]) -> DataFrame:
    parts = F.split(c, sep)
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})

"""Ordered windows of series: lags, rolling and expanding statistics, smoothing and filling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUNCTIONS = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "median": F.median, "count": F.count}


def _over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def lags(df: DataFrame, value: str, keys: list[str], order: list[str], steps: list[int]) -> DataFrame:
    """Values k rows back, or ahead for negative k."""
    w = _over(keys, order)
    return df.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w) for k in steps})


def rolling(df: DataFrame, value: str, keys: list[str], order: list[str], windows: list[int], functions: list[str], shift: int = 1) -> DataFrame:
    """Statistics of the w rows that end ``shift`` rows before the current one. All windows share one sort."""
    base = _over(keys, order)
    return df.withColumns({f"{value}_roll_{f}_{w}": FUNCTIONS[f](value).over(base.rowsBetween(-(w + shift - 1), -shift)) for w in windows for f in functions})


def centred(df: DataFrame, value: str, keys: list[str], order: list[str], w: int, function: str = "mean") -> DataFrame:
    """Statistic of w rows about the current one, null where there are fewer."""
    frame = _over(keys, order).rowsBetween(-(w // 2), w - 1 - w // 2)
    return df.withColumn(f"{value}_centred_{w}", F.when(F.count(value).over(frame) == w, FUNCTIONS[function](value).over(frame)))


def expanding(df: DataFrame, value: str, keys: list[str], order: list[str], functions: list[str]) -> DataFrame:
    """Statistics of all earlier rows."""
    frame = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{value}_exp_{f}": FUNCTIONS[f](value).over(frame) for f in functions})


def _recurrence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y[i] = a[i] * y[i-1] + b[i], all at once: steps are composed over distances 1, 2, 4, ..."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] *= a[:-step].copy()
        step *= 2
    return b


def ewm(df: DataFrame, value: str, keys: list[str], order: list[str], span: float, shift: int = 1) -> DataFrame:
    """Exponentially weighted mean of the values up to ``shift`` rows back (not adjusted); weights decay over gaps, too.

    Series are passed over once, in order, a batch at a time, each batch as one linear recurrence in
    numpy; memory doesn't grow with a series. Null and NaN are gaps, which leave the mean as it was.
    """
    alpha, name = 2.0 / (span + 1), f"{value}_ewm"
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, mean, since = None, np.nan, 0  # of the series that the batch before ended in
        tail, tail_series = np.full(shift, np.nan), np.full(shift, -1)
        series = 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            new = np.zeros(n, bool)
            for i, k in enumerate(keys):
                c = batch[k].to_numpy(object)
                before = np.concatenate([[last_key[i] if last_key else None], c[:-1]])
                new |= (c != before) & ~(pd.isna(c) & pd.isna(before))
            new[0] |= last_key is None
            number = series + np.cumsum(new)
            x = batch[value].to_numpy(float, na_value=np.nan)
            seen = np.flatnonzero(~np.isnan(x))
            filled = np.full(n, np.nan)
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: in the series carried over
            if len(seen):
                prior = np.concatenate([[-1], seen[:-1]])
                first = prior < begin[seen]
                carried = (begin[seen] < 0) & (prior < 0)
                gap = np.where(carried, since + seen + 1, seen - prior)
                w = (1 - alpha) ** np.maximum(gap, 1)
                a, b = w / (w + alpha), alpha * x[seen] / (w + alpha)
                start = first | (carried & np.isnan(mean))
                a[start], b[start] = 0.0, x[seen][start]
                if carried[0] and not start[0]:
                    b[0] += a[0] * mean
                y = _recurrence(a, b)
                at = np.searchsorted(seen, np.arange(n), "right") - 1
                held = (at >= 0) & (seen[np.maximum(at, 0)] >= np.maximum(begin, 0))
                filled[held] = y[at[held]]
            else:
                held = np.zeros(n, bool)
            filled[~held & (begin < 0)] = mean
            values, owners = np.concatenate([tail, filled]), np.concatenate([tail_series, number])
            out = np.where(owners[:n] == number, values[:n], np.nan)
            yield batch.assign(**{name: pd.Series(out, index=batch.index).astype(object).where(~np.isnan(out), None)})
            if len(seen) and seen[-1] >= max(begin[-1], 0):
                since = n - 1 - seen[-1]
            else:
                since = since + n if begin[-1] < 0 else n - 1 - begin[-1]
            mean, series, last_key = filled[-1], number[-1], tuple(batch[k].iloc[-1] for k in keys)
            tail, tail_series = values[len(values) - shift :], owners[len(owners) - shift :]

    return ordered.mapInPandas(run, schema)


def interpolate(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Fill gaps on the line between neighbours, the ends with the nearest value.

    The next value is the last one of the reverse order, so that either way each row is looked at once.
    """
    w = _over(keys, order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("__i").alias("i")))
    df = df.withColumn("__i", F.row_number().over(w))
    so_far = lambda by: F.last(known, True).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__p", so_far(F.col("__i"))).withColumn("__n", so_far(F.desc("__i")))
    p, n = F.col("__p"), F.col("__n")
    line = p["v"] + (n["v"] - p["v"]) * F.try_divide(F.col("__i") - p["i"], n["i"] - p["i"])
    return df.withColumn(f"{value}_filled", F.coalesce(value, line, p["v"], n["v"])).drop("__i", "__p", "__n")


def interpolate_days(df: DataFrame, value: str, keys: list[str], day: str) -> DataFrame:
    """(keys, day, value, value_filled): ``interpolate`` over every day from a series' first to its last, of a table with a row for each key and day.

    Every known row makes the days up to the next one itself, so that only given rows are shuffled and sorted, not the days between.
    """
    series = Window.partitionBy(*keys)
    w = series.orderBy(day)
    ends = {"__lo": F.min(day).over(series), "__hi": F.max(day).over(series), "__known": F.count(value).over(series), "__i": F.row_number().over(w)}
    rows = df.filter(F.col(day).isNotNull()).select(*keys, F.col(day).alias("__at"), F.col(value).alias("__v"), day, value).withColumns(ends)
    # A series without any value keeps its first row, which then makes all its days.
    kept = rows.filter(F.col(value).isNotNull() | ((F.col("__known") == 0) & (F.col("__i") == 1)))
    kept = kept.withColumns({"__next": F.lead("__at").over(w), "__to": F.lead("__v").over(w), "__i": F.row_number().over(w)})
    begin = F.when(F.col("__i") == 1, F.col("__lo")).otherwise(F.col("__at"))
    end = F.coalesce(F.date_sub("__next", 1), F.col("__hi"))
    made = kept.select(*keys, "__at", "__v", "__next", "__to", F.explode(F.sequence(begin, end, F.expr("interval 1 day"))).alias(day))
    given = F.col(day) == F.col("__at")
    line = F.col("__v") + (F.col("__to") - F.col("__v")) * F.try_divide(F.datediff(day, "__at"), F.datediff("__next", "__at"))
    filled = F.when((F.col(day) <= F.col("__at")) | F.col("__next").isNull(), F.col("__v")).otherwise(line)
    return made.select(*keys, day, F.when(given, F.col("__v")).alias(value), filled.alias(f"{value}_filled"))


def spine(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Every day from each group's first to its last."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return ends.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(day))


def cumulative(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums over earlier rows, 0 at the first."""
    frame = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({n: F.coalesce(F.sum(c).over(frame), F.lit(0)) for n, c in sums.items()})


def group_share(df: DataFrame, value: str, whole: list[str], part: list[str], name: str = "share") -> DataFrame:
    """Share of each part's total in its whole's total."""
    totals = df.groupBy(*whole, *part).agg(F.sum(value).alias("part_total"))
    return totals.withColumn(name, F.try_divide(F.col("part_total"), F.sum("part_total").over(Window.partitionBy(*whole))))

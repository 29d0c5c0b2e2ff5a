"""Recursive forecasts by fitted models: a model as a column expression, folded over the horizon."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import train


def _node(node, x: list[Column]) -> Column:
    """A tree of a fitted model, from this node on."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    if not hasattr(split, "threshold") or split.getClass().getSimpleName() != "ContinuousSplit":
        raise ValueError("only splits at thresholds can be made an expression")
    return F.when(x[split.featureIndex()] <= F.lit(float(split.threshold())), _node(node.leftChild(), x)).otherwise(_node(node.rightChild(), x))


def compiled(model) -> Callable[[list[Column]], Column]:
    """The prediction of a fitted pipeline of ``models.train`` as an expression of its features: linear regressions, and trees, forests and boosted trees for regression."""
    last = model.stages[-1]
    kind = type(last).__name__
    if kind == "LinearRegressionModel":
        weights, start = [float(w) for w in last.coefficients], float(last.intercept)
        return lambda x: reduce(lambda s, wx: s + F.lit(wx[0]) * wx[1], zip(weights, x), F.lit(start))
    if kind == "DecisionTreeRegressionModel":
        return lambda x: _node(last._java_obj.rootNode(), x)
    if kind in ("RandomForestRegressionModel", "GBTRegressionModel"):
        # A forest is the mean of its trees, boosted trees are their weighted sum.
        shares = [float(w) for w in last.treeWeights] if kind.startswith("GBT") else [1.0 / len(last.trees)] * len(last.trees)
        roots = [t._java_obj.rootNode() for t in last.trees]
        return lambda x: reduce(lambda s, wr: s + F.lit(wr[0]) * _node(wr[1], x), zip(shares, roots), F.lit(0.0))
    raise ValueError(f"{kind} can't be made an expression")


def lag_table(history: DataFrame, key: str, step: str, value: str, lags: int, season: int | None = None) -> DataFrame:
    """key, step, value, lag_1 (the latest) ... and, with ``season``, season: the step's place in it. Only rows with all lags; null values are left out first."""
    w = Window.partitionBy(key).orderBy(step)
    known = history.filter(F.col(value).isNotNull()).select(key, step, F.col(value).cast("double").alias(value))
    df = known.withColumns({f"lag_{i}": F.lag(value, i).over(w) for i in range(1, lags + 1)}).filter(F.col(f"lag_{lags}").isNotNull())
    return df.withColumn("season", F.pmod(F.col(step), F.lit(season)).cast("double")) if season else df


def features(lags: int, season: int | None = None) -> list[str]:
    return [f"lag_{i}" for i in range(1, lags + 1)] + (["season"] if season else [])


def fit_recursive(history: DataFrame, key: str, step: str, value: str, lags: int, kind: str = "boosted_regressor", season: int | None = None, **params):
    """A model of ``models.train`` that gives a value from the ``lags`` before it and its place in the season; one for all series."""
    return train(lag_table(history, key, step, value, lags, season), features(lags, season), value, kind, **params)


def forecast_recursively(model, history: DataFrame, key: str, step: str, value: str, lags: int, horizon: int, season: int | None = None) -> DataFrame:
    """(key, step, value) of ``horizon`` further steps of every series, each predicted from the ones before it, forecasts among them.

    The fitted model becomes an expression, which is folded over the horizon inside each row: no step is a job, a
    join or a new table. Only a series' last ``lags`` values are carried; long series are cut into parts first, and each part keeps its
    last values. Series with fewer values give none.
    """
    predict = compiled(model)
    newest = lambda rows: F.slice(F.reverse(F.sort_array(rows)), 1, lags)
    point = F.struct(F.col(step).cast("long").alias("t"), F.col(value).cast("double").alias("v"))
    points = history.filter(F.col(value).isNotNull()).select(key, F.floor(F.col(step) / (64 * lags)).alias("__part"), point.alias("__p"))
    parts = points.groupBy(key, "__part").agg(newest(F.collect_list("__p")).alias("v"))
    last = parts.groupBy(key).agg(newest(F.flatten(F.collect_list("v"))).alias("v")).filter(F.size("v") == lags)
    start = F.struct(F.transform("v", lambda p: p["v"]).alias("lags"), F.array().cast("array<double>").alias("out"))
    begin = F.get("v", F.lit(0))["t"]

    def ahead(s: Column, i: Column) -> Column:
        x = [F.get(s["lags"], F.lit(j)) for j in range(lags)]
        new = predict(x + ([F.pmod(begin + i, F.lit(season)).cast("double")] if season else []))
        return F.struct(F.slice(F.concat(F.array(new), s["lags"]), 1, lags).alias("lags"), F.concat(s["out"], F.array(new)).alias("out"))

    made = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, ahead, lambda s: s["out"])
    return last.select(key, begin.alias("__t"), F.posexplode(made).alias("__i", value)).select(key, (F.col("__t") + F.col("__i") + 1).alias(step), value)

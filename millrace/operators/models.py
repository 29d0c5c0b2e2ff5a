"""Thin MLlib layer: named estimators, out-of-fold predictions, and blends of predictions by key."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as G
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .order import counts_before

ESTIMATORS = {
    "logistic": lambda **p: C.LogisticRegression(**p),
    "forest": lambda **p: C.RandomForestClassifier(**({"seed": 42} | p)),
    "boosted": lambda **p: C.GBTClassifier(**({"seed": 42} | p)),
    "bayes": lambda **p: C.NaiveBayes(**({"modelType": "gaussian"} | p)),
    "support_vectors": lambda **p: C.LinearSVC(**p),
    "tree": lambda **p: C.DecisionTreeClassifier(**({"seed": 42} | p)),
    "perceptron": lambda **p: C.MultilayerPerceptronClassifier(**({"seed": 42} | p)),
    "linear": lambda **p: G.LinearRegression(**p),
    "ridge": lambda **p: G.LinearRegression(**({"regParam": 1.0, "elasticNetParam": 0.0} | p)),
    "lasso": lambda **p: G.LinearRegression(**({"regParam": 1.0, "elasticNetParam": 1.0} | p)),
    "forest_regressor": lambda **p: G.RandomForestRegressor(**({"seed": 42} | p)),
    "boosted_regressor": lambda **p: G.GBTRegressor(**({"seed": 42} | p)),
}
#: Clusters whose means are broadcast at most: 8 MB for each 100 components.
MOST_CLUSTERS = 10_000
CLUSTERERS = {"kmeans": K.KMeans, "mixture": K.GaussianMixture, "bisecting": K.BisectingKMeans}


def train(df: DataFrame, features: list[str], label: str, kind: str, **params):
    """A fitted pipeline; rows with a null feature or label are left out."""
    steps = [VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip"), ESTIMATORS[kind](**params).setFeaturesCol("__x").setLabelCol(label)]
    return Pipeline(stages=steps).fit(df.filter(F.col(label).isNotNull()))


def predict(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, prediction and, of a classifier, the probability of the last class; both null where a feature is null."""
    out = model.transform(df)
    more = [F.element_at(vector_to_array("probability"), -1).alias("probability")] if "probability" in out.columns else []
    return with_incomplete(out.select(*keep, F.col("prediction"), *more), df, model.stages[0].getInputCols(), keep)


def with_incomplete(out: DataFrame, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``out`` and the rows of ``df`` that the assembler skipped: those with a null or NaN feature."""
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in features))
    return out.unionByName(df.filter(missing).select(*keep), allowMissingColumns=True)


def out_of_fold(df: DataFrame, features: list[str], label: str, kind: str, fold: str, folds: int, keep: list[str], **params) -> DataFrame:
    """Each row predicted by a model that has not seen its fold.

    Rows are written once: a union of branches that each join or group anew keeps all their sorts in one task.
    """
    df = saved(df, "rows")
    parts = [predict(train(df.filter(F.col(fold) != k), features, label, kind, **params), df.filter(F.col(fold) == k), keep) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def cluster(df: DataFrame, features: list[str], kind: str, k: int, keep: list[str], seed: int = 42) -> DataFrame:
    """Clusters of standardised features; null where a feature is null. Rows are written once, as in ``out_of_fold``."""
    df = saved(df, "rows")
    steps = [VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), CLUSTERERS[kind](k=k, seed=seed, featuresCol="__x")]
    out = Pipeline(stages=steps).fit(df).transform(df).select(*keep, F.col("prediction").alias("cluster"))
    return with_incomplete(out, df, features, keep)


def cluster_scores(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """silhouette (of squared distances), calinski_harabasz and davies_bouldin of clusters of array vectors, in one row.

    All three come from each cluster's size, mean and sum of squares, so no two rows have to meet:
    the mean squared distance of x to a cluster is |x|^2 - 2 x.mean + mean of its squares. A cluster of
    one row has the silhouette 0. Null where there are fewer than two clusters. The clusters' means
    are broadcast to all rows, each of which is held against every cluster, so more than ``MOST_CLUSTERS`` are an error.
    """
    rows = df.filter(F.col(cluster).isNotNull() & F.col(vector).isNotNull()).select(F.col(cluster).alias("c"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    sq = lambda v: F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a)
    if (many := rows.select("c").distinct().limit(MOST_CLUSTERS + 1).count()) > MOST_CLUSTERS:
        raise ValueError(f"there are over {MOST_CLUSTERS} clusters, {many} or more")
    per = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum(sq(F.col("x"))).alias("squares"))
    mean = rows.select("c", F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(F.avg("v").alias("m")).groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    stats = per.join(mean, "c")
    table = stats.agg(F.collect_list(F.struct("c", "n", "squares", "mean")).alias("all"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
    dist2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, y: s + y)
    met = rows.crossJoin(F.broadcast(table))
    far = lambda s: sq(F.col("x")) - 2 * dot(F.col("x"), s["mean"]) + s["squares"] / s["n"]
    own = F.filter("all", lambda s: s["c"] == F.col("c"))[0]
    inner = F.when(own["n"] > 1, far(own) * own["n"] / (own["n"] - 1))
    outer = F.array_min(F.transform(F.filter("all", lambda s: s["c"] != F.col("c")), far))
    value = F.when(own["n"] > 1, F.coalesce(F.try_divide(outer - inner, F.greatest(outer, inner)), F.lit(0.0))).otherwise(F.lit(0.0))
    spread = F.sqrt(dist2(F.col("x"), own["mean"]))
    scored = met.select("c", F.when(F.size("all") > 1, value).alias("s"), spread.alias("d"), dist2(F.col("x"), own["mean"]).alias("d2")).groupBy("c").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.avg("d").alias("d"), F.sum("d2").alias("within"))
    ends = scored.join(mean, "c").agg(F.collect_list(F.struct("c", "n", "s", "d", "within", "mean")).alias("all"))
    total = lambda f: F.aggregate(F.transform("all", f), F.lit(0.0), lambda a, y: a + y)
    n, k = total(lambda s: s["n"].cast("double")), F.size("all")
    centre = F.transform(F.get("all", F.lit(0))["mean"], lambda _, i: total(lambda s: s["n"] * F.get(s["mean"], i)) / n)
    between = total(lambda s: s["n"] * dist2(s["mean"], F.col("centre")))
    worst = lambda s: F.array_max(F.transform(F.filter("all", lambda t: t["c"] != s["c"]), lambda t: F.try_divide(s["d"] + t["d"], F.sqrt(dist2(s["mean"], t["mean"])))))
    enough = k > 1
    return ends.withColumn("centre", centre).select(
        F.when(enough, total(lambda s: s["s"]) / n).alias("silhouette"),
        F.when(enough, F.try_divide(between / (k - 1), total(lambda s: s["within"]) / (n - k))).alias("calinski_harabasz"),
        F.when(enough, total(lambda s: F.coalesce(worst(s), F.lit(0.0))) / k).alias("davies_bouldin"),
    )


def importance_order(df: DataFrame, features: list[str], label: str, keep: int) -> list[str]:
    """Recursive elimination: the feature of the least weight on a common scale goes, and the rest is fitted again, until ``keep`` are left."""
    left = list(features)
    spread = df.agg(*(F.stddev_samp(c).alias(c) for c in features)).first()
    while len(left) > keep:
        weights = train(df, left, label, "linear", solver="normal").stages[-1].coefficients
        left.remove(min(zip(left, weights), key=lambda x: abs(x[1]) * (spread[x[0]] or 0.0))[0])
    return left


def forecast(history: DataFrame, key: str, step: str, value: str, weights: list[float], intercept: float, horizon: int) -> DataFrame:
    """(key, step, value) of ``horizon`` further steps, each the weighted sum of the last ones, forecasts among them.

    ``weights[0]`` belongs to the latest value. Only each series' last ``len(weights)`` values are
    carried, in an array, so that no step needs a join or a new table. Series with fewer values give none.
    """
    p = len(weights)
    newest = lambda rows: F.slice(F.reverse(F.sort_array(rows)), 1, p)
    points = history.filter(F.col(value).isNotNull()).select(key, F.floor(F.col(step) / (64 * p)).alias("__part"), F.struct(F.col(step).alias("t"), F.col(value).cast("double").alias("v")).alias("__p"))
    recent = points.groupBy(key, "__part").agg(newest(F.collect_list("__p")).alias("v"))  # long series by parts first
    joined = recent.groupBy(key).agg(newest(F.flatten(F.collect_list("v"))).alias("v")).filter(F.size("v") == p)
    start = F.struct(F.transform("v", lambda x: x["v"]).alias("lags"), F.array().cast("array<double>").alias("out"))
    w = F.array(*(F.lit(float(x)) for x in weights))

    def ahead(s, _):
        new = F.aggregate(F.zip_with(s["lags"], w, lambda a, b: a * b), F.lit(float(intercept)), lambda t, y: t + y)
        return F.struct(F.slice(F.concat(F.array(new), s["lags"]), 1, p).alias("lags"), F.concat(s["out"], F.array(new)).alias("out"))

    made = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, ahead, lambda s: s["out"])
    return joined.select(key, F.get("v", F.lit(0))["t"].alias("__t"), F.posexplode(made).alias("i", value)).select(key, (F.col("__t") + F.col("i") + 1).alias(step), value)


def blend(frames: list[DataFrame], key: str, value: str, how: str = "mean", weights: list[float] | None = None) -> DataFrame:
    """Predictions of several models by key: mean, geometric, rank (mean of percentile ranks) or vote (most frequent; ties: the smallest)."""
    weights = weights or [1.0] * len(frames)
    rows = reduce(DataFrame.unionAll, (f.select(key, F.col(value).alias("v"), F.lit(w).alias("w"), F.lit(i).alias("model")) for i, (f, w) in enumerate(zip(frames, weights))))
    if how == "vote":
        votes = rows.groupBy(key, "v").agg(F.sum("w").alias("n"))
        return votes.groupBy(key).agg(F.max_by("v", F.struct("n", (-F.col("v")).alias("s"))).alias(value))
    if how == "rank":
        counts = rows.groupBy("model", "v").agg(F.count("*").alias("n"))
        ranked = counts_before(counts, ["model", "v"], "n")
        whole = ranked.groupBy("model").agg(F.min("before").alias("first"), F.sum("n").alias("all"))
        share = F.coalesce(F.try_divide((F.col("before") - F.col("first")).cast("double"), F.col("all") - 1), F.lit(0.0))
        places = ranked.join(F.broadcast(whole), "model").select("model", F.col("v").alias("of"), share.alias("share"))
        rows = rows.alias("r").join(places.alias("p"), (F.col("r.model") == F.col("p.model")) & F.col("r.v").eqNullSafe(F.col("p.of"))).select(F.col(f"r.{key}").alias(key), F.col("p.share").alias("v"), "r.w")
    x = F.log("v") if how == "geometric" else F.col("v")
    mean = F.sum(x * F.col("w")) / F.sum("w")
    return rows.groupBy(key).agg((F.exp(mean) if how == "geometric" else mean).alias(value))


def threshold_labels(df: DataFrame, key: str, probability: str, at: float = 0.5) -> DataFrame:
    return df.select(key, (F.col(probability) >= at).cast("int").alias("label"))

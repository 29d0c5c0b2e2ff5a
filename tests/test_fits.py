"""Fits by sums of products and forecasts by compiled models, against plain numpy and the models themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import forecasting as G
from millrace.operators import gram as K
from millrace.operators import models as M


def frame(spark, x, names):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"id long, {', '.join(f'{n} double' for n in names)}").repartition(3)


def by_id(df, names):
    return np.array([[np.nan if r[n] is None else r[n] for n in names] for r in df.orderBy("id").collect()], float)


def test_whitened_columns_are_uncorrelated(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 4)) + [1e6, -5, 0, 3]
    mean, w = K.fit_whitening(frame(spark, x, "abcd"), list("abcd"))
    assert w.shape == (3, 4)  # the fourth direction doesn't vary
    assert by_id(K.independent_components(frame(spark, x, 'abcd'), list('abcd'), 4), ['ica_3']).size == 400
    z = (x - mean) @ w.T
    np.testing.assert_allclose(z.T @ z / len(z), np.eye(3), atol=1e-3)


def test_mixed_sources_are_found(spark):
    rng, n = np.random.default_rng(2), 3000
    sources = np.column_stack([rng.uniform(-1, 1, n), rng.laplace(0, 1, n), np.sign(np.sin(np.arange(n) / 7.0)) + 0.05 * rng.normal(size=n)])
    x = sources @ np.array([[1.0, 0.6, -0.4], [0.5, 1.0, 0.3], [-0.2, 0.7, 1.0]]).T + [5, 0, -3]
    gapped = x.copy()
    gapped[::500, 1] = np.nan
    model = K.fit_independent(frame(spark, gapped, "abc"), list("abc"))
    assert model.rounds < 100
    found = by_id(K.independent_components(frame(spark, gapped, "abc"), list("abc"), 3, model), ["ica_0", "ica_1", "ica_2"])
    assert np.isnan(found[::500]).all() and np.isnan(found).sum() == 3 * len(found[::500])
    whole = ~np.isnan(found).any(1)
    match = np.abs(np.corrcoef(found[whole].T, sources[whole].T)[:3, 3:])
    assert sorted(match.argmax(1)) == [0, 1, 2] and (match.max(1) > 0.98).all()
    np.testing.assert_allclose(found[whole].std(0), 1, atol=1e-6)
    again = K.fit_independent(frame(spark, gapped, "abc"), list("abc"))
    assert np.allclose(again.rotation, model.rotation, atol=1e-6)


def plain_chain(x, rounds, still):
    gaps = np.isnan(x)
    means = np.nanmean(x, 0)
    scale = np.nanstd(x, 0)
    out, before = np.where(gaps, means, x), None
    for _ in range(rounds):
        new, steps = out.copy(), []
        for c in range(x.shape[1]):
            z = np.column_stack([np.ones(len(x)), np.delete((out - means) / scale, c, 1)])
            w = np.linalg.lstsq(z[~gaps[:, c]], (x[~gaps[:, c], c] - means[c]) / scale[c], rcond=None)[0]
            new[gaps[:, c], c] = means[c] + scale[c] * (z[gaps[:, c]] @ w)
            steps.append(w)
        out = new
        moved = np.array([np.abs(w - (before[c] if before else 0)).max() for c, w in enumerate(steps)])
        if (moved[gaps.any(0)] < still).all():
            break
        before = steps
    return out


@pytest.mark.parametrize("rounds, still", [(1, 0.0), (4, 0.0), (30, 1e-3)])
def test_chained_imputation_equals_plain_numpy(spark, rounds, still):
    """Planted gaps in a tenth of the values of ``lineitem``, on scales from hundredths to tens of thousands."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(1500).select(*names).toPandas().to_numpy(float)
    x = rows + np.random.default_rng(3).normal(size=rows.shape) * [0.1, 10, 0.001, 0.001]
    x[:, 3] += x[:, 0] / 500
    x[np.random.default_rng(4).random(x.shape) < 0.1] = np.nan
    got = by_id(K.impute_chained(frame(spark, x, names), names, rounds, still), names)
    np.testing.assert_allclose(got, plain_chain(x, rounds, still), rtol=1e-6, atol=1e-8)


def test_chains_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 2.0, None, "x"), (2, float("nan"), 4.0, None), (3, float("inf"), 6.0, "y")], "id long, a double, b double, other string")
    got = K.impute_chained(df, ["a", "b"]).orderBy("id").collect()
    assert [r.other for r in got] == ["x", None, "y"] and all(np.isfinite([r.a, r.b]).all() for r in got) and got[0].a == 2.0 and got[1].b == 4.0
    with pytest.raises(ValueError):
        K.impute_chained(df.withColumn("a", F.lit(None).cast("double")), ["a", "b"])
    with pytest.raises(ValueError):
        K.fit_independent(df.limit(0), ["a", "b"])


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, None if t % 13 == 5 else float(10 * k + 5 * np.sin(t / 3) + t % 7 + rng.normal())) for k in range(4) for t in range(70)] + [(9, t, 1.0) for t in range(3)]
    return spark.createDataFrame(rows, "k long, t long, y double").repartition(3)


@pytest.mark.parametrize("kind, params", [("boosted_regressor", {"maxIter": 4, "maxDepth": 3}), ("forest_regressor", {"numTrees": 5, "maxDepth": 4}), ("linear", {})])
def test_folded_forecast_equals_transform_step_by_step(spark, history, kind, params):
    model = G.fit_recursive(history, "k", "t", "y", 4, kind, season=7, **params)
    got = {(r.k, r.t): r.y for r in G.forecast_recursively(model, history, "k", "t", "y", 4, 6, season=7).collect()}
    series = {k: [r.y for r in history.filter(f"k = {k} AND y IS NOT NULL").orderBy("t").collect()] for k in range(4)}
    want, end = {}, max(r.t for r in history.filter("y IS NOT NULL AND k < 9").select("t").collect())
    for step in range(1, 7):
        rows = [(k, *map(float, s[:-5:-1]), float((end + step) % 7)) for k, s in series.items()]
        names = ["k", *G.features(4, 7)]
        for r in M.predict(model, spark.createDataFrame(rows, names), ["k"]).collect():
            want[r.k, end + step] = r.prediction
            series[r.k].append(r.prediction)
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_forecasts_need_a_whole_model(spark, history):
    model = M.train(G.lag_table(history, "k", "t", "y", 2).withColumn("z", (F.col("y") > 10).cast("int")), ["lag_1"], "z", "logistic")
    with pytest.raises(ValueError):
        G.compiled(model)


# The queries of models, held against plain computation on the same rows

DATA = "/root/testdata/sf0.001"
NAMES = ["o_totalprice", "age", "n", "discount"]


@pytest.fixture(scope="module")
def labelled(spark):
    from millrace.queries import _labelled

    return _labelled(lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")).toPandas().sort_values("o_orderkey").reset_index(drop=True)


def query(spark, name):
    from millrace.queries import QUERIES

    return QUERIES[name](spark, DATA).toPandas().sort_values("o_orderkey").reset_index(drop=True)


def test_logistic_out_of_fold_equals_newton(spark, labelled):
    got = query(spark, "ml_logistic_out_of_fold")
    x, y, fold = labelled[NAMES].to_numpy(float), labelled["y"].to_numpy(float), labelled["fold"].to_numpy()
    want = np.zeros(len(y))
    for k in range(3):
        own = fold != k
        mean, scale = x[own].mean(0), x[own].std(0)
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z[own] @ w))
            w += np.linalg.solve((z[own] * (p * (1 - p) + 1e-12)[:, None]).T @ z[own], z[own].T @ (y[own] - p))
        want[fold == k] = 1 / (1 + np.exp(-z[fold == k] @ w))
    assert got["o_orderkey"].tolist() == labelled["o_orderkey"].tolist()
    np.testing.assert_allclose(got["probability"].to_numpy(float), want, atol=0.02)


def test_forest_predicts_held_out_rows_of_its_trees(spark, labelled):
    got = query(spark, "ml_forest")
    assert got["o_orderkey"].tolist() == labelled.loc[labelled["fold"] == 0, "o_orderkey"].tolist()
    assert ((got["probability"] >= 0.5) == (got["prediction"] == 1)).mean() > 0.99
    again = query(spark, "ml_forest")
    np.testing.assert_allclose(got["probability"].to_numpy(float), again["probability"].to_numpy(float))
    y = got["y"].to_numpy(float)
    assert np.mean((got["probability"] - y) ** 2) <= np.mean((y.mean() - y) ** 2) * 1.05


def test_clusters_are_those_of_their_means(spark, labelled):
    """Each row is in the cluster whose mean, on a common scale, is nearest: nothing moves any more."""
    got = query(spark, "ml_kmeans")
    x = labelled[["o_totalprice", "age", "n"]].to_numpy(float)
    z, c = (x - x.mean(0)) / x.std(0, ddof=1), got["cluster"].to_numpy(int)
    means = np.stack([z[c == i].mean(0) for i in range(4)])
    assert sorted(set(c)) == [0, 1, 2, 3] and (((z[:, None] - means) ** 2).sum(2).argmin(1) == c).mean() > 0.97


def test_principal_components_equal_eigenvectors(spark, labelled):
    got = query(spark, "ml_principal_components")
    x = labelled[NAMES].to_numpy(float)
    z = x - x.mean(0)
    values, vectors = np.linalg.eigh(z.T @ z / (len(z) - 1))
    for i in range(2):
        want = z @ vectors[:, -1 - i] / np.sqrt(values[-1 - i])
        own = got[f"pca_{i}"].to_numpy(float)
        np.testing.assert_allclose(own * np.sign(own @ want), want, atol=1e-6)

"""Operators against pandas on small frames with nulls, where order and nulls matter."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions import stats as A
from millrace.operators import prepare as P
from millrace.operators import relational as R
from millrace.operators import windows as W


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    df = pd.DataFrame({"g": rng.integers(0, 3, 60), "v": rng.integers(0, 20, 60).astype(float)})
    df.loc[rng.choice(60, 12, replace=False), "v"] = np.nan
    df["t"] = range(60)
    return df


@pytest.fixture(scope="module")
def table(spark, frame):
    rows = [(int(g), None if np.isnan(v) else float(v), int(t)) for g, v, t in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "g int, v double, t int").repartition(3)


def by_t(df, column):
    return [r[0] for r in df.orderBy("t").select(column).collect()]


def same(got, want):
    np.testing.assert_allclose(np.array([np.nan if x is None else x for x in got], float), np.asarray(want, float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("span, shift", [(3, 1), (5, 0), (4, 2)])
def test_ewm(frame, table, span, shift):
    same(by_t(W.ewm(table, "v", ["g"], ["t"], span, shift), "v_ewm"), frame.groupby("g")["v"].transform(lambda s: s.shift(shift).ewm(span=span, adjust=False).mean()))


def test_rolling_and_expanding(frame, table):
    g = frame.groupby("g")["v"]
    same(by_t(W.rolling(table, "v", ["g"], ["t"], [3], ["std"]), "v_roll_std_3"), g.transform(lambda s: s.shift(1).rolling(3, min_periods=1).std()))
    same(by_t(W.centred(table, "v", ["g"], ["t"], 6), "v_centred_6"), g.transform(lambda s: s.rolling(6, center=True).mean()))
    same(by_t(W.expanding(table, "v", ["g"], ["t"], ["var"]), "v_exp_var"), g.transform(lambda s: s.expanding().var().shift(1)))


def test_interpolate_takes_a_long_series_in_linear_time(spark):
    """Twenty thousand days with a value on every seventh: quadratic work would take minutes."""
    days = spark.range(20_000).select(F.lit("a").alias("g"), F.col("id").alias("t"), F.when(F.col("id") % 7 == 3, (F.col("id") * 2).cast("double")).alias("v"))
    began = time.perf_counter()
    got = W.interpolate(days, "v", ["g"], ["t"]).agg(F.count("v_filled"), F.sum("v_filled"), F.min("v_filled"), F.max("v_filled")).first()
    assert time.perf_counter() - began < 30
    known = range(3, 20_000, 7)
    want = [2 * min(max(t, known[0]), known[-1]) for t in range(20_000)]
    assert tuple(got) == (20_000, sum(want), 6.0, 2.0 * known[-1])


def test_interpolate(frame, table):
    same(by_t(W.interpolate(table, "v", ["g"], ["t"]), "v_filled"), frame.groupby("g")["v"].transform(lambda s: s.interpolate(limit_direction="both")))


def test_ranks_and_moments(frame, table):
    same(by_t(table.withColumn("r", A.percent_rank("v", ["g"])), "r"), frame.groupby("g")["v"].rank(pct=True))
    row = table.agg(A.skew("v"), A.kurtosis("v")).first()
    same(row, [frame["v"].skew(), frame["v"].kurt()])


def test_encoders(spark, frame, table):
    same(by_t(P.encode_labels(table, "v", first_seen="t", new="c"), "c"), pd.factorize(frame["v"])[0])
    want = frame["v"].map({v: i for i, v in enumerate(sorted(frame["v"].dropna().unique()))}).fillna(-1)
    same(by_t(P.encode_labels(table, "v", new="c"), "c"), want)
    same(by_t(P.quantile_bins(table, "v", 5), "v_bin"), pd.qcut(frame["v"], 5, labels=False, duplicates="drop"))
    same(by_t(P.impute(table, P.fit_impute(table, {"v": "mode"})), "v"), frame["v"].fillna(frame["v"].mode()[0]))
    empty = table.limit(0)
    assert P.encode_labels(empty, "v").count() == 0 and P.encode_frequency(empty, "v").count() == 0


def test_out_of_fold_means_never_see_their_fold(table):
    df = P.target_mean_out_of_fold(table.withColumn("f", F.col("t") % 4).withColumn("y", F.col("t") * 1.0), "g", "y", "f", weight=0.0)
    rows = df.select("g", "f", "y", "g_target").collect()
    for r in rows:
        others = [x.y for x in rows if x.g == r.g and x.f != r.f]
        assert abs(r.g_target - sum(others) / len(others)) < 1e-9


def test_joins_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 10), (None, 20), (4, 40)], "k int, b int")
    key = lambda df: sorted(((r.k, r.a, r.b) for r in df.collect()), key=str)
    assert key(R.merge(a, b, ["k"], "inner", null_keys_match=True)) == [(1, "x", 10), (None, "y", 20)]
    assert len(key(R.merge(a, b, ["k"], "outer", null_keys_match=True))) == 4
    assert R.not_in(a, b, ["k"]).count() == 2


def test_melt_and_pivot_are_inverse(spark):
    wide = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 5.0)], "i int, a double, b double")
    back = R.pivot(R.melt(wide, ["i"], ["a", "b"]), ["i"], "variable", ["a", "b"], F.first("value"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_splits_are_partitions(table):
    rest, sample = P.random_split(table, "t", 0.3)
    assert sorted(r.t for r in rest.union(sample).collect()) == list(range(60))


def test_correlated_columns_go_even_after_dropped_ones(spark):
    rows = [(float(i), i + 0.1 * (i % 2), float(i % 2), float((i * 7) % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert P.drop_correlated(df, ["a", "b", "c", "d"], 0.9) == ["a", "c", "d"]


def test_scalars(spark):
    one = spark.createDataFrame([("The cat  sat. Sat!", "the dog sat", [3, 1, 2, 2], 40.7, -74.0, 51.5, -0.1)], "s string, t string, a array<int>, y1 double, x1 double, y2 double, x2 double")
    o = S.overlap(F.col("s"), F.col("t"))
    c = F.col
    row = one.select(S.differences(c("a")), S.sign_changes(c("a")), S.is_monotone(c("a")), o["n_common"], S.haversine(c("y1"), c("x1"), c("y2"), c("x2")), S.cleaned(F.lit("A <b>x</b> http://q/ 1!")), S.easter(F.lit(2024)).cast("string"), S.shifted(F.lit("Zz a"), 1)).first()
    assert row[0] == [-2, 1, 0] and row[1] == 1 and row[2] is False and row[3] == 1
    assert abs(row[4] - 5577) < 20 and row[5] == "a x 1" and row[6] == "2024-03-31" and row[7] == "Aa b"


def test_models_return_incomplete_rows(spark):
    from millrace.operators import models as M

    rows = [(i, float(i % 7), float(i % 5) if i % 6 else None, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, y double, label double").withColumn("fold", F.col("id") % 2)
    out = M.out_of_fold(df, ["x", "y"], "label", "logistic", "fold", 2, ["id"]).collect()
    assert sorted(r.id for r in out) == list(range(40)) and all((r.prediction is None) == (r.probability is None) == (r.id % 6 == 0) for r in out)
    groups = M.cluster(df, ["x", "y"], "kmeans", 2, ["id"]).collect()
    assert sorted(r.id for r in groups) == list(range(40)) and all((r.cluster is None) == (r.id % 6 == 0) for r in groups)
    from millrace.operators import features as X

    for whiten in (False, True):
        parts = X.principal_components(df, ["x", "y"], 2, ["id"], whiten).collect()
        assert sorted(r.id for r in parts) == list(range(40)) and all((r.pca_0 is None) == (r.id % 6 == 0) for r in parts)

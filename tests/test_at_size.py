"""Faults that only larger tables showed."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import millrace.queries_models  # noqa: F401
import millrace.queries_patterns  # noqa: F401
import millrace.queries_tables  # noqa: F401
from millrace.functions import scalars as S
from millrace.operators import neighbours as N
from millrace.operators import order as O
from millrace.operators import relational as R
from millrace.operators import windows as W
from millrace.queries import QUERIES, SQL
from millrace.sources import tables as T


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_prices_round_as_the_sql_rounds(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1), float(p), q) for i, (p, q) in enumerate((round(c / 100, 2), q) for q in (8.0, 16.0, 32.0, 48.0) for c in range(90_001, 4_000_000, 1_777))]
    spark.createDataFrame(rows, "l_partkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["price_features"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(SQL["price_features"]).fetchall())
    halves = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (-3.5,), (1.005,), (0.49999999999999994,), (None,)], "x double")
    assert [r[0] for r in halves.select(S.rounded(F.col("x"), 0)).collect()] == [3.0, 4.0, -3.0, -4.0, 1.0, 0.0, None]
    assert halves.filter("x = 1.005").select(S.rounded(F.col("x"), 2)).first()[0] == 1.0


@pytest.mark.parametrize("n", [3, 7, 5000])
def test_limit_takes_the_first_rows_of_the_first_files(spark, tmp_path, n):
    at = str(tmp_path / "files")
    for low, high in ((0, 5), (5, 3000), (3000, 9000)):  # Spark reads the largest file first
        spark.range(low, high, 1, 1).write.mode("append").csv(f"{at}/{low:05d}", header=True)
    (tmp_path / "flat").mkdir()
    for i, f in enumerate(sorted((tmp_path / "files").glob("*/*.csv"))):
        f.rename(tmp_path / "flat" / f"part-{i}.csv")
    got = T.load(spark, str(tmp_path / "flat"), "csv", schema="id long", limit=n)
    got.write.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(n))


def test_days_between_are_never_shuffled(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, n)
    spark.createDataFrame([(1, 7, at(1), 10.0), (2, 7, at(5), 40.0)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    top = plan(QUERIES["interpolate_customers"](spark, str(tmp_path)))
    assert "Exchange" not in top[: top.index("Generate")] and "Join" not in top


def test_interpolated_days_equal_rows_of_a_spine(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [(1, d(1), None), (1, d(3), 4.0), (1, d(7), 9.0), (1, d(9), None), (2, d(4), None), (2, d(6), None), (3, d(2), 5.0)]
    df = spark.createDataFrame(rows, "k long, d date, v double")
    want = W.interpolate(W.spine(df, ["k"], "d").join(df, ["k", "d"], "left"), "v", ["k"], ["d"])
    key = lambda r: (r.k, r.d)
    got = sorted(W.interpolate_days(df, "v", ["k"], "d").collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(want.select("k", "d", "v", "v_filled").collect(), key=key)]


def test_row_statistics_are_compiled(spark):
    top = plan(QUERIES["row_statistics_more"](spark, "/root/testdata/sf0.001"))
    assert "lambda" not in top and "aggregate(" not in top and "transform(" not in top


def test_row_statistics_of_few_and_no_values(spark):
    rows = [(None, None, None, None, None), (2.0, None, None, None, None), (1.0, 2.0, 4.0, None, None), (1.0, 2.0, 4.0, 9.0, None), (3.0, 3.0, 3.0, 3.0, 3.0), (0.0, 2.0, 4.0, 9.0, -5.0)]
    df, c = spark.createDataFrame(rows, "a double, b double, c double, d double, e double"), list("abcde")
    got = df.select(S.row_sum(c), S.row_mean(c), S.row_var(c), S.row_kurtosis(c), S.row_min(c), S.row_missing(c), S.row_nonzero(c)).collect()
    for row, out in zip(rows, got):
        v = np.array([x for x in row if x is not None])
        n, m = len(v), v.mean() if len(v) else None
        assert out[0] == v.sum() and out[1] == (pytest.approx(m) if n else None) and out[2] == (pytest.approx(v.var(ddof=1)) if n > 1 else None)
        k = None if n < 4 else 0.0
        if n >= 4 and v.var():
            k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (((v - m) ** 4).mean() / v.var() ** 2 - 3) + 6)
        assert out[3] == (None if k is None else pytest.approx(k))
        assert tuple(out[4:]) == (v.min() if n else None, 5 - n, int((v != 0).sum()))


def test_quantiles_without_one_task_for_all_values(spark):
    x = np.random.default_rng(3).normal(size=1001).round(2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    assert O.quantiles(df, "x", shares) == pytest.approx(list(np.quantile(x, shares)))
    assert O.quantiles(df.filter("x is null"), "x", [0.5]) == [None]


def test_distances_to_pivots_come_in_small_parts():
    x = np.random.default_rng(5).normal(size=(3000, 8))
    parts = list(N._some(iter([pd.Series(list(x))]), x[:700]))
    assert max(len(p) for p in parts) <= N.ROWS and np.allclose(np.concatenate(parts), N._distances(x, x[:700]), atol=1e-6)


@pytest.mark.parametrize("name", ["ml_logistic_out_of_fold", "ml_kmeans", "ml_principal_components", "ml_forest"])
def test_models_join_their_rows_once(spark, name):
    assert "Join" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_words_are_looked_up_where_texts_stand(spark):
    assert "Exchange" not in plan(QUERIES["word_mentions"](spark, "/root/testdata/sf0.001"))


def test_ways_to_look_for_labels_agree(spark):
    labels = ["abc", "abcd", "abx", "bcd", "\U0001f600zz", "zz\u00e9", "xxxx", "", None, "abc"]
    rows = [(1, "abcabcd"), (2, "ab"), (3, ""), (4, None), (5, "--\U0001f600zz\u00e9" + "y" * 500 + "abx"), (6, "xxx"), (7, "x" * 5), (7, "x" * 5)]
    texts, known = spark.createDataFrame(rows, "id long, t string").repartition(2), spark.createDataFrame([(x,) for x in labels], "w string")
    want = sorted((i, w) for i, t in rows for w in set(labels) if w and t and w in t)
    for how in ({}, {"few": 0}, {"few": 0, "known_rows": 0}):
        assert sorted((r.id, r.w) for r in R.mentions(texts, "t", known, "w", **how).dropDuplicates().collect()) == sorted(set(want))
    assert sorted(tuple(r)[::2] for r in R.mentions(texts, "t", known, "w", few=0).collect()) == want


def test_importances_are_found_once(spark):
    """What is left in the plan reads the written importances, and opens no text but that whose span is looked for."""
    assert "Generate explode(" not in plan(QUERIES["chosen_spans"](spark, "/root/testdata/sf0.001"))

"""Operators whose work is dealt out by ranges, batches or pieces, against plain computation."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import models as M
from millrace.operators import order as O
from millrace.operators import relational as R
from millrace.operators import text as T
from millrace.operators import windows as W
from millrace.sources import scratch


@pytest.fixture
def batches_of_seven(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("shift", [0, 1, 3])
def test_ewm_equals_pandas_across_batches(spark, batches_of_seven, shift):
    rng, rows = random.Random(shift), []
    for k in ["a", "b", "c", None, "e"]:
        rows += [(k, i, None if rng.random() < 0.35 else rng.random() * 10) for i in range(rng.randint(1, 40))]
    got = W.ewm(spark.createDataFrame(rows, "k string, i int, v double"), "v", ["k"], ["i"], 5, shift).toPandas().sort_values(["k", "i"])
    frame = pd.DataFrame(rows, columns=["k", "i", "v"]).astype({"v": float})
    want = pd.concat(g.assign(w=g.v.ewm(span=5, adjust=False).mean().shift(shift)) for _, g in frame.groupby("k", dropna=False)).sort_values(["k", "i"])
    np.testing.assert_allclose(got.v_ewm.astype(float).to_numpy(), want.w.to_numpy(), atol=1e-12)
    assert W.ewm(spark.createDataFrame([], "k string, i int, v double"), "v", ["k"], ["i"], 5).count() == 0


def test_numbered_is_one_to_n(spark):
    rows = [(i, random.Random(i).randint(0, 9), None if i % 7 == 0 else "x") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v int, __part string").repartition(5)
    got = [(r.position, r.id) for r in O.numbered(df, [F.desc("v"), "id"]).orderBy("position").collect()]
    assert got == list(enumerate((i for i, *_ in sorted(rows, key=lambda r: (-r[1], r[0]))), 1))
    assert O.numbered(df.limit(0), ["id"]).count() == 0
    past, last = O.positional_split(df, ["id"], 20)
    assert past.count() == 480 and {r.id for r in last.collect()} == set(range(480, 500))


def test_counts_before_and_auc(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(300)] + [(None, 0.5), (1, None)]
    pos, neg = ([s for y, s in rows if y == k and s is not None] for k in (1, 0))
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "y int, s double")
    assert O.auc(df, "y", "s").first().auc == pytest.approx(want)
    assert O.auc(df.filter("y = 1"), "y", "s").first().auc is None
    ranks = {r.s: r.rank for r in O.tied_ranks(df, "s").collect()}
    known = sorted(s for _, s in rows if s is not None)
    assert ranks == {s: known.index(s) + (known.count(s) + 1) / 2 for s in set(known)}


@pytest.mark.parametrize("few", [0, 100])
def test_mentions_both_ways(spark, few):
    texts = [(1, "xx abc yy"), (2, "ab" * 400 + "needle" + "cd" * 300), (3, None), (4, ""), (1, "xx abc yy"), (5, "éabcé needl")]
    labels = ["abc", "needle", "bab", "", None, "zzz", "é", "dcd", "abc"]
    got = sorted((r.id, r.w) for r in R.mentions(spark.createDataFrame(texts, "id long, t string"), "t", spark.createDataFrame([(x,) for x in labels], "w string"), "w", few=few).collect())
    assert got == sorted((i, w) for i, t in texts for w in set(labels) if t and w and w in t)


def test_forecast_feeds_itself(spark):
    rows = [(1, i, float(i * i % 17)) for i in range(300)] + [(2, 5, 1.0)] + [(3, 1, 4.0), (3, 2, None), (3, 3, 5.0)]
    got = sorted(map(tuple, M.forecast(spark.createDataFrame(rows, "k long, s long, v double"), "k", "s", "v", [0.5, 0.25], 1.0, 4).collect()))
    want = []
    for k, s, lags in ((1, 299, [float(299 * 299 % 17), float(298 * 298 % 17)]), (3, 3, [5.0, 4.0])):
        for i in range(1, 5):
            lags = [0.5 * lags[0] + 0.25 * lags[1] + 1.0, lags[0]]
            want.append((k, s + i, lags[0]))
    assert got == [pytest.approx(w) for w in want]


def test_cluster_scores_of_few_clusters(spark):
    points = [(0, [0.0, 0.0]), (0, [0.0, 2.0]), (1, [10.0, 0.0]), (None, [1.0, 1.0]), (1, None)]
    row = M.cluster_scores(spark.createDataFrame(points, "c int, x array<double>"), "c", "x").first()
    assert row.davies_bouldin == pytest.approx(1 / math.sqrt(101)) and row.silhouette == pytest.approx((1 - 4 / 100 + 1 - 4 / 104) / 3)
    alone = M.cluster_scores(spark.createDataFrame(points[:2], "c int, x array<double>"), "c", "x").first()
    assert tuple(alone) == (None, None, None)


def test_stratified_parts_have_their_share(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else None) for i in range(1000)], "id long, s string")
    got = {(r.s): (r.n, r.k) for r in O.stratified_split(df, "id", "s", 0.25).groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("sampled").cast("int")).alias("k")).collect()}
    assert all(k == n // 4 for n, k in got.values()) and set(got) == {"a", "b", "c", None}
    folds = O.stratified_folds(df, "id", "s", 4).groupBy("s", "fold").count().collect()
    assert len(folds) == 16 and all(abs(r["count"] - got[r.s][0] / 4) < 1 for r in folds)


def test_word_importance_and_its_best_span(spark):
    df = spark.createDataFrame([(1, "a b c d", "b c", "p")], "id long, t string, s string, l string")
    imp = T.word_importance(df, "t", "s", "l", least=1)
    assert {r.word: r.importance for r in imp.collect()} == {"a": 0.0, "b": 1.0, "c": 1.0, "d": 0.0}
    assert T.best_span(df, ["id"], "t", "l", imp, "n", 1).first().span == "b"


@pytest.mark.parametrize("least", [1, 2, 3])
def test_spans_equal_all_runs(spark, least):
    """Every run of ``least`` words or more is tried; long texts, ties, and labels without importances among them."""
    rng = random.Random(least)
    value = {w: rng.choice([0.0, 0.25, 0.5, 1.0, rng.random()]) for w in "abcdefgh"}
    imp = spark.createDataFrame([("p", w, v) for w, v in value.items()], "l string, word string, importance double")
    texts = [" ".join(rng.choice("abcdefghXY") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 8, 13, 20, 30, 120)] + ["a " * 9, "  b   c\n d "]
    rows = [(i, t, "p") for i, t in enumerate(texts)] + [(100, "a b c d e", "n"), (101, "a b c d e", "q"), (102, "a b c d e", None), (103, None, "p")]

    def plain(t, label):
        w = (t or "").split()
        if label != "p" or len(w) <= 1 or len(w) < least:
            return (t or "").strip()
        v, n = [value.get(x.lower(), 0.5) for x in w], len(w)
        score = lambda a, z: round(sum(v[a:z]) / (z - a) * (0.7 + 0.3 * (1 - 0.1 * ((z - a) / n))), 12)
        a, z = max(((a, z) for a in range(n) for z in range(a + least, n + 1)), key=lambda r: (score(*r), -r[0], -r[1]))
        return " ".join(w[a:z])

    df = spark.createDataFrame(rows, "id long, t string, l string").repartition(3)
    got = {r.id: r.span for r in T.best_span(df, ["id"], "t", "l", imp, "n", 1, least=least).collect()}
    assert got == {i: plain(t, label) for i, t, label in rows}


def test_gcd(spark):
    cases = [([12, -18, 0], 6), ([], 0), ([0, 0], 0), ([7], 7), ([1134903170, 701408733], 1), ([5, None], None)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "a array<long>")
    assert [r.g for r in df.select(S.greatest_common_divisor(F.col("a")).alias("g")).collect()] == [w for _, w in cases]


def test_release_deletes_what_was_saved(spark, tmp_path):
    import os

    kept = scratch.saved(spark.range(5), "kept")
    assert kept.count() == 5 and os.path.exists(kept.saved_at)
    scratch.discard(kept)
    assert not os.path.exists(kept.saved_at)
    with scratch.passing() as keep:
        with scratch.passing() as keep_inner:
            a, b = scratch.saved(spark.range(1), "a"), scratch.saved(spark.range(1), "b")
            keep_inner(a, b)
        keep(b)
    assert not os.path.exists(a.saved_at) and os.path.exists(b.saved_at)
    with pytest.raises(KeyError), scratch.passing() as keep:
        c = scratch.saved(spark.range(1), "c")
        keep(c)
        raise KeyError
    assert not os.path.exists(c.saved_at)

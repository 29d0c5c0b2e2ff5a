"""Nearest neighbours by pivots, against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import neighbours as N
from millrace.operators import vectors as V

SCHEMA = "id long, v array<float>, kind string, score string, q int"


def direction(v):
    """The vector as floats of 32 bits, or None if it has no direction."""
    if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
        return None
    return np.array(v, np.float32).astype(float)


def plain(queries, table, k, least=-1.0, same=False):
    out = []
    for q, a, c in queries:
        met = []
        for key, b, d in table:
            x, y = direction(a), direction(b)
            if key != q and x is not None and y is not None and len(x) == len(y) and (not same or (c is not None and c == d)):
                s = round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 6) + 0.0
                if s >= least:
                    met.append((-s, key))
        out += [(q, key, -s) for s, key in sorted(met)[:k]]
    return sorted(out)


def close(got, want):
    got = sorted((r.q, r.found, r.score + 0.0) for r in got.collect())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1.1e-6)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(3)


def clustered(n, d, centres, spread, seed):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 1, (centres, d))
    return [(i, [float(np.float32(x)) for x in at[i % centres] + rng.normal(0, spread, d)], "ab"[i % 2]) for i in range(n)]


@pytest.mark.parametrize("k, least, same, pivots, block", [(3, -1.0, False, 6, 16), (1, 0.5, True, 3, 8), (5, 0.2, False, None, 4096), (200, -1.0, False, 4, 32)])
def test_nearest_equals_all_pairs(spark, k, least, same, pivots, block):
    rows = clustered(180, 6, 5, 0.4, k)
    rows += [(300, None, "a"), (301, [0.0] * 6, "a"), (302, [None] + [1.0] * 5, "b"), (303, [float("nan")] * 6, "a"), (304, [1.0, 2.0], "a"), (305, [2.0, 4.1], "b"), (306, [float("inf")] * 6, "a"), (307, rows[3][1], None), (308, [], "a")]
    df = frame(spark, rows)
    queries = df.filter("id % 7 = 0 OR id > 299")
    found = N.by_cosine(queries, df, "id", "v", k, least, "kind" if same else None, pivots=pivots, block=block)
    close(found.table, plain([r for r in rows if r[0] % 7 == 0 or r[0] > 299], rows, k, least, same))


def test_ties_go_by_key(spark):
    """A third of all rows are one vector, more than a block holds."""
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else [math.cos(i), math.sin(i), 0.1], None) for i in range(150)]
    df = frame(spark, rows)
    found = N.by_cosine(df.filter("id < 10"), df, "id", "v", 4, pivots=5, block=16)
    close(found.table, plain(rows[:10], rows, 4))


def test_far_blocks_are_not_compared(spark):
    rows = clustered(3000, 8, 20, 0.02, 1)
    df = frame(spark, rows)
    found = N.by_cosine(df.filter("id % 100 = 0"), df, "id", "v", 5, pivots=40, block=64)
    close(found.table, plain(rows[::100], rows, 5))
    work = found.work.agg(F.max("compared"), F.avg("compared"), F.count("*")).first()
    assert found.total == 3000 and work[2] == 30 and work[1] < 0.15 * 3000 and work[0] < 0.4 * 3000


def test_nothing_to_find(spark):
    df = frame(spark, clustered(10, 3, 2, 0.1, 2))
    empty = df.limit(0)
    assert V.nearest(empty, df, "id", "v", 3).collect() == [] and V.nearest(df, empty, "id", "v", 3).collect() == []
    assert V.nearest(df.filter("id = 0"), df.filter("id = 0"), "id", "v", 3).collect() == []


def test_repeated_queries_and_text_keys(spark):
    rows = clustered(40, 4, 3, 0.2, 3)
    df = frame(spark, rows).withColumn("id", F.concat(F.lit("k"), "id"))
    queries = df.filter("id = 'k7'")
    got = V.nearest(queries.unionAll(queries), df, "id", "v", 3)
    named = [(f"k{i}", v, c) for i, v, c in rows]
    close(got, plain([named[7]], named, 3))

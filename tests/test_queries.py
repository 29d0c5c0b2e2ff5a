"""Every query with an SQL twin against DuckDB, and the two without for their shape."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os

import duckdb
import pytest

import millrace.queries_models  # noqa: F401
import millrace.queries_patterns  # noqa: F401
import millrace.queries_tables  # noqa: F401
from millrace.queries import QUERIES, SQL, customer_days

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    a = sorted((tuple(map(plain, r)) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert a == b


def test_shifted_documents_tell_late_differences(spark, tmp_path):
    start = "a" * 40
    rows = [(1, start + " Zebra, 7 xyz"), (2, start + " Zebra, 7 xya"), (None, start), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    got = {tuple(r) for r in QUERIES["shifted_documents"](spark, str(tmp_path)).collect()}
    assert got == {(1, digest("d" * 40 + " Cheud, 7 abc")), (2, digest("d" * 40 + " Cheud, 7 abd")), (None, digest("d" * 40)), (3, None)}


def test_ewm_covers_all_suppliers(spark, tmp_path):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(5)]
    rows = [(s, days[i], float((s * 7 + i * i) % 11)) for s in (1, 20, 21, 500) for i in range(5)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for s in (1, 20, 21, 500):
        y = None
        for k, d, v in rows:
            if k == s:
                want[s, str(d.date())] = None if y is None else round(y, 4)
                y = v if y is None else y * 0.75 + v * 0.25
    got = {(r.l_suppkey, r.d): r.ewm for r in QUERIES["ewm_features"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == (v if v is None else pytest.approx(v, abs=1e-4)) for k, v in want.items())


def test_interpolation_covers_all_orders(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, 7, at(1), 10.0), (2, 7, at(1), 30.0), (3, 7, at(5), 40.0), (4, 8, at(2), 5.0), (5, 8, at(4), 9.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.o_custkey, r.d.day): r.v_filled for r in customer_days(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")).collect()}
    assert got == {(7, 1): 20.0, (7, 2): 25.0, (7, 3): 30.0, (7, 4): 35.0, (7, 5): 40.0, (8, 2): 5.0, (8, 3): 7.0, (8, 4): 9.0}
    sums = {tuple(r) for r in QUERIES["interpolate_customers"](spark, str(tmp_path)).collect()}
    assert sums == {(7, 5, 3, 30.0, 35.0), (8, 3, 1, 7.0, 7.0)}


def test_samples_are_stable(spark):
    for name in ("undersampled", "folds"):
        a, b = (sorted(map(tuple, QUERIES[name](spark, DATA).collect())) for _ in range(2))
        assert a == b and a


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

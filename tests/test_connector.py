"""The data source of its own: round trips, pushed filters, commits."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import connector as C

ROWS = [(i, None if i % 5 == 0 else i / 4, f"n{i:03d}" if i % 7 else None, i % 2 == 0) for i in range(200)]


@pytest.fixture
def path(spark, tmp_path):
    C.register(spark)
    df = spark.createDataFrame(ROWS, "id long, x double, name string, even boolean")
    df.repartitionByRange(8, "id").write.format("zjsonl").mode("append").save(f"{tmp_path}/t")
    return f"{tmp_path}/t"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip(spark, path):
    df = spark.read.format("zjsonl").load(path)
    assert df.schema.simpleString() == "struct<id:bigint,x:double,name:string,even:boolean>"
    assert sorted(map(tuple, df.collect()), key=str) == sorted(ROWS, key=str)
    df.filter("id < 3").write.format("zjsonl").mode("append").save(path)
    assert spark.read.format("zjsonl").load(path).count() == 203


CASES = ["id = 17", "id >= 150 AND id < 160", "id IN (3, 190, 500)", "x IS NULL", "name LIKE 'n01%'", "x > 40 AND name IS NOT NULL", "id <=> 5", "x <=> NULL", "id = 3 OR x > 48", "even AND id > 190", "name > 'n19'"]


@pytest.mark.parametrize("condition", CASES)
def test_filters_change_no_result(spark, path, condition):
    want = spark.createDataFrame(ROWS, "id long, x double, name string, even boolean").filter(condition)
    got = spark.read.format("zjsonl").load(path).filter(condition)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_pushed_filters_skip_files(spark, path):
    whole, one = spark.read.format("zjsonl").load(path), spark.read.format("zjsonl").load(path).filter("id = 17")
    assert whole.rdd.getNumPartitions() == 8 and one.rdd.getNumPartitions() == 1
    assert "Filter (" not in plan(one).replace("isnotnull", "")  # nothing is left for Spark to filter


def test_conditions_from_bounds():
    c = C.Condition
    assert c("a", "=", 5).possible(1, 9, False) and not c("a", "=", 5).possible(6, 9, True) and not c("a", "=", 5).possible(None, None, True)
    assert c("a", "null").possible(None, None, True) and not c("a", "null").possible(1, 2, False) and c("a", "starts", "n1").possible("n05", "n10", False) and not c("a", "starts", "n3").possible("n05", "n10", False)
    assert c("a", "in", (1, 20)).possible(15, 25, False) and not c("a", "in", (1, 30, None)).possible(15, 25, False)


def test_failed_writes_leave_nothing(spark, path, tmp_path):
    before = json.loads((tmp_path / "t" / C.MANIFEST).read_text())
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("zjsonl").mode("append").save(path)
    assert json.loads((tmp_path / "t" / C.MANIFEST).read_text()) == before
    assert spark.read.format("zjsonl").load(path).count() == 200
    spark.range(3).write.format("zjsonl").mode("overwrite").save(path)
    assert spark.read.format("zjsonl").load(path).columns == ["id"] and len(list((tmp_path / "t").glob("part-*"))) >= 1


def test_other_types_and_missing_tables_are_errors(spark, tmp_path):
    C.register(spark)
    with pytest.raises(Exception, match="can't hold"):
        spark.range(1).select(F.array("id").alias("a")).write.format("zjsonl").mode("append").save(f"{tmp_path}/x")
    with pytest.raises(Exception, match="no table"):
        spark.read.format("zjsonl").load(f"{tmp_path}/none")

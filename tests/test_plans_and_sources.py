"""Contracts, the operator registry, pipelines, formats and the streaming twins."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.plans.contracts import Column, Table, compatible
from millrace.plans.features import REGISTRY, SPEC
from millrace.plans.pipeline import ContractError, Pipeline, Registry, Step
from millrace.sources import tables as T
from millrace.streaming import events as E


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(100.0, "a", dt.datetime(2024, 1, 1)), (200.0, "b", dt.datetime(2024, 2, 1)), (300.0, "c", dt.datetime(2024, 3, 1))], "price double, name string, date timestamp")


def test_schema_checks(sample):
    good = Table({"price": Column("numeric", low=0), "name": Column("string", unique=True), "date": Column("datetime")}, needs=("float",), min_rows=3)
    assert good.check_schema(sample.schema) == [] and good.check_rows(sample) == []
    assert Table({"x": Column()}).check_schema(sample.schema) == ["column x is missing"]
    assert Table({"name": Column("int")}).check_schema(sample.schema) == ["column name is string, not int"]
    assert Table(needs=("bool",)).check_schema(sample.schema) == ["no bool column"]
    assert len(Table({"name": Column()}, closed=True).check_schema(sample.schema)) == 2


def test_value_checks(spark, sample):
    df = sample.union(spark.createDataFrame([(None, "a", None)], sample.schema))
    wrong = Table({"price": Column("float", nullable=False, high=250), "name": Column("string", unique=True, values=("a", "b"))}, min_rows=9).check_rows(df)
    assert wrong == ["column price has nulls", "column price has values over 250", "column name has repeated values", "column name has other values", "fewer than 9 rows"]
    assert Table({"price": Column("float", low=1)}).check_rows(df.limit(0)) == []


def test_compatibility():
    gives = Table({"a": Column("int"), "b": Column("string")}, closed=True)
    assert compatible(gives, Table({"a": Column("numeric")})) == []
    assert compatible(gives, Table({"b": Column("int"), "c": Column()})) == ["column b is given as string, not int", "column c is not given"]


def test_pipeline_checks_before_it_runs():
    r = Registry()
    r.operator("m.make", {}, {"out": Table({"a": Column("string")})})(lambda inputs: None)
    r.operator("m.use", {"x": Table({"a": Column("int")})}, {"y": Table()}, tags=("t",))(lambda inputs: None)
    with pytest.raises(ValueError):
        r.operator("m.use", {}, {})(lambda inputs: None)
    bad = Pipeline(r, [Step("m.make", {}, {"out": "p"}), Step("m.use", {"x": "p"}, {"y": "q"}), Step("m.none", {}, {}), Step("m.use", {}, {"z": "p"})]).check()
    assert any("given as string" in w for w in bad) and any("no operator" in w for w in bad) and any("made by 2" in w for w in bad) and any("input x is missing" in w for w in bad)
    circle = Pipeline(r, [Step("m.use", {"x": "a"}, {"y": "b"}), Step("m.use", {"x": "b"}, {"y": "a"})])
    assert any("circle" in w for w in circle.check())
    assert [o.name for o in r.find(tag="t")] == ["m.use"] and r.find(gives="a")[0].name == "m.make" and r.describe("m.use")["inputs"] == {"x": {"a": "int"}}


def test_pipeline_is_one_lineage(spark):
    p = Pipeline.of(REGISTRY, SPEC)
    assert p.check() == [] and p.external() == {"lineitem", "orders", "customer"} and [len(x) for x in p.levels()] == [1, 1, 1, 1]
    tables = {n: T.table(spark, "/root/testdata/sf0.001", n) for n in p.external()}
    out = p.build(tables, check_values=True)
    assert out["ranked"].count() == tables["customer"].count()
    with pytest.raises(ContractError, match="is not given"):
        p.build({})
    with pytest.raises(ContractError, match="column l_orderkey is missing"):
        p.build(tables | {"lineitem": tables["orders"]})


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "tsv", "jsonl"])
def test_formats_round_trip(spark, sample, tmp_path, fmt):
    T.save(sample, str(tmp_path / fmt), fmt)
    back = T.load(spark, str(tmp_path / fmt), fmt, schema=sample.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sample.collect()))
    assert T.load(spark, str(tmp_path / fmt), fmt, schema=sample.schema, columns=["name"], limit=2).count() == 2


def test_other_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.txt").write_text("one\ntwo")
    assert T.load(spark, str(tmp_path / "a.json"), "json").count() == 2
    assert T.load(spark, str(tmp_path / "b.txt"), "lines").count() == 2 and T.load(spark, str(tmp_path / "b.txt"), "text").count() == 1
    assert {(r["name"], r["suffix"]) for r in T.inventory(spark, str(tmp_path)).collect()} == {("a.json", "json"), ("b.txt", "txt")}
    assert T.with_file_name(T.load(spark, str(tmp_path / "b.txt"), "lines")).first().file == "b.txt"
    T.register("twice", lambda s, p, o: s.range(2))
    assert T.load(spark, "", "twice").count() == 2
    with pytest.raises(ValueError):
        T.load(spark, "", "nothing")
    with pytest.raises(ValueError):
        T.save(spark.range(1), "", "binary")
    assert T.nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first().x is None


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    batch.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = E.windowed_counts(stream, late="365 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    keep = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert keep(spark.table("w")) == keep(E.windowed_counts(batch))
    assert E.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_shared_tables_are_released(spark):
    from millrace.plans.contracts import Table
    from millrace.plans.pipeline import Pipeline, Registry

    registry = Registry()
    registry.operator("a.make", {"x": Table()}, {"y": Table()})(lambda inputs: inputs["x"].selectExpr("id * 2 AS id"))
    registry.operator("a.use", {"y": Table()}, {"z": Table()})(lambda inputs: inputs["y"].selectExpr("id + 1 AS id"))
    spec = [{"operator": "a.make", "inputs": {"x": "t"}, "outputs": {"y": "u"}}, *({"operator": "a.use", "inputs": {"y": "u"}, "outputs": {"z": f"z{i}"}} for i in range(2))]
    with Pipeline.of(registry, spec).build({"t": spark.range(4)}) as built:
        assert built["u"].is_cached and sorted(r.id for r in built["z1"].collect()) == [1, 3, 5, 7]
    assert not built["u"].is_cached and built.shared == []

"""A feature pipeline as a spec: child tables rolled up, merged into their parent, ranked in groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import percent_rank
from .contracts import Column, Table
from .pipeline import Pipeline, Registry

REGISTRY = Registry()
_KEYED = lambda *names: Table({n: Column("any") for n in names})


@REGISTRY.operator("rollup.lines", {"lines": _KEYED("l_orderkey", "l_extendedprice")}, {"orders": Table({"o_orderkey": Column("int"), "n_lines": Column("int"), "spent": Column("float")})}, tags=("aggregate",))
def roll_up_lines(inputs: dict[str, DataFrame]) -> DataFrame:
    """Lines by order."""
    return inputs["lines"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum("l_extendedprice").alias("spent"))


@REGISTRY.operator("rollup.orders", {"orders": _KEYED("o_orderkey", "o_custkey"), "lines": Table({"o_orderkey": Column("int"), "spent": Column("float")})}, {"customers": Table({"c_custkey": Column("int"), "n_orders": Column("int"), "spent": Column("float")})}, tags=("aggregate", "join"))
def roll_up_orders(inputs: dict[str, DataFrame]) -> DataFrame:
    """Orders with lines by customer."""
    both = inputs["orders"].join(inputs["lines"], "o_orderkey")
    return both.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("spent").alias("spent"))


@REGISTRY.operator("merge.features", {"parent": Table({"c_custkey": Column("int")}), "child": Table({"c_custkey": Column("int")})}, {"features": Table({"c_custkey": Column("int"), "n_orders": Column("int"), "spent": Column("float")})}, tags=("join",))
def merge_features(inputs: dict[str, DataFrame]) -> DataFrame:
    """Features of children on their parents, 0 without children."""
    return inputs["parent"].join(inputs["child"], "c_custkey", "left").fillna(0, ["n_orders", "spent"])


@REGISTRY.operator("rank.in_group", {"features": _KEYED("spent")}, {"ranked": Table({"place": Column("float")})}, tags=("window",))
def rank_in_group(inputs: dict[str, DataFrame], value: str, group: str) -> DataFrame:
    """Average rank within a group, as a share."""
    return inputs["features"].withColumn("place", percent_rank(value, [group]).cast("double"))


SPEC = [
    {"operator": "rollup.lines", "inputs": {"lines": "lineitem"}, "outputs": {"orders": "order_lines"}},
    {"operator": "rollup.orders", "inputs": {"orders": "orders", "lines": "order_lines"}, "outputs": {"customers": "customer_orders"}},
    {"operator": "merge.features", "inputs": {"parent": "customer", "child": "customer_orders"}, "outputs": {"features": "features"}},
    {"operator": "rank.in_group", "inputs": {"features": "features"}, "outputs": {"ranked": "ranked"}, "params": {"value": "spent", "group": "c_mktsegment"}},
]


def customer_features(tables: dict[str, DataFrame]) -> DataFrame:
    return Pipeline.of(REGISTRY, SPEC).build(tables)["ranked"]

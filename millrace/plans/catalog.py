"""A catalogue of operators and pipelines as tables, and queries on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pipeline import Registry


def operators_table(spark: SparkSession, registry: Registry) -> DataFrame:
    """(name, description, version, tags, inputs, outputs) of every operator."""
    rows = [(o.name, o.description, o.version, list(o.tags), sorted(o.inputs), sorted(o.outputs)) for o in registry.operators.values()]
    return spark.createDataFrame(rows, "name string, description string, version string, tags array<string>, inputs array<string>, outputs array<string>")


def usable_tables(registry: Registry, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, tags, slot, given, n_rows): the given tables whose schema and values meet an operator's input slot, with their rows.

    Each table is counted once, whatever the number of slots that it fits.
    """
    spark = next(iter(tables.values())).sparkSession
    fits = [(o.name, list(o.tags), slot, name) for o in registry.operators.values() for slot, contract in o.inputs.items() for name, df in tables.items() if not (contract.check_schema(df.schema) or contract.check_rows(df))]
    counts = reduce(DataFrame.unionAll, (df.agg(F.lit(name).alias("given"), F.count("*").alias("n_rows")) for name, df in tables.items()))
    return spark.createDataFrame(fits, "name string, tags array<string>, slot string, given string").join(F.broadcast(counts), "given").select("name", "tags", "slot", "given", "n_rows")


def steps_table(spark: SparkSession, pipelines: dict[str, list[dict]]) -> DataFrame:
    """(pipeline, step, operator, inputs, outputs) of pipeline specs."""
    rows = [(name, i, s["operator"], sorted(s.get("inputs", {}).values()), sorted(s.get("outputs", {}).values())) for name, spec in pipelines.items() for i, s in enumerate(spec)]
    return spark.createDataFrame(rows, "pipeline string, step int, operator string, inputs array<string>, outputs array<string>")


def service_graph(steps: DataFrame) -> DataFrame:
    """(giver, taker, n_edges, n_pipelines): which operators feed which, by the tables between them."""
    made = steps.select("pipeline", F.col("operator").alias("giver"), F.explode("outputs").alias("table"))
    used = steps.select("pipeline", F.col("operator").alias("taker"), F.explode("inputs").alias("table"))
    return made.join(used, ["pipeline", "table"]).groupBy("giver", "taker").agg(F.count("*").alias("n_edges"), F.count_distinct("pipeline").alias("n_pipelines"))


def usage(steps: DataFrame) -> DataFrame:
    """How often, and in how many pipelines, each operator is used."""
    return steps.groupBy("operator").agg(F.count("*").alias("n_steps"), F.count_distinct("pipeline").alias("n_pipelines"))


def search(operators: DataFrame, words: str) -> DataFrame:
    """Operators by the number of query words in name, description and tags; those without any are left out."""
    asked = F.array(*(F.lit(w) for w in sorted(set(words.lower().split()))))
    have = F.split(F.lower(F.concat_ws(" ", F.regexp_replace("name", r"[._]", " "), "description", F.concat_ws(" ", "tags"))), r"[^a-z0-9]+")
    return operators.select("name", F.size(F.array_intersect(asked, have)).alias("score")).filter("score > 0").orderBy(F.desc("score"), "name")

"""Recipes over parents, children and series that several feature sets share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import FUNCTIONS


def aggregate_children(child: DataFrame, keys: list[str], prefix: str, functions: list[str], columns: list[str] | None = None) -> DataFrame:
    """Every numeric column of a child table by every function, as PREFIX_column_FUNCTION, with the number of rows."""
    numeric = columns or [f.name for f in child.schema if f.name not in keys and f.dataType.simpleString().split("(")[0] in ("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")]
    aggs = [FUNCTIONS[f](c).alias(f"{prefix}_{c}_{f}") for c in numeric for f in functions]
    return child.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_n"), *aggs)


def uplift(df: DataFrame, keys: list[str], value: str, event: Column) -> DataFrame:
    """Mean during events over mean without, by group; 1 where either is missing."""
    inside, outside = F.avg(F.when(event, F.col(value))), F.avg(F.when(~event, F.col(value)))
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(inside, outside), F.lit(1.0)).alias("uplift"))


def since_first(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Days since the group's first."""
    return df.withColumn("age_days", F.datediff(day, F.min(day).over(Window.partitionBy(*keys))))


def level_means(df: DataFrame, value: str, levels: list[list[str]]) -> DataFrame:
    """Mean of a value over several key lists, each as a column; grouped first, then joined, so that hot keys stay split."""
    for keys in levels:
        name = f"{value}_by_{'_'.join(keys)}"
        df = df.join(df.groupBy(*keys).agg(F.avg(value).alias(name)), keys, "left")
    return df


def disaggregate(totals: DataFrame, shares: DataFrame, on: list[str], total: str, share: str = "share", name: str = "part") -> DataFrame:
    """Totals split by shares."""
    return totals.join(shares, on).withColumn(name, F.col(total) * F.col(share))


def buffered_split(df: DataFrame, day: str, cut, buffer_days: int) -> tuple[DataFrame, DataFrame]:
    """History before ``cut``; the rest together with a buffer of history for its lags."""
    return df.filter(F.col(day) < F.lit(cut)), df.filter(F.col(day) >= F.date_sub(F.lit(cut).cast("date"), buffer_days))


def last_weeks(df: DataFrame, day: str, weeks: int) -> tuple[DataFrame, DataFrame]:
    """All but the last weeks, and those."""
    newest = df.agg(F.max(day)).first()[0]
    edge = F.date_sub(F.lit(newest).cast("date"), 7 * weeks)
    return df.filter(F.to_date(day) <= edge), df.filter(F.to_date(day) > edge)


def best_of(df: DataFrame, key: str, label: str, score: str, k: int) -> DataFrame:
    """The k best labels of each key as one space-joined string, best first; ties go by label."""
    order = Window.partitionBy(key).orderBy(F.desc(score), label)
    top = df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k)
    return top.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", label))), lambda x: x[label].cast("string")), " ").alias("labels"))

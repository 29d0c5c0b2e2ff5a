"""Aggregate and ranking expressions whose conventions differ from Spark's built-ins."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_sum(c: Column | str) -> Column:
    """Sum that is 0, not null, without values."""
    return F.coalesce(F.sum(c), F.lit(0))


def skew(c: Column | str) -> Column:
    """Bias-corrected skewness G1; null under three values."""
    n = F.count(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2))


def kurtosis(c: Column | str) -> Column:
    """Bias-corrected excess kurtosis G2; null under four values."""
    n = F.count(c)
    return F.when(n >= 4, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(c) + 6))


def average_rank(value: str, partition: list[str], ascending: bool = True) -> Column:
    """Rank in which ties share their average; nulls have none."""
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    rank = F.rank().over(Window.partitionBy(*partition).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*partition, value))
    return F.when(F.col(value).isNotNull(), rank + (ties - 1) / 2)


def percent_rank(value: str, partition: list[str], ascending: bool = True) -> Column:
    """Average rank over the number of values."""
    return average_rank(value, partition, ascending) / F.count(value).over(Window.partitionBy(*partition))


def smoothed_mean(total: Column, n: Column, prior: Column, weight: float) -> Column:
    """(n * mean + weight * prior) / (n + weight)."""
    return (total + prior * F.lit(weight)) / (n + F.lit(weight))


def rmse(y: str, p: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def r2(y: str, p: str) -> Column:
    return 1 - F.sum(F.pow(F.col(y) - F.col(p), 2)) / (F.var_pop(y) * F.count(y))


def accuracy(y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double"))


def log_loss(y: str, p: str, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))


def weighted_mae(y: str, p: str, weight: Column) -> Column:
    return F.sum(weight * F.abs(F.col(y) - F.col(p))) / F.sum(weight)


def smape(y: str, p: str) -> Column:
    """Symmetric mean absolute percentage error; pairs of zeros count as exact."""
    both = F.abs(F.col(y)) + F.abs(F.col(p))
    return F.avg(F.when(both == 0, 0.0).otherwise(200 * F.abs(F.col(y) - F.col(p)) / both))

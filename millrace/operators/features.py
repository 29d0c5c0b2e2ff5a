"""Columns from columns: configured expressions, interactions, transforms, labels from scores, and fit-and-apply selections."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .models import with_incomplete
from .order import numbered
from .relational import COMPARE

EPS = 1e-8
#: The share of the lunation that had passed on 2001-01-01, and the lunations of a day.
MOON_START, MOON_RATE = 0.20439731, 0.03386319269


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


#: Kinds of configured expressions: each takes its columns and the rest of its configuration.
KINDS = {
    "sum": lambda c, k: _sum(c),
    "weighted": lambda c, k: _sum([x * F.lit(float(w)) for x, w in zip(c, k["weights"])]),
    "difference": lambda c, k: c[0] - c[1],
    "product": lambda c, k: reduce(lambda a, b: a * b, c),
    "ratio": lambda c, k: F.try_divide(c[0], c[1]),
    "power": lambda c, k: F.pow(c[0], F.lit(float(k["power"]))),
    "threshold": lambda c, k: F.coalesce(COMPARE[k.get("op", ">")](c[0], F.lit(k["value"])), F.lit(False)).cast("int"),
    "cross": lambda c, k: F.concat_ws(k.get("sep", "_"), *(x.cast("string") for x in c)),
}

TRANSFORMS = {
    "log1p": lambda c: F.log1p(F.greatest(c, F.lit(0.0))),
    "sqrt": lambda c: F.sqrt(F.greatest(c, F.lit(0.0))),
    "square": lambda c: c * c,
    "reciprocal": lambda c: 1 / (c + F.lit(EPS)),
    "cbrt": F.cbrt,
    "expm1": F.expm1,
    "signed_log1p": lambda c: F.signum(c) * F.log1p(F.abs(c)),
    "signed_expm1": lambda c: F.signum(c) * F.expm1(F.abs(c)),
}


def engineer(df: DataFrame, config: list[dict]) -> DataFrame:
    """New columns from plain data: {"name", "kind", "columns", ...}. A null compares as false."""
    return df.withColumns({k["name"]: KINDS[k["kind"]]([F.col(c) for c in k["columns"]], k) for k in config})


def interactions(df: DataFrame, pairs: list[tuple[str, str]], operations: list[str]) -> DataFrame:
    make = {"multiply": lambda a, b: a * b, "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "divide": lambda a, b: a / (b + F.lit(EPS))}
    return df.withColumns({f"{a}_{o}_{b}": make[o](F.col(a), F.col(b)) for a, b in pairs for o in operations})


def polynomials(df: DataFrame, cols: list[str], degree: int) -> DataFrame:
    return df.withColumns({f"{c}_pow_{d}": F.pow(c, F.lit(float(d))) for c in cols for d in range(2, degree + 1)})


def transform(df: DataFrame, cols: list[str], how: str) -> DataFrame:
    return df.withColumns({f"{c}_{how}": TRANSFORMS[how](F.col(c)) for c in cols})


def fit_column_filter(df: DataFrame, most_missing: float) -> list[str]:
    """Columns whose share of nulls is at most the limit; one aggregate."""
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if row[c] is None or row[c] <= most_missing]


def decode_labels(df: DataFrame, code: str, values: list, name: str) -> DataFrame:
    """The value of each code; codes without one are null."""
    return df.withColumn(name, F.get(F.array(*map(F.lit, values)), F.when(F.col(code) >= 0, F.col(code)).cast("int")))


def labels_from_scores(df: DataFrame, scores: list[str], name: str, labels: list | None = None) -> DataFrame:
    """The label of the largest score, the first of equal ones; its position without labels. Also one-hot columns to a class."""
    a = F.array(*(F.col(c).cast("double") for c in scores))
    at = (F.array_position(a, F.array_max(a)) - 1).cast("int")
    return df.withColumn(name, at if labels is None else F.get(F.array(*map(F.lit, labels)), at))


def combine_text(df: DataFrame, cols: list[str], name: str, sep: str = " ", prefix: bool = False) -> DataFrame:
    """Text columns joined, without nulls and blanks; with ``prefix`` each is headed by [its name]."""
    part = lambda c: F.when(F.trim(c) != "", F.concat(F.lit(f"[{c}] "), F.col(c)) if prefix else F.col(c))
    return df.withColumn(name, F.concat_ws(sep, *(part(c) for c in cols)))


def submission(df: DataFrame, id_col: str, prediction: str, target: str) -> DataFrame:
    return df.select(F.col(id_col), F.col(prediction).alias(target))


def match_by_position(a: DataFrame, b: DataFrame, order_a: list, order_b: list) -> DataFrame:
    """Row i of one frame with row i of another, each by its own order; sorted in ranges, see ``numbered``."""
    return numbered(a, order_a, "__i").join(numbered(b, order_b, "__i"), "__i").drop("__i")


def principal_components(df: DataFrame, cols: list[str], k: int, keep: list[str], whiten: bool = False) -> DataFrame:
    """pca_0 ... of centred columns, null where a column is; with ``whiten`` each has variance 1. Signs are free. Rows are written once, for all passes."""
    df = saved(df, "rows")
    x = VectorAssembler(inputCols=cols, outputCol="__raw", handleInvalid="skip").transform(df)
    x = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=False).fit(x).transform(x)
    model = PCA(k=k, inputCol="__x", outputCol="__p").fit(x)
    out = model.transform(x).withColumn("__a", vector_to_array("__p"))
    out = out.select(*keep, *(F.get("__a", F.lit(i)).alias(f"pca_{i}") for i in range(k)))
    out = with_incomplete(out, df, cols, keep)
    if not whiten:
        return out
    row = out.agg(*(F.stddev_samp(f"pca_{i}").alias(f"s{i}") for i in range(k))).first()
    return out.withColumns({f"pca_{i}": F.col(f"pca_{i}") / F.lit(row[i] or 1.0) for i in range(k)})


def lunar_day(d: Column) -> Column:
    """Phase of the moon as 0 to 7: the lunation's share in eighths, rounded. 0 without a date."""
    part = F.lit(MOON_START) + F.datediff(d, F.lit("2001-01-01").cast("date")) * F.lit(MOON_RATE)
    return F.coalesce(F.pmod(F.floor((part - F.floor(part)) * 8 + 0.5), F.lit(8)).cast("int"), F.lit(0))


def cumulative_by(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Mean and variance of all earlier values of the same keys, such as entity and weekday."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{value}_so_far_mean": F.avg(value).over(frame), f"{value}_so_far_var": F.var_samp(value).over(frame)})


def level_lags(df: DataFrame, value: str, time: str, levels: list[list[str]], steps: list[int]) -> DataFrame:
    """Lags of the mean over each key list and time, joined back to the rows."""
    for keys in levels:
        tag, w = "_".join(keys), Window.partitionBy(*keys).orderBy(time)
        means = df.groupBy(*keys, time).agg(F.avg(value).alias("__m"))
        lagged = means.select(*keys, time, *(F.lag("__m", k).over(w).alias(f"{value}_{tag}_lag_{k}") for k in steps))
        df = df.join(lagged, [*keys, time], "left")
    return df

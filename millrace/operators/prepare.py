"""Fit-and-apply preparation: imputing, encoding, scaling, binning, column selection, splitting.

A fit is one aggregate over the table and gives a small set of parameters; applying is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hashed
from ..functions.stats import kurtosis, skew, smoothed_mean
from .order import numbered, quantiles

STATISTICS = {"mean": F.avg, "mode": lambda c: F.mode(c, True)}


def fit_impute(df: DataFrame, how: dict[str, str]) -> dict:
    """Fill values by column: median, mean, mode (ties: the smallest), zero."""
    asked = {c: h for c, h in how.items() if h in STATISTICS}
    row = df.agg(*(STATISTICS[h](c).alias(c) for c, h in asked.items())).first().asDict() if asked else {}
    medians = {c: quantiles(df, c, [0.5])[0] for c, h in how.items() if h == "median"}
    return row | medians | {c: 0 for c, h in how.items() if h == "zero"}


def impute(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items() if v is not None})


def impute_by_group(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """Group median, else the median of all; grouped first, so that hot groups stay split."""
    groups = df.groupBy(*keys).agg(F.median(c).alias("__g"))
    overall = quantiles(df, c, [0.5])[0]
    return df.join(groups, keys, "left").withColumn(c, F.coalesce(F.col(c), F.col("__g"), F.lit(overall))).drop("__g")


#: Distinct values up to which one task numbers them.
FEW_VALUES = 100_000


def _codes(df: DataFrame, c: str, order: Column) -> DataFrame:
    """(value, code) of distinct values, in one task where they are few; beyond that by a sort in ranges."""
    values = df.filter(F.col(c).isNotNull()).groupBy(c).agg(order.alias("__o"))
    if values.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        coded = values.withColumn("__code", F.row_number().over(Window.orderBy("__o", c)))
    else:
        coded = numbered(values, ["__o", c], "__code")
    return coded.select(F.col(c).alias("__v"), (F.col("__code") - 1).cast("long").alias("__code"))


def encode_labels(df: DataFrame, c: str, first_seen: str | None = None, new: str | None = None, like: DataFrame | None = None) -> DataFrame:
    """Integer codes in sorted order, or in that of first appearance by the column ``first_seen``. Nulls, and values that ``like`` lacks, are -1."""
    fitted = like if like is not None else df
    table = _codes(fitted, c, F.min(first_seen) if first_seen else F.min(c))
    return df.join(table, F.col(c) == F.col("__v"), "left").withColumn(new or f"{c}_code", F.coalesce("__code", F.lit(-1))).drop("__v", "__code")


def encode_frequency(df: DataFrame, c: str, like: DataFrame | None = None, normalise: bool = True) -> DataFrame:
    counts = (like if like is not None else df).groupBy(c).agg(F.count("*").alias("__n")).filter(F.col(c).isNotNull())
    total = counts.agg(F.sum("__n")).first()[0] or 0
    share = F.col("__n") / F.lit(total) if normalise else F.col("__n")
    return df.join(counts, c, "left").withColumn(f"{c}_freq", F.coalesce(share, F.lit(0))).drop("__n")


def group_rare(df: DataFrame, c: str, least: int, other: str = "Other") -> DataFrame:
    counts = df.groupBy(c).agg(F.count("*").alias("__n"))
    return df.join(counts, c, "left").withColumn(c, F.when(F.col(c).isNull() | (F.col("__n") >= least), F.col(c)).otherwise(F.lit(other))).drop("__n")


def top_values(df: DataFrame, c: str, n: int) -> list:
    """The n most frequent values; ties go by value. A small sorted result."""
    return [r[0] for r in df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(n).collect()]


def target_mean(df: DataFrame, c: str, target: str, weight: float = 10.0) -> DataFrame:
    """Smoothed mean of the target for each value."""
    prior = df.agg(F.avg(target)).first()[0]
    stats = df.groupBy(c).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    return df.join(stats, c, "left").withColumn(f"{c}_target", smoothed_mean(F.col("__s"), F.col("__n"), F.lit(prior), weight)).drop("__s", "__n")


def target_mean_out_of_fold(df: DataFrame, c: str, target: str, fold: str, weight: float = 10.0) -> DataFrame:
    """As ``target_mean``, but from the other folds: all sums less the own fold's, in one grouped pass."""
    part = df.groupBy(c, fold).agg(F.sum(target).alias("__fs"), F.count(target).alias("__fn"))
    whole = part.groupBy(c).agg(F.sum("__fs").alias("__s"), F.sum("__fn").alias("__n"))
    prior = df.agg(F.avg(target)).first()[0]
    out = df.join(part, [c, fold], "left").join(whole, c, "left")
    value = smoothed_mean(F.coalesce(F.col("__s") - F.col("__fs"), F.lit(0.0)), F.coalesce(F.col("__n") - F.col("__fn"), F.lit(0)), F.lit(prior), weight)
    return out.withColumn(f"{c}_target", value).drop("__fs", "__fn", "__s", "__n")


def target_statistics_out_of_fold(df: DataFrame, c: str, target: str, fold: str, folds: int, functions: list[str]) -> DataFrame:
    """Median, least or greatest target of a value's rows in the other folds, as c_target_FUNCTION; null where there are none.

    Such statistics can't be subtracted, so each row counts once for every other fold.
    """
    kinds = {"median": F.median, "min": F.min, "max": F.max, "mean": F.avg}
    others = df.select(c, target, F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold))).alias("__for"))
    stats = others.groupBy(c, "__for").agg(*(kinds[f](target).alias(f"{c}_target_{f}") for f in functions))
    return df.join(stats.withColumnRenamed("__for", fold).withColumn(fold, F.col(fold).cast(df.schema[fold].dataType)), [c, fold], "left")


def fit_one_hot(df: DataFrame, c: str, most: int) -> list:
    """The categories that get a column: the most frequent ones."""
    return top_values(df, c, most)


def one_hot_top(df: DataFrame, c: str, values: list, other: str = "Other") -> DataFrame:
    """A 0/1 column for each fitted category, and one for all other values."""
    flags = {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in sorted(values)}
    rest = F.col(c).isNotNull() & ~F.col(c).isin(*values) if values else F.col(c).isNotNull()
    return df.withColumns(flags | {f"{c}_{other}": rest.cast("int")})


def impute_by_model(df: DataFrame, c: str, features: list[str]) -> DataFrame:
    """Fill nulls by a linear regression on other columns, fitted on the rows that have both; rows without a feature keep their null."""
    from .models import predict, train

    model = train(df, features, c, "linear", solver="normal")
    keys = df.withColumn("__known", F.col(c))
    filled = predict(model, keys, keys.columns)
    return filled.withColumn(c, F.coalesce("__known", "prediction")).select(*df.columns)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    found = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs))
    return df.agg(found.alias("p")).select(F.inline("p"))


def scale(df: DataFrame, cols: list[str], how: str = "standard", sample_std: bool = False) -> DataFrame:
    """standard, minmax or robust scaling; a constant column becomes 0."""
    stats = {
        "standard": lambda c: (F.avg(c), (F.stddev_samp if sample_std else F.stddev_pop)(c)),
        "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
    }
    if how == "robust":
        found = {c: quantiles(df, c, [0.25, 0.5, 0.75]) for c in cols}
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(float((high - low) if m is not None and high != low else 1.0)) for c, (low, m, high) in found.items()})
    stats = stats[how]
    row = df.agg(*(x.alias(f"{i}_{c}") for c in cols for i, x in enumerate(stats(c)))).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"0_{c}"])) / F.lit(float(row[f"1_{c}"] or 1.0)) for c in cols})


def cut(c: Column, edges: list[float]) -> Column:
    """Number of the interval (a, b] of increasing edges; the first is closed. Null outside."""
    out = F.when(c == edges[0], F.lit(0))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = out.when((c > a) & (c <= b), F.lit(i))
    return out


def quantile_bins(df: DataFrame, c: str, q: int) -> DataFrame:
    points = quantiles(df, c, [i / q for i in range(q + 1)])
    return df.withColumn(f"{c}_bin", cut(F.col(c), sorted(set(points))))


def width_bins(df: DataFrame, c: str, n: int) -> DataFrame:
    low, high = df.agg(F.min(c), F.max(c)).first()
    return df.withColumn(f"{c}_bin", cut(F.col(c), [low + (high - low) * i / n for i in range(n)] + [high]))


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row for each column: share of nulls, mean, variance, corrected skewness and kurtosis. One pass."""
    stat = lambda c: F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("null_ratio"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), skew(c).alias("skew"), kurtosis(c).alias("kurtosis"))
    return df.agg(F.array(*(stat(c) for c in cols)).alias("p")).select(F.inline("p"))


def unskew(df: DataFrame, cols: list[str], limit: float = 0.75) -> DataFrame:
    """log1p of columns whose corrected skewness is over the limit."""
    row = df.agg(*(skew(c).alias(c) for c in cols)).first()
    return df.withColumns({c: F.log1p(c) for c in cols if row[c] is not None and abs(row[c]) > limit})


def drop_correlated(df: DataFrame, cols: list[str], limit: float = 0.95) -> list[str]:
    """Columns to keep: one goes if any earlier one, itself kept or not, correlates with it above the limit."""
    pairs = [(a, b) for j, b in enumerate(cols) for a in cols[:j]]
    if not pairs:
        return list(cols)
    row = df.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first()
    gone = {b for i, (_, b) in enumerate(pairs) if row[i] is not None and abs(row[i]) > limit}
    return [c for c in cols if c not in gone]


def top_variance(df: DataFrame, cols: list[str], n: int) -> list[str]:
    row = df.agg(*(F.var_samp(c).alias(c) for c in cols)).first()
    return sorted(cols, key=lambda c: (-(row[c] or 0.0), c))[:n]


def folded(df: DataFrame, key: str, k: int, name: str = "fold") -> DataFrame:
    """A stable fold from the hash of a key: the same row, and all rows of a group key, always fall alike."""
    return df.withColumn(name, F.pmod(hashed(key), F.lit(k)).cast("int"))


def random_split(df: DataFrame, key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rest, sample): membership is a hash of key and seed, so both are the same in every run."""
    mark = hashed(key, seed) < int(share * (1 << 32))
    return df.filter(~mark), df.filter(mark)


def time_split(df: DataFrame, when: str, at) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(when) < F.lit(at)), df.filter(F.col(when) >= F.lit(at))


def undersample(df: DataFrame, label: str, keep_label, share: float, key: str, seed: int = 42) -> DataFrame:
    """All rows of one label, and a stable share of the others."""
    mark = hashed(key, seed) < int(share * (1 << 32))
    return df.filter((F.col(label) == F.lit(keep_label)) | mark)

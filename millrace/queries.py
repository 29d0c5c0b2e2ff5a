"""Queries of the library's own operators on the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions import stats as A
from .operators import entities as N
from .operators import features as X
from .operators import models as M
from .operators import order as O
from .operators import prepare as P
from .operators import relational as R
from .operators import text as T
from .operators import vectors as V
from .operators import windows as W
from .plans import catalog
from .plans.features import customer_features
from .sources.scratch import saved
from .sources.tables import table
from .streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table loader under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 4):
    return S.rounded(F.col(c) if isinstance(c, str) else c, digits)


def up(c, digits: int = 4):
    """Rounded with exact halves pushed up, since engines differ on halves."""
    return r((F.col(c) if isinstance(c, str) else c) + F.lit(1e-7), digits)


def day(c: str):
    return F.to_date(c)


def _daily(t) -> DataFrame:
    """Sold quantity by supplier and day."""
    return t("lineitem").groupBy("l_suppkey", day("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("v"))


DAILY = "daily AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


# Joins and aggregates

@query("""SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER w, 4) AS mean_q, round(stddev_samp(l_quantity) OVER w, 4) AS std_q,
          count(*) OVER w AS n, round(l_quantity - avg(l_quantity) OVER w, 4) AS diff FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def group_agg_join_back(t):
    df = R.join_back(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"], {"m": F.avg("l_quantity"), "s": F.stddev_samp("l_quantity"), "n": F.count("*")})
    return df.select("l_orderkey", "l_linenumber", r("m").alias("mean_q"), r("s").alias("std_q"), "n", r(F.col("l_quantity") - F.col("m")).alias("diff"))


@query("""WITH o AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS rev, max(l_quantity) AS mq FROM lineitem GROUP BY 1)
          SELECT o_custkey, count(*) AS n_orders, CAST(sum(n) AS BIGINT) AS n_lines, round(sum(rev) + 1e-7, 2) AS revenue, round(avg(rev) + 1e-7, 2) AS mean_rev, max(mq) AS max_q
          FROM orders JOIN o ON o_orderkey = l_orderkey GROUP BY 1""")
def child_table_rollup(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), F.max("l_quantity").alias("mq"))
    df = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return df.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("n").alias("n_lines"), up(F.sum("rev"), 2).alias("revenue"), up(F.avg("rev"), 2).alias("mean_rev"), F.max("mq").alias("max_q"))


@query("""SELECT c_custkey, n_name, r_name, c_mktsegment, coalesce(o.n, 0) AS n_orders, round(coalesce(o.total, 0), 2) AS total, round(total / nullif(c_acctbal, 0), 4) AS ratio
          FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
          LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def merge_feature_chain(t):
    nation, region = t("nation").withColumnRenamed("n_nationkey", "c_nationkey"), t("region").withColumnRenamed("r_regionkey", "n_regionkey")
    orders = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    df = R.enrich(t("customer"), (nation, ["c_nationkey"]), (region, ["n_regionkey"]), (orders, ["c_custkey"]))
    return df.select("c_custkey", "n_name", "r_name", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n_orders"), r(F.coalesce("total", F.lit(0.0)), 2).alias("total"), r(S.ratio(F.col("total"), F.col("c_acctbal"))).alias("ratio"))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_urgent, coalesce(b.n, 0) AS n_low FROM
          (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) a FULL JOIN
          (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority LIKE '5%' GROUP BY 1) b ON a.k = b.k""")
def outer_join_stats(t):
    part = lambda p, n: t("orders").filter(F.col("o_orderpriority").startswith(p)).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    return R.merge(part("1", "n_urgent"), part("5", "n_low"), ["k"], "outer").fillna(0)


@query("""SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)""")
def semi_top_classes(t):
    return R.semi_top(t("part"), "p_type", 5).select("p_partkey", "p_type")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount > 0.09)")
def anti_external_rows(t):
    hit = t("lineitem").filter("l_quantity >= 50 AND l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return R.not_in(t("supplier"), hit, ["s_suppkey"]).select("s_suppkey", "s_name")


@query("""SELECT a.s_suppkey, a.s_nationkey, count(b.s_suppkey) AS n_richer FROM supplier a LEFT JOIN supplier b
          ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal GROUP BY 1, 2""")
def self_join_rivals(t):
    a = t("supplier")
    b = a.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return a.join(b, (F.col("s_nationkey") == F.col("k")) & (F.col("bal") > F.col("s_acctbal")), "left").groupBy("s_suppkey", "s_nationkey").agg(F.count("bal").alias("n_richer"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(s.s_acctbal, -1) AS seller, coalesce(s2.s_acctbal, -1) AS rival FROM lineitem
          LEFT JOIN supplier s ON l_suppkey = s.s_suppkey LEFT JOIN supplier s2 ON l_partkey % 150 = s2.s_suppkey""")
def double_lookup(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.pmod("l_partkey", F.lit(150)).alias("other"))
    return R.lookup(df, t("supplier"), "s_suppkey", "s_acctbal", {"l_suppkey": "seller", "other": "rival"}, -1.0).select("l_orderkey", "l_linenumber", "seller", "rival")


@query("""WITH a AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer), b AS (SELECT seg, count(*) AS n FROM a GROUP BY 1)
          SELECT c_custkey, a.seg, n FROM a JOIN b ON a.seg IS NOT DISTINCT FROM b.seg""")
def null_safe_merge(t):
    a = t("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return R.merge(a, a.groupBy("seg").agg(F.count("*").alias("n")), ["seg"], "inner", null_keys_match=True).select("c_custkey", "seg", "n")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(l_quantity), 4) AS median_q, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(DISTINCT l_suppkey) AS n_supp,
          round(stddev_samp(l_discount), 6) AS std_d, round(skewness(l_extendedprice), 4) AS skew, round(kurtosis(l_extendedprice), 4) AS kurt FROM lineitem GROUP BY 1, 2""")
def grouped_statistics(t):
    q = "l_extendedprice"
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.median("l_quantity")).alias("median_q"), r(F.percentile(q, F.lit(0.9))).alias("p90"), F.count_distinct("l_suppkey").alias("n_supp"), r(F.stddev_samp("l_discount"), 6).alias("std_d"), r(A.skew(q)).alias("skew"), r(A.kurtosis(q)).alias("kurt"))


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def value_counts(t):
    df = t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    total = t("orders").count()
    return df.select("o_orderpriority", "n", r(F.col("n") / F.lit(total), 6).alias("share"))


@query("""SELECT o_custkey, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_total, arg_min(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_total FROM orders GROUP BY 1""")
def first_last_per_group(t):
    at = F.struct("o_orderdate", "o_orderkey")
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", at).alias("last_total"), F.min_by("o_totalprice", at).alias("first_total"))


@query("""WITH w AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
          SELECT l_suppkey, l_partkey, q AS part_total, round(q / sum(q) OVER (PARTITION BY l_suppkey), 6) AS share FROM w""")
def disaggregation_ratios(t):
    return W.group_share(t("lineitem"), "l_quantity", ["l_suppkey"], ["l_partkey"]).withColumn("share", r("share", 6))


# Filters and row expressions

@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(l_quantity >= 45 AND l_discount < 0.02, false)")
def remove_outliers(t):
    return R.remove_rows(t("lineitem"), [("l_quantity", ">=", 45), ("l_discount", "<", 0.02)]).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_extendedprice <= 30000")
def range_filter(t):
    return R.in_range(t("lineitem"), {"l_quantity": (10, 20), "l_extendedprice": (None, 30000)}).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) + 1e-7, 4) AS charge, round(l_extendedprice / nullif(l_quantity, 0) + 1e-7, 4) AS unit,
          round(l_tax / (l_discount + 1e-8), 2) AS guarded, round(ln(1 + l_extendedprice), 6) AS log_price, round(least(greatest(l_quantity, 5), 40), 4) AS clipped,
          CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS flag_code FROM lineitem""")
def engineered_features(t):
    q, p, d, x = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return t("lineitem").select("l_orderkey", "l_linenumber", up(p * (1 - d) * (1 + x)).alias("charge"), up(S.ratio(p, q)).alias("unit"), r(S.ratio(x, d, "eps"), 2).alias("guarded"), r(F.log1p(p), 6).alias("log_price"), r(S.clip(q, 5.0, 40.0)).alias("clipped"), S.mapped(F.col("l_returnflag"), {"A": 1, "R": 2}, 0).alias("flag_code"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_discount * 100, l_tax * 100] AS v FROM lineitem)
          SELECT l_orderkey, l_linenumber, round(list_sum(v), 4) AS s, round(list_avg(v), 4) AS m, round(list_var_samp(v), 4) AS var, round(list_max(v), 4) AS mx, list_position(v, list_max(v)) - 1 AS arg FROM a""")
def row_statistics(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    c = ["a", "b", "c"]
    return df.select("l_orderkey", "l_linenumber", r(S.row_sum(c)).alias("s"), r(S.row_mean(c)).alias("m"), r(S.row_var(c)).alias("var"), r(F.greatest(*c)).alias("mx"), S.row_argmax(c).alias("arg"))


# Preparation

@query("""WITH a AS (SELECT o_orderkey, nullif(o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice END) AS x, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s FROM orders)
          SELECT o_orderkey, round(coalesce(x, (SELECT median(x) FROM a)), 4) AS x, coalesce(s, (SELECT s FROM a WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS s FROM a""")
def impute_fit_apply(t):
    df = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("x"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("s"))
    return P.impute(df, P.fit_impute(df, {"x": "median", "s": "mode"})).withColumn("x", r("x"))


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x FROM orders)
          SELECT o_orderkey, round(coalesce(x, median(x) OVER (PARTITION BY o_orderpriority), (SELECT median(x) FROM a)), 4) AS x FROM a""")
def impute_group_median(t):
    df = t("orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("x"))
    return P.impute_by_group(df, "x", ["o_orderpriority"]).select("o_orderkey", r("x").alias("x"))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def encode_sorted(t):
    return P.encode_labels(t("part"), "p_brand", new="code").select("p_partkey", "code")


@query("""WITH f AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1) SELECT p_partkey, code FROM part JOIN f USING (p_brand)""")
def encode_first_seen(t):
    return P.encode_labels(t("part"), "p_brand", first_seen="p_partkey", new="code").select("p_partkey", "code")


@query("""WITH k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS code FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'))
          SELECT l_orderkey, l_linenumber, coalesce(code, -1) AS code FROM lineitem LEFT JOIN k ON CAST(l_shipdate AS DATE) = d""")
def encode_unseen(t):
    """Codes of the days before a cut; later days are unseen."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", day("l_shipdate").alias("d"))
    past, _ = P.time_split(lines, "l_shipdate", "1998-01-01")
    return P.encode_labels(lines, "d", new="code", like=past).select("l_orderkey", "l_linenumber", "code")


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_P FROM orders""")
def one_hot(t):
    return R.one_hot(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["O", "F", "P"]).drop("o_orderstatus")


@query("SELECT p_partkey, round(count(*) OVER (PARTITION BY p_type) / count(*) OVER (), 6) AS freq FROM part")
def encode_frequency(t):
    return P.encode_frequency(t("part"), "p_type").select("p_partkey", r("p_type_freq", 6).alias("freq"))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_size) >= 40 THEN CAST(p_size AS VARCHAR) ELSE 'Other' END AS size FROM part")
def group_rare(t):
    return P.group_rare(t("part").select("p_partkey", F.col("p_size").cast("string").alias("size")), "size", 40).select("p_partkey", "size")


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 4) AS q,
          round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 6) AS p,
          round((l_tax - (SELECT median(l_tax) FROM lineitem)) / (SELECT quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25) FROM lineitem), 4) AS x FROM lineitem""")
def scaled(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_tax").alias("x"))
    df = P.scale(P.scale(P.scale(df, ["q"], "standard"), ["p"], "minmax"), ["x"], "robust")
    return df.select("l_orderkey", "l_linenumber", r("q").alias("q"), r("p", 6).alias("p"), r("x").alias("x"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= q[1] THEN 0 WHEN l_extendedprice <= q[2] THEN 1 WHEN l_extendedprice <= q[3] THEN 2 ELSE 3 END AS bin
          FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)""")
def bins_quantile(t):
    return P.quantile_bins(t("lineitem"), "l_extendedprice", 4).select("l_orderkey", "l_linenumber", F.col("l_extendedprice_bin").alias("bin"))


@query("""SELECT p_partkey, CAST(greatest(ceil((p_size - lo) / ((hi - lo) / 7.0)) - 1, 0) AS INT) AS bin FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)""")
def bins_width(t):
    return P.width_bins(t("part"), "p_size", 7).select("p_partkey", F.col("p_size_bin").alias("bin"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", 0.0 AS null_ratio, round(avg({c}), 4) AS mean, round(var_samp({c}), 2) AS variance, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def column_profile(t):
    df = P.profile(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return df.select("column", "null_ratio", r("mean").alias("mean"), r("variance", 2).alias("variance"), r("skew").alias("skew"), r("kurtosis").alias("kurtosis"))


@query("""WITH a AS (SELECT o_orderpriority AS k, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders), s AS (SELECT k, sum(y) AS s, count(y) AS n FROM a GROUP BY 1)
          SELECT k, round((s + 10 * (SELECT avg(y) FROM a)) / (n + 10), 6) AS te FROM s""")
def target_encode_smooth(t):
    df = t("orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return P.target_mean(df, "k", "y").select("k", r("k_target", 6).alias("te")).distinct()


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority AS k, CAST(o_orderstatus = 'F' AS INT) AS y, o_orderkey % 5 AS f FROM orders),
          p AS (SELECT k, f, sum(y) AS s, count(y) AS n FROM a GROUP BY 1, 2), w AS (SELECT k, sum(s) AS s, sum(n) AS n FROM p GROUP BY 1)
          SELECT o_orderkey, round((w.s - p.s + 10 * (SELECT avg(y) FROM a)) / (w.n - p.n + 10), 6) AS te FROM a JOIN p USING (k, f) JOIN w USING (k)""")
def target_encode_kfold(t):
    df = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("k"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderkey") % 5).alias("f"))
    return P.target_mean_out_of_fold(df, "k", "y", "f").select("o_orderkey", r("k_target", 6).alias("te"))


# Series

@query(f"WITH {DAILY} SELECT l_suppkey, CAST(d AS VARCHAR) AS d, lag(v, 1) OVER w AS v_lag_1, lag(v, 7) OVER w AS v_lag_7, lead(v, 1) OVER w AS v_next FROM daily WINDOW w AS (PARTITION BY l_suppkey ORDER BY d)")
def lag_features(t):
    df = W.lags(_daily(t), "v", ["l_suppkey"], ["d"], [1, 7, -1])
    return df.select("l_suppkey", F.col("d").cast("string").alias("d"), "v_lag_1", "v_lag_7", F.col("v_lag_-1").alias("v_next"))


@query(f"""WITH {DAILY} SELECT l_suppkey, CAST(d AS VARCHAR) AS d, round(avg(v) OVER a, 4) AS m7, round(stddev_samp(v) OVER a, 4) AS s7, max(v) OVER b AS x28 FROM daily
           WINDOW a AS (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""")
def rolling_shifted(t):
    df = W.rolling(W.rolling(_daily(t), "v", ["l_suppkey"], ["d"], [7], ["mean", "std"]), "v", ["l_suppkey"], ["d"], [28], ["max"])
    return df.select("l_suppkey", F.col("d").cast("string").alias("d"), r("v_roll_mean_7").alias("m7"), r("v_roll_std_7").alias("s7"), F.col("v_roll_max_28").alias("x28"))


@query(f"""WITH {DAILY} SELECT l_suppkey, CAST(d AS VARCHAR) AS d, CASE WHEN count(v) OVER a = 6 THEN round(avg(v) OVER a, 4) END AS c6 FROM daily
           WINDOW a AS (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""")
def rolling_centred(t):
    return W.centred(_daily(t), "v", ["l_suppkey"], ["d"], 6).select("l_suppkey", F.col("d").cast("string").alias("d"), r("v_centred_6").alias("c6"))


@query(f"""WITH {DAILY} SELECT l_suppkey, CAST(d AS VARCHAR) AS d, round(avg(v) OVER a, 4) AS m, round(var_samp(v) OVER a + 1e-7, 4) AS s, coalesce(sum(v) OVER a, 0) AS so_far FROM daily
           WINDOW a AS (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_features(t):
    df = W.cumulative(W.expanding(_daily(t), "v", ["l_suppkey"], ["d"], ["mean", "var"]), ["l_suppkey"], ["d"], {"so_far": F.col("v")})
    return df.select("l_suppkey", F.col("d").cast("string").alias("d"), r("v_exp_mean").alias("m"), up("v_exp_var").alias("s"), "so_far")


_EWM = f"""WITH {DAILY}, l AS (SELECT l_suppkey, d, list(v) OVER (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN 200 PRECEDING AND {{0}}) AS v FROM daily)
            SELECT l_suppkey, CAST(d AS VARCHAR) AS d, round(list_reduce(v, lambda y, x: y * 0.75 + x * 0.25) + 1e-7, 4) AS ewm FROM l"""


@query(_EWM.format("1 PRECEDING"))
def ewm_features(t):
    return W.ewm(_daily(t), "v", ["l_suppkey"], ["d"], 7).select("l_suppkey", F.col("d").cast("string").alias("d"), up("v_ewm").alias("ewm"))


@query(_EWM.format("CURRENT ROW"))
def ewm_all_suppliers(t):
    """As ``ewm_features``, but each day counts for itself."""
    return W.ewm(_daily(t), "v", ["l_suppkey"], ["d"], 7, shift=0).select("l_suppkey", F.col("d").cast("string").alias("d"), up("v_ewm").alias("ewm"))


@query("""WITH a AS (SELECT o_orderpriority AS p, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
          e AS (SELECT p, s, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM a GROUP BY 1, 2), j AS (SELECT e.*, v, row_number() OVER (PARTITION BY e.p, e.s ORDER BY e.d) AS i FROM e LEFT JOIN a USING (p, s, d)),
          w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni
                FROM j WINDOW b AS (PARTITION BY p, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY p, s ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
          SELECT p AS o_orderpriority, s AS o_orderstatus, CAST(d AS VARCHAR) AS d, round(coalesce(v, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0)) + 1e-7, 2) AS v FROM w""")
def interpolate_spine(t):
    """Mean order value of each priority and status, on every day from its first to its last."""
    keys = ["o_orderpriority", "o_orderstatus"]
    a = t("orders").groupBy(*keys, day("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("v"))
    df = W.interpolate(W.spine(a, keys, "d").join(a, [*keys, "d"], "left"), "v", keys, ["d"])
    return df.select(*keys, F.col("d").cast("string").alias("d"), up("v_filled", 2).alias("v"))


def customer_days(t) -> DataFrame:
    """Mean order value of every customer on each day from the first order to the last."""
    a = t("orders").groupBy("o_custkey", day("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("v"))
    return W.interpolate_days(a, "v", ["o_custkey"], "d")


@query("""WITH a AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
          e AS (SELECT c, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM a GROUP BY 1), j AS (SELECT e.*, v, row_number() OVER (PARTITION BY e.c ORDER BY e.d) AS i FROM e LEFT JOIN a USING (c, d)),
          k AS (SELECT c, i, v, lead(i) OVER s AS ni, lead(v) OVER s AS nv FROM j WHERE v IS NOT NULL WINDOW s AS (PARTITION BY c ORDER BY i)),
          f AS (SELECT j.c, j.v, CASE WHEN j.v IS NOT NULL THEN j.v ELSE k.v + (k.nv - k.v) * (j.i - k.i) / (k.ni - k.i) END AS y FROM j ASOF JOIN k ON j.c = k.c AND j.i >= k.i)
          SELECT c AS o_custkey, count(*) AS n_days, count(*) - count(v) AS n_filled, round(avg(y) + 1e-7, 2) AS mean, round(max(CASE WHEN v IS NULL THEN y END) + 1e-7, 2) AS highest_filled FROM f GROUP BY 1""")
def interpolate_customers(t):
    """``customer_days``, summed up for each customer."""
    filled = F.when(F.col("v").isNull(), F.col("v_filled"))
    return customer_days(t).groupBy("o_custkey").agg(F.count("*").alias("n_days"), F.count(filled).alias("n_filled"), up(F.avg("v_filled"), 2).alias("mean"), up(F.max(filled), 2).alias("highest_filled"))


@query("""SELECT l_partkey, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_sale, round(max(l_extendedprice / l_quantity), 4) AS max_price, round(avg(l_extendedprice / l_quantity), 4) AS mean_price,
          count(DISTINCT round(l_extendedprice / l_quantity, 2)) AS n_prices FROM lineitem GROUP BY 1""")
def price_features(t):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return t("lineitem").groupBy("l_partkey").agg(F.min(day("l_shipdate")).cast("string").alias("first_sale"), r(F.max(price)).alias("max_price"), r(F.avg(price)).alias("mean_price"), F.count_distinct(r(price, 2)).alias("n_prices"))


@query("""WITH m AS (SELECT l_suppkey, month(l_shipdate) AS mo, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
          SELECT l_suppkey, """ + ", ".join(f'sum(q) FILTER (mo = {i}) AS "{i}"' for i in range(1, 13)) + " FROM m GROUP BY 1")
def pivot_months(t):
    m = t("lineitem").groupBy("l_suppkey", F.month("l_shipdate").alias("mo")).agg(F.sum("l_quantity").alias("q"))
    return R.pivot(m, ["l_suppkey"], "mo", list(range(1, 13)), F.sum("q"))


@query("""SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def melt_columns(t):
    return R.melt(t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query(f"WITH {DAILY} SELECT l_suppkey, isodow(d) - 1 AS weekday, round(median(v), 4) AS forecast, count(*) AS n FROM daily GROUP BY 1, 2")
def median_forecast_weekday(t):
    return _daily(t).groupBy("l_suppkey", F.weekday("d").alias("weekday")).agg(r(F.median("v")).alias("forecast"), F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2.0 AS place,
          round((rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2.0) / count(*) OVER (PARTITION BY o_custkey), 6) AS pct FROM orders""")
def average_ranks(t):
    return t("orders").select("o_custkey", "o_orderkey", A.average_rank("o_totalprice", ["o_custkey"]).alias("place"), r(A.percent_rank("o_totalprice", ["o_custkey"]), 6).alias("pct"))


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_orders(t):
    return R.top_per_group(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def distinct_first(t):
    return R.distinct_first(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT s_nationkey AS nation, s_acctbal AS bal, 0 AS part FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, 1 FROM customer")
def union_marked(t):
    return R.union_all(t("supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal")), t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")), marker="part")


# Dates

@query("""WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
          SELECT o_orderkey, year(d) AS year, month(d) AS month, day(d) AS day, isodow(d) - 1 AS dayofweek, dayofyear(d) AS dayofyear, weekofyear(d) AS week, quarter(d) AS quarter, day(last_day(d)) AS days_in_month,
          CAST(day(d) = 1 AS INT) AS is_month_start, CAST(d = last_day(d) AS INT) AS is_month_end, CAST(dayofyear(d) = 1 AS INT) AS is_year_start, CAST(month(d) = 12 AND day(d) = 31 AS INT) AS is_year_end,
          CAST(isodow(d) >= 6 AS INT) AS is_weekend, CAST(day(d) = 15 OR d = last_day(d) AS INT) AS is_payday FROM a""")
def datetime_parts(t):
    return t("orders").select("o_orderkey", day("o_orderdate").alias("d")).select("o_orderkey", *(c.alias(n) for n, c in S.date_parts("d").items()))


@query("SELECT event_id, round(sin(2 * pi() * hour(ts) / 24) + 1e-7, 6) AS s, round(cos(2 * pi() * hour(ts) / 24) + 1e-7, 6) AS c, round(((floor(epoch(ts)) - 947182440) % 2551443 + 2551443) % 2551443 / 2551443 + 1e-7, 4) AS moon, date_diff('day', CAST(ts AS DATE), make_date(year(ts), 12, 25)) AS to_holiday FROM events")
def calendar_features(t):
    s, c = S.cyclical(F.hour("ts"), 24)
    return t("events").select("event_id", up(s, 6).alias("s"), up(c, 6).alias("c"), up(S.moon_phase(F.date_trunc("second", "ts"))).alias("moon"), S.days_to(day("ts"), 12, 25).alias("to_holiday"))


# Text

@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), 'https?://[^ ]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS digest FROM documents""")
def clean_text(t):
    return t("documents").select("doc_id", F.md5(S.cleaned(F.col("text"))).alias("digest"))


@query(r"""WITH a AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS lw FROM documents)
           SELECT doc_id, length(text) AS n_chars, len(w) AS n_words, length(regexp_replace(text, '\s', '', 'g')) AS n_non_space, len(regexp_extract_all(text, '!')) AS n_exclaim, len(regexp_extract_all(text, '\?')) AS n_question,
           len(regexp_extract_all(text, '[A-Z]')) AS n_upper, round(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) / nullif(length(text), 0), 6) AS punct_ratio, round(len(list_distinct(lw)) / nullif(len(w), 0), 6) AS unique_ratio FROM a""")
def text_features(t):
    f = S.text_features("text")
    return t("documents").select("doc_id", *((r(c, 6) if n.endswith("ratio") else c).alias(n) for n, c in f.items()))


@query(r"""WITH a AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations)
           SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS n_common, round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) AS jaccard, round(len(list_intersect(a.w, b.w)) / nullif(len(a.w), 0), 6) AS share_a
           FROM a JOIN a b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def text_pair_overlap(t):
    a = t("conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    f = S.overlap(F.col("text"), F.col("other"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", f["n_common"].alias("n_common"), r(f["jaccard"], 6).alias("jaccard"), r(f["share_a"], 6).alias("share_a"))


@query(r"""WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM conversations), tf AS (SELECT conv_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
           df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 3), x AS (SELECT conv_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT conv_id) FROM tf)) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term))
           SELECT conv_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY conv_id)), 6) AS weight FROM x""")
def tfidf_weights(t):
    df = T.tfidf(t("conversations"), "conv_id", "text", min_df=3, sublinear=True)
    return df.select("conv_id", "term", r("weight", 6).alias("weight"))


@query(r"""WITH w AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '\S+')) AS tok, unnest(range(len(regexp_extract_all(text, '\S+')))) AS i FROM conversations)
           SELECT conv_id, turn, role, i, lag(tok) OVER o AS prev, lead(tok) OVER o AS next, CAST(regexp_matches(tok, '^[0-9]+$') AS INT) AS is_digit, CAST(regexp_matches(tok, '^\p{L}+$') AS INT) AS is_alpha, length(tok) AS n_chars, right(tok, 3) AS suffix, round(i / (max(i) OVER (PARTITION BY conv_id, turn) + 1), 6) AS place
           FROM w WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)""")
def token_features(t):
    df = T.tokens(t("conversations"), ["conv_id", "turn", "role"], "text")
    f = S.token_flags("tok")
    return df.select("conv_id", "turn", "role", F.col("i").cast("long").alias("i"), "prev", "next", *(f[n].alias(n) for n in ("is_digit", "is_alpha", "n_chars", "suffix")), r("place", 6).alias("place"))


@query(r"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
           SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, path, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth, CAST(contains(url, '?') AS INT) AS has_query, length(url) AS url_length FROM a""")
def url_features(t):
    return t("pages").select("page_id", *(c.alias(n) for n, c in S.url_parts("url").items()))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \n\r\t]+', ' ', 'g'))) AS digest FROM pages""")
def html_text(t):
    return t("pages").select("page_id", F.md5(S.without_tags(F.col("html"))).alias("digest"))


@query("SELECT doc_id, n_name FROM documents JOIN (SELECT DISTINCT lower(substr(n_name, 1, 4)) AS n_name FROM nation) ON contains(text, n_name)")
def label_mentions(t):
    labels = t("nation").select(F.lower(F.substring("n_name", 1, 4)).alias("n_name"))
    return R.mentions(t("documents").select("doc_id", "text"), "text", labels, "n_name").select("doc_id", "n_name")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def json_props(t):
    k = F.from_json("props", "k bigint")["k"]
    return t("events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("SELECT lang, md5(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'defghijklmnopqrstuvwxyzabcDEFGHIJKLMNOPQRSTUVWXYZABC')) AS code, count(*) AS n FROM documents GROUP BY ALL")
def shifted_text(t):
    return t("documents").groupBy("lang", F.md5(S.shifted(F.col("text"), 3)).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'defghijklmnopqrstuvwxyzabcDEFGHIJKLMNOPQRSTUVWXYZABC')) AS digest FROM documents")
def shifted_documents(t):
    """Whole texts, a row for each document."""
    return t("documents").select("doc_id", F.md5(S.shifted(F.col("text"), 3)).alias("digest"))


# Vectors

_SIM = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""WITH b AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT b.vec_id AS q, a.vec_id AS found, round({_SIM}, 6) AS score FROM embeddings a, b WHERE a.vec_id <> b.vec_id)
           SELECT q, found, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, found) AS n FROM s) WHERE n <= 5""")
def cosine_nearest(t):
    """A stated query set (ids divisible by 100) against all rows."""
    return V.nearest(t("embeddings").filter("vec_id % 100 = 0"), t("embeddings"), "vec_id", "embedding", 5)


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i - 1 AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM e GROUP BY ALL""")
def class_prototypes(t):
    return V.prototypes(t("embeddings"), "label", "embedding").select("label", F.posexplode("prototype").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), r("x", 6).alias("x"))


@query("""WITH a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS p FROM supplier), b AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_name, s_suppkey) AS p FROM supplier)
          SELECT id, round(1.0 / (60 + a.p) + 1.0 / (60 + b.p), 8) AS score FROM a JOIN b USING (id)""")
def rank_fusion(t):
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", "s_name")
    a, b = O.numbered(rows, [F.desc("s_acctbal"), "id"], "place"), O.numbered(rows, ["s_name", "id"], "place")
    return V.rank_fusion("id", a, b).select("id", r("score", 8).alias("score"))


# Splits, metrics, streams, plans

@query("SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS n_train, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS n_test FROM events GROUP BY 1")
def temporal_split(t):
    train, test = P.time_split(t("events"), "ts", "2024-01-20")
    return R.merge(train.groupBy("event_type").agg(F.count("*").alias("n_train")), test.groupBy("event_type").agg(F.count("*").alias("n_test")), ["event_type"], "outer").fillna(0)


HASH = "('0x' || substr(md5('42:' || {0}), 1, 8))::BIGINT"


@query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' OR {HASH.format('o_orderkey')} < {int(0.1 * (1 << 32))}")
def undersampled(t):
    return P.undersample(t("orders"), "o_orderstatus", "P", 0.1, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query(f"SELECT o_orderkey, o_custkey, CAST({HASH.format('o_custkey')} % 5 AS INT) AS fold FROM orders")
def folds(t):
    return P.folded(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 5)


@query("""WITH a AS (SELECT l_extendedprice AS y, l_quantity * (SELECT avg(l_extendedprice / l_quantity) FROM lineitem) AS p, l_quantity AS w FROM lineitem)
          SELECT round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sum(w * abs(y - p)) / sum(w), 4) AS wmae, round(avg(200 * abs(y - p) / (abs(y) + abs(p))), 4) AS smape FROM a""")
def regression_metrics(t):
    rate = t("lineitem").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).first()[0]
    df = t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.lit(rate)).alias("p"), F.col("l_quantity").alias("w"))
    return df.agg(r(A.rmse("y", "p")).alias("rmse"), r(A.mae("y", "p")).alias("mae"), r(A.r2("y", "p"), 6).alias("r2"), r(A.weighted_mae("y", "p", F.col("w"))).alias("wmae"), r(A.smape("y", "p")).alias("smape"))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(t):
    return E.windowed_counts(t("events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r("total").alias("total"))


@query("""WITH a AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
          SELECT user_id, CAST(min(ts) AS DATE)::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def event_sessions(t):
    return E.sessions(t("events")).select("user_id", day("start").cast("string").alias("day"), "n", r("total").alias("total"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS spent FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, count(*) AS n_orders, sum(spent) AS spent FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1)
          SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, round(coalesce(spent, 0), 2) AS spent, round((rank() OVER s + (count(*) OVER (PARTITION BY c_mktsegment, coalesce(spent, 0)) - 1) / 2.0) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS place
          FROM customer LEFT JOIN o ON c_custkey = o_custkey WINDOW s AS (PARTITION BY c_mktsegment ORDER BY coalesce(spent, 0))""")
def pipeline_customer_features(t):
    out = customer_features({"customer": t("customer"), "orders": t("orders"), "lineitem": t("lineitem")})
    return out.select("c_custkey", "n_orders", r("spent", 2).alias("spent"), r("place", 6).alias("place"))


@query("""SELECT o_custkey, count(*) AS ord_n, round(sum(o_totalprice) + 1e-7, 2) AS ord_o_totalprice_sum, round(max(o_totalprice), 2) AS ord_o_totalprice_max, round(stddev_samp(o_totalprice) + 1e-7, 2) AS ord_o_totalprice_std FROM orders GROUP BY 1""")
def child_numeric_aggregates(t):
    df = N.aggregate_children(t("orders"), ["o_custkey"], "ord", ["sum", "max", "std"], ["o_totalprice"])
    return df.select("o_custkey", "ord_n", *(up(f"ord_o_totalprice_{f}", 2).alias(f"ord_o_totalprice_{f}") for f in ("sum", "max", "std")))


@query("""WITH a AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_discount >= 0.09) AS x, avg(l_quantity) FILTER (l_discount < 0.09) AS y FROM lineitem GROUP BY 1)
          SELECT l_suppkey, round(coalesce(x / y, 1) + 1e-7, 6) AS uplift FROM a""")
def event_uplift(t):
    return N.uplift(t("lineitem"), ["l_suppkey"], "l_quantity", F.col("l_discount") >= 0.09).withColumn("uplift", up("uplift", 6))


@query("""SELECT l_orderkey, l_linenumber, date_diff('day', min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_partkey), CAST(l_shipdate AS DATE)) AS age_days FROM lineitem""")
def days_since_first_sale(t):
    return N.since_first(t("lineitem").withColumn("d", day("l_shipdate")), ["l_partkey"], "d").select("l_orderkey", "l_linenumber", "age_days")


@query("""SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_suppkey) + 1e-7, 4) AS a, round(avg(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus) + 1e-7, 4) AS b FROM lineitem""")
def level_means(t):
    df = N.level_means(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"), "l_quantity", [["l_suppkey"], ["l_returnflag", "l_linestatus"]])
    return df.select("l_orderkey", "l_linenumber", up("l_quantity_by_l_suppkey").alias("a"), up("l_quantity_by_l_returnflag_l_linestatus").alias("b"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2), f AS (SELECT l_suppkey, l_partkey, q / sum(q) OVER (PARTITION BY l_suppkey) AS share FROM s),
          w AS (SELECT l_suppkey, sum(l_quantity) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
          SELECT l_suppkey, l_partkey, round(total * share + 1e-7, 4) AS part FROM f JOIN w USING (l_suppkey)""")
def disaggregated_forecast(t):
    past, new = P.time_split(t("lineitem"), "l_shipdate", "1998-01-01")
    shares = W.group_share(past, "l_quantity", ["l_suppkey"], ["l_partkey"])
    df = N.disaggregate(new.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total")), shares, ["l_suppkey"], "total")
    return df.select("l_suppkey", "l_partkey", up("part").alias("part"))


@query(f"""WITH {DAILY} SELECT l_suppkey, CAST(d AS VARCHAR) AS d, round(avg(v) OVER a + 1e-7, 4) AS far FROM daily WINDOW a AS (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN 34 PRECEDING AND 28 PRECEDING)""")
def rolling_far_shifted(t):
    return W.rolling(_daily(t), "v", ["l_suppkey"], ["d"], [7], ["mean"], shift=28).select("l_suppkey", F.col("d").cast("string").alias("d"), up("v_roll_mean_7").alias("far"))


@query("""SELECT count(*) FILTER (CAST(l_shipdate AS DATE) <= m - 28) AS n_old, count(*) FILTER (CAST(l_shipdate AS DATE) > m - 28) AS n_new FROM lineitem, (SELECT max(CAST(l_shipdate AS DATE)) AS m FROM lineitem)""")
def last_weeks_split(t):
    old, new = N.last_weeks(t("lineitem"), "l_shipdate", 4)
    return old.agg(F.count("*").alias("n_old")).join(new.agg(F.count("*").alias("n_new")))


@query("""WITH a AS (SELECT l_orderkey, list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1),
          d AS (SELECT l_orderkey, q, list_transform(range(1, len(q)), lambda i: q[i + 1] - q[i]) AS d FROM a),
          s AS (SELECT *, list_transform(list_filter(d, lambda x: x <> 0), lambda x: sign(x)) AS s FROM d)
          SELECT l_orderkey, coalesce(list_sum(list_transform(d, lambda x: abs(x))), 0)::BIGINT AS path, len(list_filter(range(1, len(s)), lambda i: s[i + 1] <> s[i])) AS turns,
          (len(list_filter(d, lambda x: x < 0)) = 0 OR len(list_filter(d, lambda x: x > 0)) = 0) AS monotone FROM s""")
def sequence_features(t):
    a = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))), lambda x: x["q"]).alias("q"))
    path = F.aggregate(S.differences(F.col("q")), F.lit(0).cast("long"), lambda s, x: s + F.abs(x).cast("long"))
    return a.select("l_orderkey", path.alias("path"), S.sign_changes(F.col("q")).alias("turns"), S.is_monotone(F.col("q")).alias("monotone"))


@query("""WITH a AS (SELECT c_custkey, radians(c_custkey % 180 - 90) AS y1, radians(c_custkey % 360 - 180) AS x1, radians((c_custkey * 7) % 180 - 90) AS y2, radians((c_custkey * 13) % 360 - 180) AS x2 FROM customer)
          SELECT c_custkey, round(2 * 6371 * asin(sqrt(least(1, sin((y2 - y1) / 2) ** 2 + cos(y1) * cos(y2) * sin((x2 - x1) / 2) ** 2))) + 1e-7, 3) AS km FROM a""")
def geo_distance(t):
    at = lambda k, m, h: (F.pmod(F.col("c_custkey") * k, F.lit(m)) - h).cast("double")
    return t("customer").select("c_custkey", up(S.haversine(at(1, 180, 90), at(1, 360, 180), at(7, 180, 90), at(13, 360, 180)), 3).alias("km"))


@query("""SELECT o_custkey, string_agg(o_orderkey, ' ' ORDER BY o_totalprice DESC, o_orderkey) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5 GROUP BY 1""")
def best_labels(t):
    return N.best_of(t("orders"), "o_custkey", "o_orderkey", "o_totalprice", 5)


@query("""WITH a AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), b AS (SELECT s_suppkey AS k, s_acctbal * 2 + s_suppkey AS v FROM supplier)
          SELECT a.k, round((a.v + 3 * b.v) / 4 + 1e-7, 4) AS v FROM a JOIN b USING (k)""")
def blended_predictions(t):
    a = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    b = t("supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") * 2 + F.col("s_suppkey")).alias("v"))
    return M.blend([a, b], "k", "v", weights=[1.0, 3.0]).select("k", up("v").alias("v"))


@query("""WITH s AS (SELECT user_id, event_type AS giver, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS taker FROM events)
          SELECT giver, taker, count(*) AS n_edges, count(DISTINCT user_id) AS n_pipelines FROM s WHERE taker IS NOT NULL GROUP BY 1, 2""")
def service_graph(t):
    """Every user's events as a pipeline of steps, of which each takes what the one before has made."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = t("events").select(F.col("user_id").alias("pipeline"), F.row_number().over(w).alias("step"), F.col("event_type").alias("operator"))
    name = lambda i: F.array(F.concat(F.lit("made"), i))
    return catalog.service_graph(steps.withColumns({"inputs": name(F.col("step") - 1), "outputs": name(F.col("step"))}))


def _labelled(t) -> DataFrame:
    """Orders with numeric features and whether they are finished."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("discount"))
    orders = t("orders").select("o_orderkey", "o_totalprice", F.datediff("o_orderdate", F.lit("1995-01-01")).alias("age"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return P.folded(orders.join(lines, "o_orderkey"), "o_orderkey", 3)


@query()
def ml_logistic_out_of_fold(t):
    return M.out_of_fold(_labelled(t), ["o_totalprice", "age", "n", "discount"], "y", "logistic", "fold", 3, ["o_orderkey", "y"], maxIter=20)


@query()
def ml_forest(t):
    df = saved(_labelled(t), "rows")
    model = M.train(df.filter("fold > 0"), ["o_totalprice", "age", "n", "discount"], "y", "forest", numTrees=10, maxDepth=5)
    return M.predict(model, df.filter("fold = 0"), ["o_orderkey", "y"])


@query()
def ml_kmeans(t):
    return M.cluster(_labelled(t), ["o_totalprice", "age", "n"], "kmeans", 4, ["o_orderkey"])


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax + 1e-7, 4) AS a, round(0.5 * l_quantity + 2 * l_discount + 1e-7, 4) AS b, CAST(l_discount > 0.05 AS INT) AS hot, round(l_quantity * l_discount + 1e-7, 4) AS l_quantity_multiply_l_discount,
          round(l_quantity ** 2, 4) AS l_quantity_pow_2, l_returnflag || '_' || l_linestatus AS crossed, round(cbrt(l_extendedprice) + 1e-7, 4) AS l_extendedprice_cbrt FROM lineitem""")
def configured_features(t):
    config = [
        {"name": "a", "kind": "sum", "columns": ["l_quantity", "l_tax"]},
        {"name": "b", "kind": "weighted", "columns": ["l_quantity", "l_discount"], "weights": [0.5, 2]},
        {"name": "hot", "kind": "threshold", "columns": ["l_discount"], "value": 0.05},
        {"name": "crossed", "kind": "cross", "columns": ["l_returnflag", "l_linestatus"]},
    ]
    df = X.engineer(t("lineitem"), config)
    df = X.transform(X.polynomials(X.interactions(df, [("l_quantity", "l_discount")], ["multiply"]), ["l_quantity"], 2), ["l_extendedprice"], "cbrt")
    return df.select("l_orderkey", "l_linenumber", up("a").alias("a"), up("b").alias("b"), "hot", up("l_quantity_multiply_l_discount").alias("l_quantity_multiply_l_discount"), r("l_quantity_pow_2").alias("l_quantity_pow_2"), "crossed", up("l_extendedprice_cbrt").alias("l_extendedprice_cbrt"))


@query("""SELECT p_partkey, CASE WHEN p_size >= p_retailprice / 50 AND p_size >= 20 THEN 'size' WHEN p_retailprice / 50 >= 20 THEN 'price' ELSE 'none' END AS label FROM part""")
def labels_from_scores(t):
    df = t("part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 50).alias("b"), F.lit(20.0).alias("c"))
    return X.labels_from_scores(df, ["a", "b", "c"], "label", ["size", "price", "none"]).select("p_partkey", "label")


@query("SELECT p_partkey, '[p_name] ' || p_name || ' [p_brand] ' || p_brand AS text FROM part")
def combined_text(t):
    return X.combine_text(t("part"), ["p_name", "p_brand"], "text", prefix=True).select("p_partkey", "text")


@query("""WITH a AS (SELECT o_orderkey, 0.20439731 + date_diff('day', DATE '2001-01-01', CAST(o_orderdate AS DATE)) * 0.03386319269 AS p FROM orders)
          SELECT o_orderkey, CAST(floor((CAST(p AS DOUBLE) - floor(CAST(p AS DOUBLE))) * 8 + 0.5) AS INT) % 8 AS moon FROM a""")
def lunar_days(t):
    return t("orders").select("o_orderkey", X.lunar_day(day("o_orderdate")).alias("moon"))


@query(f"""WITH {DAILY} SELECT l_suppkey, CAST(d AS VARCHAR) AS d, round(avg(v) OVER a + 1e-7, 4) AS m, round(var_samp(v) OVER a + 1e-7, 4) AS s FROM daily WINDOW a AS (PARTITION BY l_suppkey, isodow(d) ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def cumulative_by_weekday(t):
    df = X.cumulative_by(_daily(t).withColumn("dow", F.weekday("d")), "v", ["l_suppkey", "dow"], ["d"])
    return df.select("l_suppkey", F.col("d").cast("string").alias("d"), up("v_so_far_mean").alias("m"), up("v_so_far_var").alias("s"))


@query("""WITH m AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS m FROM orders GROUP BY ALL), l AS (SELECT k, d, lag(m, 7) OVER (PARTITION BY k ORDER BY d) AS x FROM m)
          SELECT o_orderkey, round(x + 1e-7, 2) AS lag7 FROM orders JOIN l ON o_orderpriority = k AND CAST(o_orderdate AS DATE) = d""")
def level_lags(t):
    df = X.level_lags(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", day("o_orderdate").alias("d")), "o_totalprice", "d", [["o_orderpriority"]], [7])
    return df.select("o_orderkey", up("o_totalprice_o_orderpriority_lag_7", 2).alias("lag7"))


@query("""WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS i FROM supplier), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part)
          SELECT s_suppkey, p_partkey FROM a JOIN b USING (i)""")
def positional_match(t):
    return X.match_by_position(t("supplier").select("s_suppkey", "s_acctbal"), t("part").select("p_partkey", "p_retailprice"), ["s_acctbal", "s_suppkey"], [F.desc("p_retailprice"), "p_partkey"]).select("s_suppkey", "p_partkey")


@query()
def ml_principal_components(t):
    return X.principal_components(_labelled(t), ["o_totalprice", "age", "n", "discount"], 2, ["o_orderkey"], whiten=True)

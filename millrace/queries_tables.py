"""Further queries with SQL twins: scans and sinks, row expressions, joins, sets, splits and folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import entities as N
from .operators import order as O
from .operators import prepare as P
from .operators import relational as R
from .operators import windows as W
from .queries import DAILY, HASH, QUERIES, SQL, _daily, day, query, r, up
from .sources import scratch
from .sources import tables as D
from .sources.tables import table


def stored(sql: str):
    """Register a function of (spark, folder of the tables, table loader): it reads or writes files itself."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir, lambda name: table(spark, sf_dir, name))
        SQL[f.__name__] = sql
        return f

    return add


def _round_trip(df: DataFrame, fmt: str, schema: str, suffix: str = "", **options) -> DataFrame:
    """Write a table and read it back, in the shared folder."""
    at = scratch.place(df.sparkSession, f"scan-{fmt}") + suffix
    D.save(df, at, fmt, **options)
    return D.load(df.sparkSession, at, fmt, schema=schema)


# Scans and sinks

@stored("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_csv(spark, sf_dir, t):
    return _round_trip(t("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "csv", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@stored("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_tsv(spark, sf_dir, t):
    return _round_trip(t("nation").select("n_nationkey", "n_name", "n_regionkey"), "tsv", "n_nationkey int, n_name string, n_regionkey int")


@stored("SELECT page_id, md5(html) AS digest FROM pages")
def scan_json_lines(spark, sf_dir, t):
    return _round_trip(t("pages").select("page_id", "html"), "jsonl", "page_id long, html string").select("page_id", F.md5("html").alias("digest"))


@stored("SELECT c_custkey, c_name FROM customer")
def scan_json(spark, sf_dir, t):
    """One JSON document with an array of records a file."""
    at = scratch.place(spark, "scan-json")
    rows = t("customer").select(F.struct("c_custkey", "c_name").alias("r"), F.pmod("c_custkey", F.lit(8)).alias("file"))
    rows.groupBy("file").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("file").text(at)
    return D.load(spark, at, "json", schema="c_custkey long, c_name string").select("c_custkey", "c_name")


@stored("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def scan_gzip_head(spark, sf_dir, t):
    """Compressed CSV, of which the first rows of an order are kept: the cap is the feature."""
    df = _round_trip(t("part").select("p_partkey", "p_name"), "csv", "p_partkey long, p_name string", compression="gzip")
    return df.orderBy("p_partkey").limit(100)


@stored("SELECT r_regionkey, r_name, 'region' AS kind FROM region UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def scan_folder(spark, sf_dir, t):
    """A folder whose subfolders are entities: the row's file says which."""
    at = scratch.place(spark, "folder")
    for name, k in (("region", "r"), ("nation", "n")):
        D.save(t(name).select(F.col(f"{k}_{name}key").cast("int").alias("key"), F.col(f"{k}_name").alias("name")), f"{at}/{name}", "csv")
    df = spark.read.schema("key int, name string").option("header", "true").csv(f"{at}/*")
    return df.select(F.col("key").alias("r_regionkey"), F.col("name").alias("r_name"), F.element_at(F.split(F.input_file_name(), "/"), -2).alias("kind"))


@stored("SELECT CAST(count(DISTINCT n_regionkey) AS INT) AS n_files, 'csv' AS suffix, true AS has_bytes FROM nation")
def file_inventory(spark, sf_dir, t):
    """Nations in a file for each region."""
    at = scratch.place(spark, "inventory")
    t("nation").coalesce(1).write.partitionBy("n_regionkey").csv(at)
    return D.inventory(spark, at, "*.csv").groupBy("suffix").agg(F.count("*").cast("int").alias("n_files"), (F.min("length") > 0).alias("has_bytes")).select("n_files", "suffix", "has_bytes")


@stored("SELECT n_name AS name, length(n_name) AS length FROM nation")
def scan_named_files(spark, sf_dir, t):
    """A custom connector: a row for each file, by name and size; here the files hold the names themselves."""

    def write(df, path, options):
        df.select("name", "body").write.partitionBy("name").mode("overwrite").text(path)

    def read(spark_, path, options):
        files = D.load(spark_, path, "binary", pathGlobFilter="*.txt")
        return files.select(F.regexp_extract("path", r"name=([^/]*)/", 1).alias("name"), (F.length("content") - 1).alias("length"))

    D.register("named files", read, write)
    at = scratch.place(spark, "named")
    D.save(t("nation").select(F.col("n_name").alias("body"), F.col("n_name").alias("name")), at, "named files")
    return D.load(spark, at, "named files").select("name", "length")


# Projection and filters

@query("""SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS level, try_cast(o_orderpriority AS DOUBLE) AS none, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT) AS cust FROM orders""")
def coerced_casts(t):
    cust = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string"))
    return t("orders").select("o_orderkey", S.coerced(F.substring("o_orderpriority", 1, 1), "int").alias("level"), S.coerced(F.col("o_orderpriority")).alias("none"), S.coerced(cust, "bigint").alias("cust"))


@query("SELECT l_orderkey, l_linenumber, l_discount, round(l_discount + l_tax + 1e-7, 4) AS total FROM lineitem")
def prefix_columns(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("rate_discount"), F.col("l_tax").alias("rate_tax"))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in R.with_prefix(df, "rate_")))
    return df.select("l_orderkey", "l_linenumber", F.col("rate_discount").alias("l_discount"), up(total).alias("total"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, o_totalprice AS x FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 4 <> 0")
def null_filter(t):
    df = t("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("x"))
    return R.complete(df, ["s", "x"])


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_discount * 100, l_tax * 100, CAST(l_linenumber AS DOUBLE), CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice / 1000 END] AS v FROM lineitem),
          b AS (SELECT *, list_filter(v, lambda x: x IS NOT NULL) AS w FROM a)
          SELECT l_orderkey, l_linenumber, round(list_stddev_samp(w) + 1e-7, 4) AS std, list_min(w) AS low, len(v) - len(w) AS missing, len(list_filter(w, lambda x: x <> 0)) AS nonzero,
          round(coalesce(list_kurtosis(w), 0) + 1e-7, 3) AS kurt FROM b""")
def row_statistics_more(t):
    cols = {"a": F.col("l_quantity"), "b": F.col("l_discount") * 100, "c": F.col("l_tax") * 100, "d": F.col("l_linenumber").cast("double"), "e": F.when(F.col("l_partkey") % 3 != 0, F.col("l_extendedprice") / 1000)}
    df, c = t("lineitem").select("l_orderkey", "l_linenumber", *(v.alias(n) for n, v in cols.items())), list(cols)
    return df.select("l_orderkey", "l_linenumber", up(S.row_std(c)).alias("std"), S.row_min(c).alias("low"), S.row_missing(c).alias("missing"), S.row_nonzero(c).alias("nonzero"), up(S.row_kurtosis(c), 3).alias("kurt"))


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS position FROM orders""")
def sorted_orders(t):
    """Every order's place by several keys, without one task for all of them."""
    df = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return O.numbered(df, ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "o_custkey", "position")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 2")
def last_rows(t):
    return R.last_per_group(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("""WITH a AS (SELECT p_partkey, [struct_pack(s := -CAST(p_size AS DOUBLE), n := 'size'), struct_pack(s := -p_retailprice / 40, n := 'price'), struct_pack(s := -CAST(p_partkey % 37 AS DOUBLE), n := 'key')] AS v FROM part)
          SELECT p_partkey, array_to_string(list_transform(list_sort(v)[1:2], lambda x: x.n), ' ') AS best FROM a""")
def best_columns(t):
    scores = {"size": F.col("p_size").cast("double"), "price": F.col("p_retailprice") / 40, "key": (F.col("p_partkey") % 37).cast("double")}
    return t("part").select("p_partkey", S.row_top_k(scores, 2).alias("best"))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
          SELECT o_orderkey, i > (SELECT count(*) FROM orders) - 1000 AS held_out FROM n""")
def positional_parts(t):
    past, last = O.positional_split(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 1000)
    return past.select("o_orderkey", F.lit(False).alias("held_out")).unionAll(last.select("o_orderkey", F.lit(True).alias("held_out")))


# Sets and reshaping

@query("SELECT s_name AS name, s_acctbal AS acctbal FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer")
def union_on_common_columns(t):
    a = t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), "s_suppkey")
    return R.union_common(a, t("customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_name").alias("name"), "c_mktsegment"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, month(l_shipdate) AS month FROM lineitem")
def distinct_rows(t):
    return t("lineitem").select("l_returnflag", "l_linestatus", F.month("l_shipdate").alias("month")).dropDuplicates()


@query("SELECT (SELECT count(*) FROM customer) AS n_own, (SELECT count(*) FROM supplier) AS n_rest, round((SELECT sum(c_acctbal) FROM customer), 2) AS total")
def split_back(t):
    both = R.union_all(t("customer").select(F.col("c_acctbal").alias("bal")), t("supplier").select(F.col("s_acctbal").alias("bal")), marker="part")
    own, rest = R.split_by_marker(both, "part", 0)
    return own.agg(F.count("*").alias("n_own"), r(F.sum("bal"), 2).alias("total")).crossJoin(rest.agg(F.count("*").alias("n_rest"))).select("n_own", "n_rest", "total")


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, nullif(split_part(o_orderpriority, '-', 2), '') AS word, CAST(NULL AS VARCHAR) AS rest FROM orders")
def split_cells(t):
    df = R.split_column(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", ["level", "word", "rest"])
    return df.select("o_orderkey", "level", F.nullif("word", F.lit("")).alias("word"), "rest")


@query("""SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_' || k AS id_target, v AS target FROM
          (SELECT l_orderkey, l_linenumber, 'quantity' AS k, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem)""")
def unpivot_targets(t):
    df = t("lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return R.melt(df, ["id"], ["quantity", "tax"], "k", "target").select(F.concat_ws("_", "id", "k").alias("id_target"), "target")


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{8,}')) AS word FROM benchmark) SELECT doc_id, word FROM documents JOIN w ON contains(text, word)""")
def word_mentions(t):
    """Hundreds of labels: texts and labels meet in an equi-join on the first characters."""
    words = t("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{8,})"), F.lit(1))).alias("word"))
    return R.mentions(t("documents").select("doc_id", "text"), "text", words, "word", few=0).select("doc_id", "word")


# Windows and dates

@query(f"WITH {DAILY} SELECT l_suppkey, CAST(d AS VARCHAR) AS d, round(avg(v) OVER a + 1e-7, 4) AS m, max(v) OVER a AS x FROM daily WINDOW a AS (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def rolling_unshifted(t):
    df = W.rolling(_daily(t), "v", ["l_suppkey"], ["d"], [7], ["mean", "max"], shift=0)
    return df.select("l_suppkey", F.col("d").cast("string").alias("d"), up("v_roll_mean_7").alias("m"), F.col("v_roll_max_7").alias("x"))


@query("SELECT o_orderkey, count(*) OVER w AS n, CAST(count(*) OVER w = 1 AS INT) AS alone FROM orders WINDOW w AS (PARTITION BY o_custkey, CAST(o_orderdate AS DATE))")
def group_size_flag(t):
    df = t("orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("d"))
    return R.join_back(df, ["o_custkey", "d"], {"n": F.count("*")}).select("o_orderkey", "n", (F.col("n") == 1).cast("int").alias("alone"))


@query("""SELECT o_orderkey, 12 * (year(o_orderdate) - 1992) + month(o_orderdate) - 1 AS months_open,
          date_diff('day', make_date(year(o_orderdate), 4, 1), CAST(o_orderdate AS DATE)) AS since_april FROM orders""")
def months_open(t):
    d = day("o_orderdate")
    return t("orders").select("o_orderkey", S.months_between_starts(d, F.lit("1992-01-01").cast("date")).alias("months_open"), (-S.days_to(d, 4, 1)).alias("since_april"))


_EASTER = """y % 19 AS a, y // 100 AS b, y % 100 AS c"""


@query(f"""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), p AS (SELECT y, {_EASTER} FROM y),
           q AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM p), s AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM q),
           m AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM s)
           SELECT o_orderkey, date_diff('day', make_date(y, CAST(n // 31 AS BIGINT), CAST(n % 31 + 1 AS BIGINT)), CAST(o_orderdate AS DATE)) AS from_easter FROM orders JOIN m ON year(o_orderdate) = y""")
def easter_offsets(t):
    d = day("o_orderdate")
    return t("orders").select("o_orderkey", F.datediff(d, S.easter(F.year(d))).alias("from_easter"))


@query("""SELECT o_orderkey, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, CAST(month(ts) IN (1, 4, 7, 10) AND day(ts) = 1 AS INT) AS is_quarter_start
          FROM (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey * 37 % 86400) AS ts FROM orders)""")
def clock_parts(t):
    ts = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 37 % 86400)
    df = t("orders").select("o_orderkey", ts.alias("ts"))
    return df.select("o_orderkey", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"), F.second("ts").alias("second"), ((F.dayofmonth("ts") == 1) & F.month("ts").isin(1, 4, 7, 10)).cast("int").alias("is_quarter_start"))


# Places, arrays, JSON and text

@query("""WITH a AS (SELECT c_custkey, CAST(c_custkey % 180 - 90 AS DOUBLE) AS y1, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x1, CAST((c_custkey * 7) % 180 - 90 AS DOUBLE) AS y2, CAST((c_custkey * 13) % 360 - 180 AS DOUBLE) AS x2 FROM customer)
          SELECT c_custkey, round(degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) + 1e-7, 4) AS bearing,
          round(x1 * cos(radians(30)) - y1 * sin(radians(30)) + 1e-7, 4) AS turned_x, round(x1 * sin(radians(30)) + y1 * cos(radians(30)) + 1e-7, 4) AS turned_y,
          CAST(CAST(floor(x1 / 7.5) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(y1 / 7.5) AS BIGINT) AS VARCHAR) AS cell FROM a""")
def geo_features(t):
    at = lambda k, m, h: (F.pmod(F.col("c_custkey") * k, F.lit(m)) - h).cast("double")
    df = t("customer").select("c_custkey", at(1, 180, 90).alias("y1"), at(1, 360, 180).alias("x1"), at(7, 180, 90).alias("y2"), at(13, 360, 180).alias("x2"))
    x, y = S.rotated(F.col("x1"), F.col("y1"), 30)
    return df.select("c_custkey", up(S.bearing(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))).alias("bearing"), up(x).alias("turned_x"), up(y).alias("turned_y"), S.grid_cell(F.col("x1"), F.col("y1"), 7.5).alias("cell"))


_SEQUENCES = "a AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1)"


def _sequences(t) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q"))))
    return t("lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["q"]).alias("q"))


@query(f"""WITH {_SEQUENCES}, d AS (SELECT *, list_transform(range(1, len(q)), lambda i: q[i + 1] - q[i]) AS d FROM a), e AS (SELECT *, list_transform(range(1, len(d)), lambda i: d[i + 1] - d[i]) AS e FROM d)
           SELECT l_orderkey, list_reduce(list_prepend(CAST(0 AS BIGINT), q), lambda x, y: gcd(x, y)) AS gcd, coalesce(q[-1], 0) AS last1, coalesce(q[-2], 0) AS last2, coalesce(q[-9], 0) AS last9, coalesce(list_sum(e), 0)::BIGINT AS second,
           (len(d) >= 3 AND len(list_distinct(d)) = 1) AS linear, round(list_avg(list_transform(range(1, len(q)), lambda i: q[i + 1] / CAST(q[i] AS DOUBLE))) + 1e-7, 4) AS ratio FROM e""")
def sequence_properties(t):
    q = F.col("q")
    last, second, rates = S.last_elements(q, 9), S.repeated_differences(q, 2), S.ratios(q)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    mean = F.try_divide(F.aggregate(rates, F.lit(0.0), lambda s, x: s + x), F.size(rates))
    return _sequences(t).select("l_orderkey", S.greatest_common_divisor(q, 16).alias("gcd"), last[0].alias("last1"), last[1].alias("last2"), last[8].alias("last9"), total(second).alias("second"), S.is_constant(S.differences(q)).alias("linear"), up(mean).alias("ratio"))


@query("""WITH n AS (SELECT n_regionkey AS k, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1)
          SELECT k, len(names) AS n_items, array_to_string(names[1:3], '|') AS top, CAST(list_contains(names, 'FRANCE') AS INT) AS has_france, CAST(list_contains(names, 'CHINA') AS INT) AS has_china FROM n""")
def json_items(t):
    """Cells that hold a list of dictionaries as text."""
    item = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    cells = t("nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("cell"))
    df = cells.select("k", S.json_names(F.col("cell")).alias("names"))
    has = lambda v: F.array_contains("names", v).cast("int")
    return df.select("k", F.size("names").alias("n_items"), F.array_join(F.slice("names", 1, 3), "|").alias("top"), has("FRANCE").alias("has_france"), has("CHINA").alias("has_china"))


@query("""WITH a AS (SELECT unnest(n.names) AS name FROM (SELECT list(p_brand) AS names FROM part GROUP BY p_type) n) SELECT name, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, name LIMIT 10""")
def json_top_names(t):
    """The most frequent names over all cells: a top-k report."""
    cells = t("part").groupBy("p_type").agg(F.to_json(F.collect_list(F.struct(F.col("p_brand").alias("name")))).alias("cell"))
    return cells.select(F.explode(S.json_names(F.col("cell"))).alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)


@query("""SELECT event_id, user_id AS user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC' AS VARCHAR) AS at FROM events""")
def json_normalised(t):
    """Nested records flattened to dotted names, and a time in unix seconds."""
    nested = t("events").select(F.to_json(F.struct("event_id", F.struct("user_id", F.from_json("props", "k bigint").alias("props")).alias("user"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))).alias("cell"))
    df = S.flattened(nested.select(F.from_json("cell", "event_id long, user struct<user_id: long, props: struct<k: bigint>>, at long").alias("r")).select("r.*"))
    return df.select("event_id", F.col("`user.user_id`").alias("user_id"), F.col("`user.props.k`").alias("k"), F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT conv_id, turn, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'qwertyuiopasdfghjklzxcvbnm')) AS digest FROM conversations")
def substituted_text(t):
    return t("conversations").select("conv_id", "turn", F.md5(S.substituted(F.col("text"), "abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm")).alias("digest"))


# Splits and folds

@query(f"SELECT o_orderkey, {HASH.format('o_orderkey')} < {int(0.2 * (1 << 32))} AS sampled FROM orders")
def random_parts(t):
    rest, sample = P.random_split(t("orders").select("o_orderkey"), "o_orderkey", 0.2)
    return rest.withColumn("sampled", F.lit(False)).unionAll(sample.withColumn("sampled", F.lit(True)))


_STRATA = f"n AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH.format('o_orderkey')}, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS m FROM orders)"


@query(f"WITH {_STRATA} SELECT o_orderkey, o_orderstatus, i < floor(0.2::DOUBLE * m) AS sampled FROM n")
def stratified_parts(t):
    return O.stratified_split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.2)


@query(f"WITH {_STRATA} SELECT o_orderkey, o_orderstatus, CAST(i % 5 AS INT) AS fold FROM n")
def folds_by_stratum(t):
    return O.stratified_folds(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5)


@query(f"""WITH n AS (SELECT vec_id, label, row_number() OVER (ORDER BY {HASH.format('vec_id')}, vec_id) AS i FROM embeddings)
           SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON b.i BETWEEN a.i + 1 AND a.i + 3 WHERE a.label <> b.label""")
def pairs_of_other_labels(t):
    return O.negative_pairs(t("embeddings"), "vec_id", "label", 3)


@query("""SELECT 'past' AS part, count(*) AS n FROM events WHERE ts < DATE '2024-01-20' UNION ALL SELECT 'rest', count(*) FROM events WHERE ts >= DATE '2024-01-13'""")
def buffered_parts(t):
    past, rest = N.buffered_split(t("events"), "ts", "2024-01-20", 7)
    return past.agg(F.lit("past").alias("part"), F.count("*").alias("n")).unionAll(rest.agg(F.lit("rest").alias("part"), F.count("*").alias("n")))



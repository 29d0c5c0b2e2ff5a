"""Further queries with SQL twins: clusters, neighbours, sequences, and what is near in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import holidays as H
from .operators import asof as B
from .operators import ciphers as C
from .operators import density as D
from .operators import forecasting as G
from .operators import gram as K
from .operators import linkage as L
from .operators import sequences as Q
from .queries import DAILY, _daily, day, query, up
from .queries_tables import stored
from .sources import connector, scratch, tables
from .streaming import keyed

# Clusters

_PLANE = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"


@query(f"""WITH RECURSIVE p AS ({_PLANE}), near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= CAST(0.03 AS DOUBLE) * CAST(0.03 AS DOUBLE)),
           core AS MATERIALIZED (SELECT a FROM near GROUP BY a HAVING count(*) >= 6), link AS MATERIALIZED (SELECT near.a, near.b FROM near JOIN core x ON x.a = near.a JOIN core y ON y.a = near.b),
           reach AS (SELECT a, a AS c FROM core UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.a), own AS (SELECT a, min(c) AS cluster FROM reach GROUP BY a),
           border AS (SELECT near.a, min(own.cluster) AS cluster FROM near JOIN own ON own.a = near.b GROUP BY near.a)
           SELECT vec_id, cluster, vec_id IN (SELECT a FROM core) AS core FROM p LEFT JOIN border ON a = vec_id""")
def density_clusters(t):
    """Two components of every vector, clustered by density."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return D.dbscan(t("embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y")), "vec_id", ["x", "y"], 0.03, 6)


@query("""WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, s_suppkey, s_acctbal / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),
           d AS MATERIALIZED (SELECT a.i AS a, b.i AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w FROM p a, p b WHERE a.i <> b.i),
           grown AS (SELECT [CAST(1 AS BIGINT)] AS seen, 0 AS step, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS DOUBLE) AS w
                     UNION ALL SELECT list_append(seen, e.o), step + 1, e.a, e.b, e.w
                     FROM (SELECT any_value(seen) AS seen, any_value(step) AS step, min({'w': d.w, 'a': least(d.a, d.b), 'b': greatest(d.a, d.b), 'o': d.b}) AS e FROM grown, d WHERE list_contains(seen, d.a) AND NOT list_contains(seen, d.b)) WHERE e IS NOT NULL),
           short AS (SELECT a, b FROM (SELECT *, row_number() OVER (ORDER BY w, a, b) AS n FROM grown WHERE step > 0) WHERE n <= (SELECT count(*) - 8 FROM p)),
           link AS MATERIALIZED (SELECT a, b FROM short UNION ALL SELECT b, a FROM short), reach AS (SELECT i, i AS c FROM p UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.i)
           SELECT p.s_suppkey, min(q.s_suppkey) AS cluster FROM reach JOIN p USING (i) JOIN p q ON q.i = reach.c GROUP BY 1""")
def linkage_clusters(t):
    """Eight groups of suppliers by balance and nation, nearest groups joined first."""
    at = t("supplier").select("s_suppkey", F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("v"))
    return L.single_linkage(at, "s_suppkey", "v", 8)


# Sequences

_TERMS = """q AS (SELECT l_orderkey AS id, list(CAST(l_quantity AS HUGEINT) ORDER BY l_linenumber, l_quantity) AS s FROM lineitem GROUP BY 1
                  UNION ALL SELECT -p_partkey, [p_size, p_size % 7, 3 * (p_size % 7) + 2 * p_size, 11 * (p_size % 7) + 6 * p_size, 39 * (p_size % 7) + 22 * p_size, 139 * (p_size % 7) + 78 * p_size]::HUGEINT[] FROM part)"""


@query(f"""WITH {_TERMS}, k AS (SELECT id, s, len(s) AS n, s[2] * s[2] - s[1] * s[3] AS d, s[3] * s[2] - s[1] * s[4] AS c1, s[2] * s[4] - s[3] * s[3] AS c2 FROM q),
           o AS (SELECT *, CASE WHEN len(list_filter(s, lambda x: x <> 0)) = 0 THEN 0 WHEN n >= 3 AND s[1] <> 0 AND len(list_filter(range(2, n + 1), lambda i: s[i] * s[1] <> s[i - 1] * s[2])) = 0 THEN 1
                                WHEN n >= 5 AND d <> 0 AND len(list_filter(range(3, n + 1), lambda i: d * s[i] <> c1 * s[i - 1] + c2 * s[i - 2])) = 0 THEN 2 END AS ord FROM k),
           f AS (SELECT id, ord, n, CASE ord WHEN 1 THEN s[2] WHEN 2 THEN c1 ELSE 0 END AS a, CASE ord WHEN 2 THEN c2 ELSE 0 END AS b, CASE ord WHEN 1 THEN s[1] WHEN 2 THEN d ELSE 1 END AS w, s[n] AS y, s[n - 1] AS z FROM o),
           g AS (SELECT id, ord, [a, b][1:ord] AS c, w, a * y + b * z AS top FROM f)
           SELECT id, CAST(ord AS INTEGER) AS recurrence_order, array_to_string(list_transform(c, lambda x: CASE WHEN x % w = 0 THEN CAST(CAST(x / w AS HUGEINT) AS VARCHAR)
                  ELSE CAST(CAST(sign(w) * x / greatest(gcd(x, w), 1) AS HUGEINT) AS VARCHAR) || '/' || CAST(CAST(abs(w) / gcd(x, w) AS HUGEINT) AS VARCHAR) END), ',') AS coefficients, CASE WHEN top % w = 0 THEN CAST(CAST(top / w AS HUGEINT) AS VARCHAR) END AS following FROM g WHERE ord IS NOT NULL
           UNION ALL SELECT id, NULL, NULL, NULL FROM g WHERE ord IS NULL""")
def sequence_recurrences(t):
    """Quantities of every order's lines, and six terms of s(n) = 3 s(n - 1) + 2 s(n - 2) from every part's size on; orders of two at most."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"].cast("long")).alias("s"))
    start = F.array(F.col("p_size").cast("long"), (F.col("p_size") % 7).cast("long"))
    step = lambda s, _: F.concat(s, F.array(3 * F.element_at(s, -1) + 2 * F.element_at(s, -2)))
    planted = t("part").select((-F.col("p_partkey")).alias("id"), F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step).alias("s"))
    found = lines.unionAll(planted).select("id", Q.recurrences("s", most=2).alias("r"))
    return found.select("id", F.col("r.order").alias("recurrence_order"), F.array_join("r.coefficients", ",").alias("coefficients"), F.col("r.next").alias("following"))


_ORDERS_OF = "SELECT c_custkey, c_mktsegment, list(o_orderpriority[1:1] ORDER BY o_orderdate, o_orderkey) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"


@query(f"""WITH a AS ({_ORDERS_OF}), t AS (SELECT s, array_to_string(s, '') AS x FROM a WHERE c_mktsegment <> 'BUILDING'), q AS (SELECT c_custkey, array_to_string(s, '') AS x FROM a WHERE c_mktsegment = 'BUILDING'),
           e AS (SELECT left(x, CAST(i AS INTEGER)) AS p, i AS length, x[i + 1] AS follows, count(*) AS n FROM t, range(0, length(x)) AS r(i) GROUP BY 1, 2, 3), k AS (SELECT p, length, sum(n) AS n, min({{'n': -n, 'f': follows}}).f AS follows FROM e GROUP BY 1, 2)
           SELECT c_custkey, CAST(k.length AS INTEGER) AS length, CAST(k.n AS BIGINT) AS n, k.follows FROM q JOIN k ON starts_with(q.x, k.p) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY k.length DESC) = 1""")
def prefix_continuations(t):
    """How customers of other segments went on after what a customer's orders of one segment begin with, by the priorities of their orders in time."""
    rows = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", "c_mktsegment")
    found = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p")))), lambda x: x["p"]).alias("s"))
    own = F.col("c_mktsegment") == "BUILDING"
    return Q.longest_prefix(found.filter(own), found.filter(~own), "c_custkey", "s").select("c_custkey", "length", "n", F.col("next").alias("follows"))


# Time

_RULED = ", ".join(f"('{c}', '{n}', {'NULL, NULL, ' + str(rule) if isinstance(rule, int) else f'{rule[0]}, {rule[1]}, NULL'})" for c, n, rule in H.PUBLIC)
_HOLIDAYS = f"""years AS (SELECT DISTINCT unnest([year(o_orderdate) - 1, year(o_orderdate), year(o_orderdate) + 1]) AS y FROM orders), e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
           e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1), e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
           e4 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e3), e5 AS (SELECT y, make_date(y, CAST(n // 31 AS BIGINT), CAST(n % 31 + 1 AS BIGINT)) AS easter FROM e4),
           hol AS (SELECT country, name, CASE WHEN away IS NULL THEN make_date(y, m, d) ELSE CAST(easter + away AS DATE) END AS date FROM e5, (VALUES {_RULED}) AS r(country, name, m, d, away)),
           one AS (SELECT country, date, min(name) AS name FROM hol GROUP BY 1, 2)"""


@query(f"""WITH {_HOLIDAYS}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ['BE', 'DE', 'ES', 'FR', 'IT', 'PL'][o_custkey % 6 + 1] AS country FROM orders)
           SELECT o.o_orderkey, date_diff('day', b.date, o.d) AS since, b.name AS last_holiday, date_diff('day', o.d, a.date) AS until, a.name AS next_holiday, CAST(b.date = o.d AS INT) AS is_holiday, CAST(date_diff('day', b.date, o.d) <= 2 OR date_diff('day', o.d, a.date) <= 2 AS INT) AS near
           FROM o ASOF LEFT JOIN one b ON o.country = b.country AND o.d >= b.date ASOF LEFT JOIN one a ON o.country = a.country AND o.d <= a.date""")
def holiday_windows(t):
    """The last public holiday and the next one about every order, in the country that its customer's number stands for."""
    countries = F.array(*(F.lit(c) for c in ("BE", "DE", "ES", "FR", "IT", "PL")))
    orders = t("orders").select("o_orderkey", day("o_orderdate").alias("d"), F.get(countries, (F.col("o_custkey") % 6).cast("int")).alias("country"))
    year = F.year("d")
    known = H.holidays(orders.select(F.explode(F.array(year - 1, year, year + 1)).alias("year")))
    df = B.around(orders, "d", known, "date", ["country"], ["name"])
    since, until = F.datediff("d", "before.date"), F.datediff("after.date", "d")
    return df.select("o_orderkey", since.cast("long").alias("since"), F.col("before.name").alias("last_holiday"), until.cast("long").alias("until"), F.col("after.name").alias("next_holiday"), (since == 0).cast("int").alias("is_holiday"), ((since <= 2) | (until <= 2)).cast("int").alias("near"))


# Fits

_CHAIN = "".join(
    f""", w{i} AS (SELECT regr_slope(q, fp) FILTER (q IS NOT NULL) AS qs, regr_intercept(q, fp) FILTER (q IS NOT NULL) AS qi, regr_slope(p, fq) FILTER (p IS NOT NULL) AS ps, regr_intercept(p, fq) FILTER (p IS NOT NULL) AS pi FROM f{i}),
           f{i + 1} AS (SELECT l_orderkey, l_linenumber, q, p, coalesce(q, qi + qs * fp) AS fq, coalesce(p, pi + ps * fq) AS fp FROM (SELECT l_orderkey, l_linenumber, q, p, fq, fp FROM f{i}), w{i})"""
    for i in range(3)
)


@query(f"""WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 > 0 THEN l_quantity END AS q, CASE WHEN (l_orderkey * 3 + l_linenumber) % 10 > 1 THEN l_extendedprice END AS p FROM lineitem),
           f0 AS (SELECT *, coalesce(q, avg(q) OVER ()) AS fq, coalesce(p, avg(p) OVER ()) AS fp FROM g){_CHAIN.replace('coalesce(p, pi + ps * fq) AS fp', 'coalesce(p, pi + ps * fq0) AS fp').replace('SELECT l_orderkey, l_linenumber, q, p, fq, fp FROM f', 'SELECT l_orderkey, l_linenumber, q, p, fq AS fq0, fp FROM f')}
           SELECT l_orderkey, l_linenumber, round(fq + 1e-7, 4) AS q, round(fp + 1e-7, 2) AS p FROM f3""")
def chained_imputation(t):
    """Planted gaps of quantities and prices, filled by each other in three rounds."""
    gap = lambda a, least, c: F.when((F.col("l_orderkey") * a + F.col("l_linenumber")) % 10 > least, F.col(c))
    df = t("lineitem").select("l_orderkey", "l_linenumber", gap(7, 0, "l_quantity").alias("q"), gap(3, 1, "l_extendedprice").alias("p"))
    return K.impute_chained(df, ["q", "p"], rounds=3, still=0.0).select("l_orderkey", "l_linenumber", up("q").alias("q"), up("p", 2).alias("p"))


@query()
def ml_independent_components(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return K.independent_components(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 4).select("l_orderkey", "l_linenumber", *(f"ica_{i}" for i in range(4)))


@query()
def ml_recursive_forecast(t):
    """Six months of every supplier's quantities by boosted trees over the four months before and the month of the year."""
    month = 12 * (F.year("l_shipdate") - 1992) + F.month("l_shipdate") - 1
    h = t("lineitem").groupBy("l_suppkey", month.cast("long").alias("month")).agg(F.sum("l_quantity").alias("v"))
    model = G.fit_recursive(h, "l_suppkey", "month", "v", 4, season=12, maxIter=5, maxDepth=3)
    return G.forecast_recursively(model, h, "l_suppkey", "month", "v", 4, 6, season=12)


# Streams

@stored(f"""WITH {DAILY}, l AS (SELECT l_suppkey, d, v, list(v) OVER (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS y FROM daily)
            SELECT l_suppkey, CAST(d AS VARCHAR) AS d, count(*) OVER a AS n, round(avg(v) OVER a + 1e-7, 4) AS m, round(var_samp(v) OVER a + 1e-7, 4) AS s, round(list_reduce(y, lambda a, b: a * 0.75 + b * 0.25) + 1e-7, 4) AS ewm
            FROM l WINDOW a AS (PARTITION BY l_suppkey ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def streamed_features(spark, sf_dir, t):
    """What is known of a supplier's daily quantities before each day, from state that a stream keeps for each of them."""
    at = scratch.place(spark, "stream")
    daily = _daily(t)
    daily.write.parquet(f"{at}/in")
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.STATE_STORE)
    out = keyed.series_features(session.readStream.schema(daily.schema).parquet(f"{at}/in"), ["l_suppkey"], "d", "v")
    sink = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{at}/out")
    return found.select("l_suppkey", F.col("d").cast("string").alias("d"), F.col("n_before").alias("n"), up("mean_before").alias("m"), up("var_before").alias("s"), up("smooth_before").alias("ewm"))


# Ciphers

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SHUFFLED = "".join(_LETTERS[(7 * i + 3) % 26] for i in range(26))


@query(f"""WITH c AS (SELECT unnest(string_split(lower(text), '')) AS p FROM documents) SELECT translate(p, '{_LETTERS}', '{_SHUFFLED}') AS cipher, p AS plain FROM c WHERE p BETWEEN 'a' AND 'z' AND length(p) = 1 AND p IN (SELECT unnest(string_split('{_LETTERS}', ''))) GROUP BY 1, 2""")
def cipher_key(t):
    """All documents are encrypted, with one character in twenty wrong, and the key is found again from them and the plain ones."""
    plain = t("documents").select("doc_id", F.lower("text").alias("text"))
    letter = lambda n: F.substring(F.lit(_LETTERS), (F.col("doc_id") * n % 26 + 1).cast("int"), F.lit(1))
    run = F.concat(F.lit("(?s)(.{"), (F.col("doc_id") % 21 + 28).cast("string"), F.lit("}).."))  # two of 30 to 50 characters
    secret = plain.select("doc_id", F.regexp_replace(F.translate("text", _LETTERS, _SHUFFLED), run, F.concat(F.lit("$1"), letter(7), letter(5))).alias("text"))
    key = C.solve(secret, plain, "doc_id", "text").key
    return key.filter(F.col("plain").isin(*_LETTERS)).select("cipher", "plain")


# Sources

@stored("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def scan_preview(spark, sf_dir, t):
    """The first rows of the files of all orders, without reading files further on."""
    at = scratch.place(spark, "preview")
    tables.save(t("orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), at, "csv")
    return tables.load(spark, at, "csv", schema="o_orderkey long, o_totalprice double", limit=20)


@stored("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment = 'BUILDING'")
def scan_pushed(spark, sf_dir, t):
    """Customers by way of a data source of the library's own, which the filters reach: files and rows that they rule out are never made rows."""
    connector.register(spark)
    at = scratch.place(spark, "connector")
    t("customer").repartitionByRange(4, "c_acctbal").write.format("zjsonl").mode("append").save(at)
    found = spark.read.format("zjsonl").load(at).filter((F.col("c_acctbal") >= 5000) & (F.col("c_mktsegment") == "BUILDING"))
    return found.select("c_custkey", "c_name", "c_acctbal")

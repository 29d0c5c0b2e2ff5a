"""Further queries with SQL twins: statistics, encodings, metrics and what models leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import stats as A
from .operators import features as X
from .operators import models as M
from .operators import order as O
from .operators import prepare as P
from .operators import relational as R
from .operators import text as T
from .operators import vectors as V
from .plans import catalog
from .plans.features import REGISTRY
from .queries import HASH, day, query, r, up

# Statistics

@query("""SELECT l_suppkey, mode_linenumber, n FROM (SELECT l_suppkey, l_linenumber AS mode_linenumber, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS i FROM lineitem GROUP BY 1, 2) WHERE i = 1""")
def grouped_mode(t):
    """The most frequent value of each group, the smallest of equal ones, and how often it occurs."""
    counts = t("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("l_linenumber", "n"), F.struct("n", -F.col("l_linenumber"))).alias("b")
    return counts.groupBy("l_suppkey").agg(best).select("l_suppkey", F.col("b.l_linenumber").alias("mode_linenumber"), F.col("b.n").alias("n"))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) + 1e-9, 6) AS corr FROM lineitem" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]))
def correlation_matrix(t):
    return P.correlations(t("lineitem"), NUMERIC).select("a", "b", r(F.col("corr") + F.lit(1e-9), 6).alias("corr"))


# What a fit leaves behind is known from SQL, too: its rows are there only if the same columns are chosen.

@query("""WITH c AS (SELECT abs(corr(a, b)) AS ab, abs(corr(a, c)) AS ac, abs(corr(b, c)) AS bc, abs(corr(a, d)) AS ad, abs(corr(b, d)) AS bd, abs(corr(c, d)) AS cd FROM (SELECT l_quantity AS a, l_extendedprice AS b, l_quantity * 2 AS c, l_tax AS d FROM lineitem))
          SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem, c WHERE ab <= 0.8 AND greatest(ac, bc) > 0.8 AND greatest(ad, bd, cd) <= 0.8
          UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, NULL, l_tax FROM lineitem, c WHERE ab > 0.8""")
def uncorrelated_columns(t):
    """The double of a column goes."""
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_quantity") * 2).alias("double"), "l_tax")
    kept = P.drop_correlated(df, ["l_quantity", "l_extendedprice", "double", "l_tax"], 0.8)
    return df.select("l_orderkey", "l_linenumber", *kept)


@query("""WITH v AS (SELECT var_samp(l_quantity) AS q, var_samp(l_extendedprice) AS p, var_samp(l_discount) AS d, var_samp(l_tax) AS x FROM lineitem)
          SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem, v WHERE least(p, q) > greatest(d, x)""")
def varied_columns(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", *P.top_variance(t("lineitem"), NUMERIC, 2))


@query("""WITH m AS (SELECT avg(CAST(o_orderkey IS NULL AS INT)) AS k, avg(CAST(o_orderstatus IS NULL AS INT)) AS s, avg(CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END IS NULL AS INT)) AS x FROM orders)
          SELECT o_orderkey, o_orderstatus FROM orders, m WHERE k <= 0.1 AND s <= 0.1 AND x > 0.1""")
def filled_columns(t):
    """Columns of which at most a tenth is missing."""
    df = t("orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("x"))
    return df.select(*X.fit_column_filter(df, 0.1))


@query("""SELECT o_orderkey, round(ln(1 + n) + 1e-7, 6) AS n, round(x + 1e-7, 4) AS x FROM (SELECT o_orderkey, power(o_orderkey % 10, 6) AS n, o_totalprice / 1000 AS x FROM orders)""")
def unskewed(t):
    df = t("orders").select("o_orderkey", F.pow(F.col("o_orderkey") % 10, F.lit(6.0)).alias("n"), (F.col("o_totalprice") / 1000).alias("x"))
    return P.unskew(df, ["n", "x"]).select("o_orderkey", up("n", 6).alias("n"), up("x").alias("x"))


# Encodings and imputing

@query("""WITH a AS (SELECT o_orderkey, o_orderpriority AS k, o_totalprice AS y, o_orderkey % 5 AS f FROM orders), o AS (SELECT k, f.f, median(y) AS med, min(y) AS low, max(y) AS high FROM a JOIN (SELECT DISTINCT f FROM a) f ON a.f <> f.f GROUP BY 1, 2)
          SELECT o_orderkey, round(med + 1e-7, 4) AS med, low, high FROM a LEFT JOIN o USING (k, f)""")
def target_statistics(t):
    df = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 5).alias("f"))
    out = P.target_statistics_out_of_fold(df, "k", "y", "f", 5, ["median", "min", "max"])
    return out.select("o_orderkey", up("k_target_median").alias("med"), F.col("k_target_min").alias("low"), F.col("k_target_max").alias("high"))


@query("""WITH u AS (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) SELECT s_suppkey, CAST(n AS BIGINT) AS n FROM supplier JOIN (SELECT k, count(*) AS n FROM u GROUP BY 1) c ON k = s_nationkey""")
def count_encoding_of_union(t):
    both = R.union_all(t("supplier").select(F.col("s_nationkey").alias("k")), t("customer").select(F.col("c_nationkey").alias("k")))
    return P.encode_frequency(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), "k", like=both, normalise=False).select("s_suppkey", F.col("k_freq").cast("long").alias("n"))


@query("""WITH top AS (SELECT p_size AS v, row_number() OVER (ORDER BY count(*) DESC, p_size) AS i FROM part GROUP BY 1), a AS (SELECT p_partkey, i FROM part LEFT JOIN top ON v = p_size)
          SELECT p_partkey, CAST(i = 1 AS INT) AS first, CAST(i = 2 AS INT) AS second, CAST(i = 3 AS INT) AS third, CAST(i > 3 AS INT) AS other FROM a""")
def one_hot_most_frequent(t):
    values = P.fit_one_hot(t("part"), "p_size", 3)
    df = P.one_hot_top(t("part"), "p_size", values)
    return df.select("p_partkey", *(F.col(f"p_size_{v}").alias(n) for v, n in zip(values, ("first", "second", "third"))), F.col("p_size_Other").alias("other"))


@query("""WITH k AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, code, p_brand AS decoded FROM part JOIN k USING (p_brand)""")
def decoded_labels(t):
    coded = P.encode_labels(t("part"), "p_brand", new="code")
    values = [x[0] for x in t("part").select("p_brand").distinct().orderBy("p_brand").collect()]  # the artifact that a fitted encoder is
    return X.decode_labels(coded, "code", values, "decoded").select("p_partkey", "code", "decoded")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE WHEN l_partkey % 9 <> 0 THEN l_extendedprice END AS y FROM lineitem), m AS (SELECT regr_slope(y, q) AS b, regr_intercept(y, q) AS c FROM a)
          SELECT l_orderkey, l_linenumber, round(coalesce(y, b * q + c) + 1e-4, 2) AS y FROM a, m""")
def impute_by_regression(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_extendedprice")).alias("y"))
    return P.impute_by_model(df, "y", ["q"]).select("l_orderkey", "l_linenumber", r(F.col("y") + F.lit(1e-4), 2).alias("y"))


# Text

@query(r"""WITH w AS (SELECT conv_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS a FROM conversations), g AS (SELECT conv_id, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) AS term FROM w),
           tf AS (SELECT conv_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(DISTINCT conv_id) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf, n GROUP BY term, n HAVING count(*) BETWEEN 4 AND 0.5 * n),
           x AS (SELECT conv_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n)
           SELECT conv_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY conv_id)) + 1e-9, 6) AS weight FROM x""")
def tfidf_of_word_pairs(t):
    df = T.tfidf(t("conversations"), "conv_id", "text", min_df=4, max_df=0.5, longest=2)
    return df.select("conv_id", "term", r(F.col("weight") + F.lit(1e-9), 6).alias("weight"))


_TITLES = r"""a AS (SELECT doc_id, lang AS label, trim(text) AS text, array_to_string(regexp_extract_all(text, '\S+')[2:5], ' ') AS chosen FROM documents),
              x AS (SELECT label, word, count(*) AS n FROM (SELECT label, unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM a) GROUP BY 1, 2 HAVING count(*) >= 3),
              y AS (SELECT label, word, count(*) AS k FROM (SELECT label, unnest(regexp_extract_all(lower(chosen), '\S+')) AS word FROM a) GROUP BY 1, 2),
              imp AS (SELECT label, word, coalesce(k, 0) / n AS importance FROM x LEFT JOIN y USING (label, word))"""


def _titles(t):
    """Every whole document, and four of its words as the chosen span."""
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))
    return t("documents").select("doc_id", F.col("lang").alias("label"), "text", F.array_join(F.slice(words, 2, 4), " ").alias("chosen"))


@query(f"WITH {_TITLES} SELECT label, word, round(importance, 6) AS importance FROM imp")
def word_importances(t):
    return T.word_importance(_titles(t), "text", "chosen", "label").withColumn("importance", r("importance", 6))


@query(rf"""WITH {_TITLES}, w AS (SELECT doc_id, label, text, regexp_extract_all(text, '\S+') AS w FROM a), o AS (SELECT doc_id, label, unnest(w) AS tok, unnest(range(len(w))) AS i FROM w),
            v AS (SELECT doc_id, tok, i, coalesce(importance, 0.5) AS v FROM o LEFT JOIN imp ON imp.label = o.label AND imp.word = lower(tok)),
            b AS (SELECT doc_id, tok FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, i) AS n FROM v) WHERE n = 1)
            SELECT w.doc_id, CASE WHEN label = 'en' OR len(w) <= 3 OR label NOT IN (SELECT label FROM imp) THEN text ELSE tok END AS span FROM w LEFT JOIN b USING (doc_id)""")
def chosen_spans(t):
    titles = _titles(t)
    return T.best_span(titles, ["doc_id"], "text", "label", T.word_importance(titles, "text", "chosen", "label"), neutral="en", short=3)


# Metrics

@query(f"""WITH a AS (SELECT CAST(o_orderstatus = 'F' AS INT) AS y, CAST(({HASH.format('o_orderkey')} % 1000) / 1000.0 * 0.6 + 0.4 * (o_orderstatus = 'F')::INT AS DOUBLE) AS p FROM orders), b AS (SELECT *, round(p, 3) AS s FROM a),
           g AS (SELECT s, count(*) AS n, sum(y) AS k FROM b GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
           u AS (SELECT (sum(k * (below + (n + 1) / 2.0)) - sum(k) * (sum(k) + 1) / 2) / (sum(k) * (sum(n) - sum(k))) AS auc FROM c)
           SELECT round(avg(CAST(y = CAST(s >= 0.5 AS INT) AS DOUBLE)), 6) AS accuracy, round(-avg(y * ln(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15))), 6) AS log_loss, round((SELECT auc FROM u), 6) AS auc FROM b""")
def classification_metrics(t):
    y = (F.col("o_orderstatus") == "F").cast("int")
    df = t("orders").select("o_orderkey", y.alias("y"), (F.pmod(P.hashed("o_orderkey"), F.lit(1000)) / 1000 * 0.6 + F.lit(0.4) * y).alias("p")).select("y", F.round("p", 3).alias("s"))
    scored = df.withColumn("guess", (F.col("s") >= 0.5).cast("int")).agg(r(A.accuracy("y", "guess"), 6).alias("accuracy"), r(A.log_loss("y", "s"), 6).alias("log_loss"))
    return scored.crossJoin(O.auc(df, "y", "s").select(r("auc", 6).alias("auc")))


_POINTS = "p AS (SELECT vec_id, label AS c, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_MEAN = "m AS (SELECT c, list(v ORDER BY i) AS m, any_value(n) AS n FROM (SELECT c, i, avg(v) AS v, count(*) AS n FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p) GROUP BY 1, 2) GROUP BY 1)"
_SQUARE = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) ** 2))"


@query(f"""WITH {_POINTS}, {_MEAN}, far AS (SELECT a.vec_id, a.c, b.c AS other, sum({_SQUARE.format('a.x', 'b.x')}) AS d, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3),
           own AS (SELECT vec_id, d / (n - 1) AS a, n FROM far WHERE c = other), near AS (SELECT vec_id, min(d / n) AS b FROM far WHERE c <> other GROUP BY 1), sil AS (SELECT avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS s FROM own JOIN near USING (vec_id)),
           w AS (SELECT p.c, any_value(m.m) AS m, count(*) AS n, avg(sqrt({_SQUARE.format('x', 'm.m')})) AS d, sum({_SQUARE.format('x', 'm.m')}) AS within FROM p JOIN m USING (c) GROUP BY 1),
           t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, avg(v) AS v FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p) GROUP BY 1)), k AS (SELECT count(*) AS k, sum(n) AS n, sum(within) AS within FROM w),
           bt AS (SELECT sum(n * {_SQUARE.format('m', 't')}) AS b FROM w, t), db AS (SELECT avg(r) AS r FROM (SELECT a.c, max((a.d + b.d) / sqrt({_SQUARE.format('a.m', 'b.m')})) AS r FROM w a JOIN w b ON a.c <> b.c GROUP BY 1))
           SELECT round(s, 5) AS silhouette, round((b / (k - 1)) / (within / (n - k)), 4) AS calinski_harabasz, round(r, 5) AS davies_bouldin FROM sil, k, bt, db""")
def cluster_metrics(t):
    df = M.cluster_scores(t("embeddings"), "label", "embedding")
    return df.select(r("silhouette", 5).alias("silhouette"), r("calinski_harabasz").alias("calinski_harabasz"), r("davies_bouldin", 5).alias("davies_bouldin"))


# Vectors and predictions

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""WITH b AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT b.vec_id AS q, a.vec_id AS found, round({_COS}, 6) AS score FROM embeddings a, b WHERE a.vec_id <> b.vec_id AND a.label = b.label)
           SELECT q, found, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, found) AS n FROM s WHERE score >= 0.05) WHERE n <= 1""")
def best_match_of_same_kind(t):
    """A stated query set against all rows of the same kind, from a threshold on."""
    return V.nearest(t("embeddings").filter("vec_id % 100 = 0"), t("embeddings"), "vec_id", "embedding", 1, least=0.05, same="label")


@query("""WITH a AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), b AS (SELECT s_suppkey AS k, s_suppkey % 7 AS v FROM supplier), x AS (SELECT k, percent_rank() OVER (ORDER BY v) AS p FROM a UNION ALL SELECT k, percent_rank() OVER (ORDER BY v) FROM b)
          SELECT k, round(avg(p) + 1e-9, 6) AS v FROM x GROUP BY 1""")
def blended_ranks(t):
    a = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    b = t("supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 7).cast("double").alias("v"))
    return M.blend([a, b], "k", "v", how="rank").select("k", r(F.col("v") + F.lit(1e-9), 6).alias("v"))


@query("""WITH x AS (SELECT s_suppkey AS k, s_suppkey % 3 AS v FROM supplier UNION ALL SELECT s_suppkey, s_suppkey % 2 FROM supplier UNION ALL SELECT s_suppkey, 1 FROM supplier), n AS (SELECT k, v, count(*) AS n FROM x GROUP BY 1, 2)
          SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS i FROM n) WHERE i = 1""")
def voted_labels(t):
    vote = lambda c: t("supplier").select(F.col("s_suppkey").alias("k"), c.cast("long").alias("v"))
    return M.blend([vote(F.col("s_suppkey") % 3), vote(F.col("s_suppkey") % 2), vote(F.lit(1))], "k", "v", how="vote")


@query("SELECT o_orderkey AS id, CAST(o_totalprice >= 150000 AS INT) AS label FROM orders")
def submission_rows(t):
    """Predictions as labels, under the names that a submission has."""
    scored = t("orders").select("o_orderkey", (F.col("o_totalprice") / 300000).alias("p"))
    return X.submission(M.threshold_labels(scored, "o_orderkey", "p").withColumnRenamed("o_orderkey", "id"), "id", "label", "label")


@query("""WITH RECURSIVE h AS (SELECT l_suppkey AS k, date_diff('month', DATE '1992-01-01', l_shipdate) AS s, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC) AS i FROM h),
          b AS (SELECT k, max(s) AS s, max(v) FILTER (i = 1) AS a, max(v) FILTER (i = 2) AS b, max(v) FILTER (i = 3) AS c FROM n GROUP BY 1 HAVING count(*) >= 3),
          f AS (SELECT k, s, a, b, c, 0 AS j FROM b UNION ALL SELECT k, s + 1, 0.5 * a + 0.3 * b + 0.1 * c + 2, a, b, j + 1 FROM f WHERE j < 6)
          SELECT k AS l_suppkey, CAST(s AS BIGINT) AS month, round(a + 1e-7, 4) AS v FROM f WHERE j > 0""")
def recursive_forecast(t):
    """Six months ahead, each from the three before it, forecasts among them."""
    month = 12 * (F.year("l_shipdate") - 1992) + F.month("l_shipdate") - 1
    h = t("lineitem").groupBy("l_suppkey", month.cast("long").alias("month")).agg(F.sum("l_quantity").alias("v"))
    return M.forecast(h, "l_suppkey", "month", "v", [0.5, 0.3, 0.1], 2.0, 6).select("l_suppkey", "month", up("v").alias("v"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_tax AS x, 2 * l_quantity + l_tax AS t FROM lineitem),
          w AS (SELECT regr_slope(q - x * b, t) AS wt, b AS wx FROM x, (SELECT (covar_pop(x, q) * var_pop(t) - covar_pop(t, q) * covar_pop(x, t)) / (var_pop(x) * var_pop(t) - covar_pop(x, t) ** 2) AS b FROM x) GROUP BY b),
          e AS (SELECT max(abs(q - wt * t - wx * x)) AS off, abs(any_value(wt)) * stddev_samp(t) AS by_t, abs(any_value(wx)) * stddev_samp(x) AS by_x FROM x, w)
          SELECT l_orderkey, l_linenumber, round(t + 1e-7, 4) AS telling FROM x, e WHERE off < 1e-6 AND by_t > by_x""")
def selected_features(t):
    """Of three columns, the one that says most about the quantity is left."""
    df = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_quantity", "l_tax", (2 * F.col("l_quantity") + F.col("l_tax")).alias("telling"))
    kept = M.importance_order(df, ["l_tax", "telling", "line"], "l_quantity", 1)
    return df.select("l_orderkey", F.col("line").alias("l_linenumber"), *(up(c).alias(c) for c in kept))


@query("""WITH t AS (SELECT 'lineitem' AS given, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer)
          SELECT name, tag, slot, given, n_rows FROM t JOIN (VALUES ('rollup.lines', 'aggregate', 'lines', 'lineitem'), ('rollup.orders', 'aggregate', 'orders', 'orders'), ('rollup.orders', 'join', 'orders', 'orders'),
          ('merge.features', 'join', 'parent', 'customer'), ('merge.features', 'join', 'child', 'customer')) AS o(name, tag, slot, given) USING (given)""")
def registered_operators(t):
    """Which given tables meet the contracts of registered operators, and how many rows each of them has to work on."""
    given = {name: t(name) for name in ("lineitem", "orders", "customer", "part", "supplier")}
    return catalog.usable_tables(REGISTRY, given).select("name", F.explode("tags").alias("tag"), "slot", "given", "n_rows")


@query("SELECT CAST(o_orderdate AS DATE)::VARCHAR AS d, count(*) AS n FROM orders GROUP BY 1")
def contract_checked(t):
    """A step whose inputs and outputs are checked against its contract."""
    from .plans.contracts import Column, Table
    from .plans.pipeline import Pipeline, Registry

    registry = Registry()

    @registry.operator("count.days", {"orders": Table({"o_orderdate": Column("any")})}, {"days": Table({"d": Column("any"), "n": Column("int")})})
    def count_days(inputs):
        return inputs["orders"].groupBy(day("o_orderdate").cast("string").alias("d")).agg(F.count("*").alias("n"))

    return Pipeline.of(registry, [{"operator": "count.days", "inputs": {"orders": "orders"}, "outputs": {"days": "days"}}]).build({"orders": t("orders")})["days"]

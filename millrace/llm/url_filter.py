"""Operator 10: URL filtering by a temporal list join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: List changes up to which the intervals are broadcast; beyond, they are shuffled. A change stands in
#: every bucket that it is active in, a dozen a year, with under 200 bytes each.
BROADCAST_CHANGES = 10_000
#: Days of one time bucket of the as-of join.
BUCKET_DAYS = 32


def _host(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit("."))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, since, until) of dated changes (entry, action, at); ``until`` is null while an entry stands.

    On one date a removal comes after additions. Changes without entry or date are ignored.
    """
    bare = F.rtrim(F.regexp_replace(F.trim("entry"), r"^(\*\.|\.)", ""), F.lit("/"))
    clean = F.concat(F.lower(F.substring_index(bare, "/", 1)), F.regexp_extract(bare, "(/.*)$", 1))
    rows = entries.select(clean.alias("entry"), (F.col("action") == "remove").alias("removes"), F.col("at").cast("date").alias("since"))
    rows = rows.filter("entry != '' AND since IS NOT NULL").groupBy("entry", "since").agg(F.max(F.coalesce("removes", F.lit(False))).alias("removes"))
    until = F.lead("since").over(Window.partitionBy("entry").orderBy("since"))
    return rows.withColumn("until", until).filter(~F.col("removes")).select("entry", "since", "until")


def url_filter(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched", bucket_days: int = BUCKET_DAYS, broadcast_changes: int = BROADCAST_CHANGES) -> DataFrame:
    """Evaluate every capture against the list entries that were active when it was fetched.

    An entry is a host (with its subdomains) or a host and a path prefix of whole segments; hosts are
    compared without regard to case, paths as they are. Its
    dated additions and removals become validity intervals. Captures meet them by an equi-join on
    (entry, time bucket) with the interval as condition, so an entry with a long history costs a
    capture only the changes of one bucket, and the as-of match is at most one interval an entry.

    Returns a row for each distinct (id, url, time): page_id, url, fetched, host, n_active, matched
    (the longest active entry, or null), blocked. Null or malformed URLs have no host and pass, as
    do captures without a time. Repeated rows count once. Other columns are ignored.
    """
    day = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bucket_days)
    spans = intervals(entries)
    size, newest = entries.agg(F.count("*"), F.max(F.col("at").cast("date"))).first()
    last = day(F.lit(newest).cast("date"))
    final = F.coalesce(day(F.date_sub("until", 1)), last)
    listed = spans.select("entry", "since", "until", F.explode(F.sequence(day(F.col("since")), F.greatest(final, day(F.col("since"))))).alias("in_bucket"))
    listed = F.broadcast(listed) if size <= broadcast_changes else listed

    caught = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(fetched_col).cast("date").alias("fetched"))
    caught = caught.select("*", F.nullif(_host(F.col("url")), F.lit("")).alias("host"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(_path(F.col("url")), "/"), lambda x: x != "")
    paths = F.transform(F.filter(F.sequence(F.lit(0), F.size(steps)), lambda i: i > 0), lambda i: F.concat_ws("/", F.col("host"), F.array_join(F.slice(steps, 1, i), "/")))
    keys = F.when(F.col("host").isNotNull(), F.array_distinct(F.concat(domains, paths)))
    probes = caught.select("*", F.explode_outer(keys).alias("key"), F.least(day(F.col("fetched")), last).alias("bucket"))

    active = (F.col("key") == F.col("entry")) & (F.col("bucket") == F.col("in_bucket")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = probes.join(listed, active, "left")
    out = met.groupBy("page_id", "url", "fetched", "host").agg(F.size(F.collect_set("entry")).cast("long").alias("n_active"), F.max(F.when(F.col("entry").isNotNull(), F.struct(F.length("entry").alias("n"), "entry"))).alias("best"))
    return out.select("page_id", "url", "fetched", "host", "n_active", F.col("best.entry").alias("matched"), (F.col("n_active") > 0).alias("blocked"))

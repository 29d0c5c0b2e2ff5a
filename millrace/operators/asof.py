"""As-of joins: the nearest event before and after every row, without one task for all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import passing, saved
from .order import ROW_BITS


def around(df: DataFrame, time: str, events: DataFrame, at: str, keys: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``before`` and ``after``: the last event at or before a row's time and the first one at or after it, as structs of ``at`` and ``carry``.

    Events are those of equal ``keys``; null where there is none, and for rows with a null time or key. Of events of one time and key
    the least by ``carry`` counts. Rows and events are sorted together by ranges, once; each range is passed over forwards and
    backwards, and only every range's first and last event meet in one task. So neither a key nor a moment that very
    many rows share makes a large task.
    """
    keys, carry = keys or [], carry or []
    names = [f"__k{i}" for i in range(len(keys))]
    key = F.struct(*names) if names else F.lit(0)
    one = events.filter(F.col(at).isNotNull()).groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(at).alias("__t")).agg(F.min(F.struct(F.lit(0).alias("__none"), *carry)).alias("__c"))
    event = F.struct(key.alias("k"), F.col("__t").alias("t"), F.col("__c").alias("c"))
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(time).alias("__t"), F.struct(*df.columns).alias("__row"), F.xxhash64(*df.columns).alias("__tie"))
    both = rows.unionByName(one.select(*names, "__t", event.alias("__e"), F.lit(0).cast("long").alias("__tie")), allowMissingColumns=True)
    part = F.shiftright("__at", ROW_BITS)
    with passing() as keep:
        # Events come before the rows of their moment; equal rows are told apart by their hash, so that they may part.
        ordered = saved(both.orderBy(*names, "__t", F.col("__e").isNull(), "__tie").withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", part), "ordered")
        keep(ordered)
    ends = ordered.groupBy("__part").agg(F.max_by("__e", F.when(F.col("__e").isNotNull(), F.col("__at"))).alias("last"), F.min_by("__e", F.when(F.col("__e").isNotNull(), F.col("__at"))).alias("first"))
    earlier = lambda c, by: F.last(c, True).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("__part", earlier("last", F.col("__part")).alias("__from"), earlier("first", F.desc("__part")).alias("__to"))
    seen = lambda by: F.last("__e", True).over(Window.partitionBy("__part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    met = ordered.withColumns({"__b": seen(F.col("__at")), "__a": seen(F.desc("__at"))}).filter(F.col("__row").isNotNull()).join(F.broadcast(carried), "__part")
    known = F.col("__t").isNotNull()
    for n in names:
        known = known & F.col(n).isNotNull()
    met = met.withColumns({"__b": F.coalesce("__b", "__from"), "__a": F.coalesce("__a", "__to")})
    met = met.withColumns({c: F.when(known & (F.col(f"{c}.k") == key), F.col(c)) for c in ("__b", "__a")})
    met = met.withColumn("__a", F.when(F.col("__b.t") == F.col("__t"), F.col("__b")).otherwise(F.col("__a")))
    shown = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.t").alias(at), *(F.col(f"{c}.c.{x}").alias(x) for x in carry)))
    return met.select("__row.*", shown("__b").alias("before"), shown("__a").alias("after"))

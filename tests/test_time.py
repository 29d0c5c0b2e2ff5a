"""As-of joins, holidays by rule, and forecasts, against plain search."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.functions import holidays as H
from millrace.operators import asof as B


def test_around_equals_plain_search(spark):
    rng = random.Random(3)
    events = [(rng.choice("abcn"), rng.randint(0, 60), rng.choice("xyz")) for _ in range(50)] + [(None, 5, "x"), ("a", None, "x")]
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.randint(-5, 70) if rng.random() < 0.95 else None, "k") for i in range(400)] + [(900, "a", 30, "k")] * 300
    df = spark.createDataFrame(rows, "id long, k string, t int, at string").repartition(4)
    ev = spark.createDataFrame(events, "k string, at int, name string")

    def plain(k, t):
        own = sorted((a, n) for e, a, n in events if e == k and a is not None and k is not None)
        if t is None:
            return None, None
        before = max((a for a, _ in own if a <= t), default=None)
        after = min((a for a, _ in own if a >= t), default=None)
        return tuple(None if x is None else (x, min(n for a, n in own if a == x)) for x in (before, after))

    got = sorted((r.id, r.k or "", -99 if r.t is None else r.t, r.before and tuple(r.before), r.after and tuple(r.after)) for r in B.around(df, "t", ev, "at", ["k"], ["name"]).collect())
    assert got == sorted(((i, k or "", -99 if t is None else t, *plain(k, t)) for i, k, t, _ in rows), key=lambda r: r[:3])


def test_around_without_keys_or_events(spark):
    df = spark.range(5).select("id", (F.col("id") * 10).alias("t"))
    ev = spark.createDataFrame([(15,), (40,)], "at long")
    got = {r.id: (r.before and r.before.at, r.after and r.after.at) for r in B.around(df, "t", ev, "at").collect()}
    assert got == {0: (None, 15), 1: (None, 15), 2: (15, 40), 3: (15, 40), 4: (40, 40)}
    assert all(r.before is None and r.after is None for r in B.around(df, "t", ev.limit(0), "at").collect())
    assert B.around(df.limit(0), "t", ev, "at").count() == 0


def test_rules_give_dates(spark):
    rules = [("US", "Thanksgiving", (11, 4, 4)), ("US", "Memorial Day", (5, 1, -1)), ("X", "Good Friday", -2), ("X", "Fifth Monday", (2, 1, 5)), ("X", "Leap", (2, 29)), ("X", "May", (5, 1))]
    got = {(r.name, r.date) for r in H.holidays(spark.createDataFrame([(2023,), (2024,), (2024,), (None,)], "year int"), rules=rules).collect()}
    assert got == {
        ("Thanksgiving", dt.date(2023, 11, 23)), ("Thanksgiving", dt.date(2024, 11, 28)), ("Memorial Day", dt.date(2023, 5, 29)), ("Memorial Day", dt.date(2024, 5, 27)),
        ("Good Friday", dt.date(2023, 4, 7)), ("Good Friday", dt.date(2024, 3, 29)), ("Leap", dt.date(2024, 2, 29)), ("May", dt.date(2023, 5, 1)), ("May", dt.date(2024, 5, 1)),
    }


def test_public_holidays(spark):
    got = {(r.country, r.name): r.date for r in H.holidays(spark.createDataFrame([(2021,)], "year int")).collect()}
    assert len(got) == len(H.PUBLIC) and got["FR", "Ascension"] == dt.date(2021, 5, 13) and got["PL", "Corpus Christi"] == dt.date(2021, 6, 3) and got["DE", "Unity"] == dt.date(2021, 10, 3)

"""Dated events by rule: fixed days, days counted from Easter, and the n-th weekday of a month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import easter

# Public holidays by national law, as (country, name, rule). A rule is (month, day), a number of days after
# Easter Sunday, or (month, weekday from 1 for Monday, which one; -1: the last).
PUBLIC = [
    ("BE", "New Year", (1, 1)), ("BE", "Easter", 0), ("BE", "Easter Monday", 1), ("BE", "Labour Day", (5, 1)), ("BE", "Ascension", 39), ("BE", "Whit Sunday", 49), ("BE", "Whit Monday", 50),
    ("BE", "National Day", (7, 21)), ("BE", "Assumption", (8, 15)), ("BE", "All Saints", (11, 1)), ("BE", "Armistice", (11, 11)), ("BE", "Christmas", (12, 25)),
    ("DE", "New Year", (1, 1)), ("DE", "Good Friday", -2), ("DE", "Easter Monday", 1), ("DE", "Labour Day", (5, 1)), ("DE", "Ascension", 39), ("DE", "Whit Monday", 50), ("DE", "Unity", (10, 3)),
    ("DE", "Christmas", (12, 25)), ("DE", "Second Christmas Day", (12, 26)),
    ("ES", "New Year", (1, 1)), ("ES", "Epiphany", (1, 6)), ("ES", "Good Friday", -2), ("ES", "Labour Day", (5, 1)), ("ES", "Assumption", (8, 15)), ("ES", "National Day", (10, 12)),
    ("ES", "All Saints", (11, 1)), ("ES", "Constitution", (12, 6)), ("ES", "Immaculate Conception", (12, 8)), ("ES", "Christmas", (12, 25)),
    ("FR", "New Year", (1, 1)), ("FR", "Easter Monday", 1), ("FR", "Labour Day", (5, 1)), ("FR", "Victory", (5, 8)), ("FR", "Ascension", 39), ("FR", "Whit Monday", 50), ("FR", "National Day", (7, 14)),
    ("FR", "Assumption", (8, 15)), ("FR", "All Saints", (11, 1)), ("FR", "Armistice", (11, 11)), ("FR", "Christmas", (12, 25)),
    ("IT", "New Year", (1, 1)), ("IT", "Epiphany", (1, 6)), ("IT", "Easter", 0), ("IT", "Easter Monday", 1), ("IT", "Liberation", (4, 25)), ("IT", "Labour Day", (5, 1)), ("IT", "Republic", (6, 2)),
    ("IT", "Assumption", (8, 15)), ("IT", "All Saints", (11, 1)), ("IT", "Immaculate Conception", (12, 8)), ("IT", "Christmas", (12, 25)), ("IT", "Second Christmas Day", (12, 26)),
    ("PL", "New Year", (1, 1)), ("PL", "Epiphany", (1, 6)), ("PL", "Easter", 0), ("PL", "Easter Monday", 1), ("PL", "Labour Day", (5, 1)), ("PL", "Constitution", (5, 3)), ("PL", "Whit Sunday", 49),
    ("PL", "Corpus Christi", 60), ("PL", "Assumption", (8, 15)), ("PL", "All Saints", (11, 1)), ("PL", "Independence", (11, 11)), ("PL", "Christmas", (12, 25)), ("PL", "Second Christmas Day", (12, 26)),
]


def _as_row(country: str, name: str, rule: tuple | int) -> Column:
    away, (month, weekday, which, date) = (rule, (None,) * 4) if isinstance(rule, int) else (None, (rule[0], None, None, rule[1]) if len(rule) == 2 else (*rule, None))
    numbers = {"away": away, "month": month, "weekday": weekday, "which": which, "day": date}
    return F.struct(F.lit(country).alias("country"), F.lit(name).alias("name"), *(F.lit(v).cast("int").alias(n) for n, v in numbers.items()))


def holidays(years: DataFrame, year: str = "year", rules: list[tuple] = PUBLIC) -> DataFrame:
    """(country, name, date) of every rule in every different year of a table.

    Null years have none, and a rule has none in a year whose month has no such day.
    """
    own = years.filter(F.col(year).isNotNull()).select(F.col(year).cast("int").alias("year")).distinct()
    ruled = own.select("year", F.inline(F.array(*(_as_row(*rule) for rule in rules))))
    first = F.make_date("year", F.coalesce("month", F.lit(1)), F.lit(1))
    # The first such weekday of the month, or of its last seven days, and whole weeks from there.
    begin = F.when(F.col("which") > 0, first).otherwise(F.date_sub(F.last_day(first), 6))
    weeks = F.when(F.col("which") > 0, F.col("which") - 1).otherwise(F.col("which") + 1)
    weekday = F.date_add(begin, (F.pmod(F.col("weekday") - 1 - F.weekday(begin), F.lit(7)) + 7 * weeks).cast("int"))
    of_month = F.when(F.col("weekday").isNull(), F.date_add(first, F.col("day") - 1)).otherwise(weekday)
    date = F.when(F.col("away").isNotNull(), F.date_add(easter(F.col("year")), F.col("away"))).when(F.month(of_month) == F.col("month"), of_month)
    return ruled.select("country", "name", date.alias("date")).filter(F.col("date").isNotNull())

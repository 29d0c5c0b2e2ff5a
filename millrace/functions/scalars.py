"""Row expressions: numbers, dates, text, arrays, vectors and places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the synodic month, and a new moon as seconds since the epoch (2000-01-06 18:14 UTC).
LUNATION, NEW_MOON = 2551443, 947182440


# Numbers

def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limits that leave nulls null."""
    out = c if low is None else F.when(c < low, F.lit(low)).otherwise(c)
    return out if high is None else F.when(out > high, F.lit(high)).otherwise(out)


def ratio(a: Column, b: Column, guard: str = "null", eps: float = 1e-8) -> Column:
    """a / b; guard: ``null`` where b is 0, ``eps`` to add it to b, ``zero`` for 0 where |b| <= eps."""
    if guard == "eps":
        return a / (b + F.lit(eps))
    if guard == "zero":
        return F.when(F.abs(b) > eps, F.try_divide(a, b)).otherwise(F.lit(0.0))
    return F.try_divide(a, b)


def mapped(c: Column, values: dict, default=None) -> Column:
    """Value map; what it lacks becomes ``default``."""
    whens = reduce(lambda w, kv: w.when(c == F.lit(kv[0]), F.lit(kv[1])), values.items(), F)
    return whens.otherwise(F.lit(default))


def coerced(c: Column, kind: str = "double") -> Column:
    """Cast in which what doesn't parse becomes null."""
    return F.trim(c).try_cast(kind)


def hashed(key: Column | str, seed: int = 42) -> Column:
    """A number from 0 to 2^32 - 1 from a key and a seed, by MD5, so that other engines can give it, too."""
    c = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def rounded(c: Column, digits: int) -> Column:
    """Rounded as DuckDB rounds doubles: the value times 10^digits as a double, exact halves away from zero.

    Spark's own ``round`` goes by the shortest decimals of the value, which can be half where the scaled double is just below.
    """
    scaled = c.cast("double") * F.lit(10.0**digits)
    even = F.rint(scaled)  # halves to the even neighbour
    back = scaled - even
    away = F.when((back == 0.5) & (scaled > 0), F.lit(1.0)).when((back == -0.5) & (scaled < 0), F.lit(-1.0)).otherwise(F.lit(0.0))
    return (even + away) / F.lit(10.0**digits)


# Statistics across columns are plain arithmetic, not functions of arrays, so that Spark compiles them and finds what they share.

def _filled(cols: list[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in cols]


def _added(values: list[Column]) -> Column:
    return reduce(lambda a, x: a + F.coalesce(x, F.lit(0.0)), values, F.lit(0.0))


def row_count(cols: list[str]) -> Column:
    """Columns that are not null."""
    return reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_values(cols: list[str]) -> Column:
    return F.array_compact(F.array(*_filled(cols)))


def row_min(cols: list[str]) -> Column:
    """The least value across columns, without nulls."""
    return F.least(*_filled(cols)) if len(cols) > 1 else _filled(cols)[0]


def row_sum(cols: list[str]) -> Column:
    return _added(_filled(cols))


def row_mean(cols: list[str]) -> Column:
    return F.try_divide(row_sum(cols), row_count(cols))


def _moment(cols: list[str], p: int) -> Column:
    """The sum of the values' differences from their mean, to the power 2 or 4."""
    apart = [x - row_mean(cols) for x in _filled(cols)]
    square = [d * d for d in apart]
    return _added(square if p == 2 else [q * q for q in square])


def row_var(cols: list[str]) -> Column:
    """Sample variance across columns, without nulls."""
    n = row_count(cols)
    return _moment(cols, 2) / F.when(n > 1, n - 1)


def row_std(cols: list[str]) -> Column:
    return F.sqrt(row_var(cols))


def row_kurtosis(cols: list[str]) -> Column:
    """Bias-corrected excess kurtosis across columns, without nulls; null under four values, 0 where all are equal."""
    enough = row_count(cols) >= 4
    n = F.when(enough, row_count(cols).cast("double"))
    square = _moment(cols, 2) / n
    excess = F.try_divide(_moment(cols, 4) / n, square * square) - 3
    return F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6), F.when(enough, F.lit(0.0)))


def row_missing(cols: list[str]) -> Column:
    return F.lit(len(cols)) - row_count(cols)


def row_nonzero(cols: list[str]) -> Column:
    return reduce(lambda a, x: a + F.coalesce((x != 0).cast("int"), F.lit(0)), _filled(cols), F.lit(0))


def row_argmax(cols: list[str]) -> Column:
    """Position of the first largest column."""
    a = F.array(*(F.col(c).cast("double") for c in cols))
    return F.array_position(a, F.array_max(a)) - 1


def row_top_k(scores: dict[str, Column], k: int) -> Column:
    """Labels of the k best scores, best first, joined by spaces; ties go by label."""
    pairs = F.array(*(F.struct((-c).alias("s"), F.lit(n).alias("n")) for n, c in scores.items()))
    return F.array_join(F.transform(F.slice(F.sort_array(pairs), 1, k), lambda x: x["n"]), " ")


# Dates

def date_parts(c: str) -> dict[str, Column]:
    d = F.col(c)
    return {
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "dayofweek": F.weekday(d), "dayofyear": F.dayofyear(d),
        "week": F.weekofyear(d), "quarter": F.quarter(d), "days_in_month": F.dayofmonth(F.last_day(d)),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"), "is_month_end": (F.to_date(d) == F.last_day(d)).cast("int"),
        "is_year_start": (F.dayofyear(d) == 1).cast("int"), "is_year_end": ((F.month(d) == 12) & (F.dayofmonth(d) == 31)).cast("int"),
        "is_weekend": (F.weekday(d) >= 5).cast("int"), "is_payday": ((F.dayofmonth(d) == 15) | (F.to_date(d) == F.last_day(d))).cast("int"),
    }


def cyclical(c: Column, period: float) -> tuple[Column, Column]:
    angle = c * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def moon_phase(c: Column) -> Column:
    """Share of the lunation that has passed, from 0 to 1."""
    return F.pmod(F.unix_timestamp(c.cast("timestamp")) - F.lit(NEW_MOON), F.lit(LUNATION)) / F.lit(LUNATION)


def days_to(c: Column, month: int, day: int) -> Column:
    """Days to a fixed date of the same year; negative after it."""
    return F.datediff(F.make_date(F.year(c), F.lit(month), F.lit(day)), c)


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, by the anonymous computus."""
    div = lambda a, b: F.floor(a / F.lit(b))
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    el = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + el - 7 * div(a + 11 * h + 22 * el, 451) + 114
    return F.make_date(year.cast("int"), div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def months_between_starts(a: Column, b: Column) -> Column:
    return 12 * (F.year(a) - F.year(b)) + F.month(a) - F.month(b)


# Text

def words(c: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def cleaned(c: Column) -> Column:
    """Lower case, without tags, addresses and all but letters and digits, single spaces."""
    out = F.regexp_replace(F.lower(c), r"<[^>]*>", " ")
    out = F.regexp_replace(out, r"https?://[^ ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9 ]", " "), r" +", " "))


def text_features(c: str) -> dict[str, Column]:
    t = F.col(c)
    n = F.length(t)
    return {
        "n_chars": n, "n_words": F.size(words(t)), "n_non_space": F.length(F.regexp_replace(t, r"\s", "")),
        "n_exclaim": F.regexp_count(t, F.lit("!")), "n_question": F.regexp_count(t, F.lit(r"\?")), "n_upper": F.regexp_count(t, F.lit("[A-Z]")),
        "punct_ratio": F.try_divide(F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")), n), "unique_ratio": F.try_divide(F.size(F.array_distinct(words(F.lower(t)))), F.size(words(t))),
    }


def token_flags(c: str) -> dict[str, Column]:
    """What kind of token a string is."""
    t = F.col(c)
    flag = lambda p: t.rlike(p).cast("int")
    return {
        "is_title": flag(r"^\p{Lu}[^\p{Lu}]*$"), "is_upper": (flag(r"\p{Lu}") == 1).cast("int") * (~t.rlike(r"\p{Ll}")).cast("int"), "is_digit": flag(r"^[0-9]+$"),
        "is_alpha": flag(r"^\p{L}+$"), "has_at": flag("@"), "has_digit": flag("[0-9]"), "n_chars": F.length(t), "prefix": F.substring(t, 1, 3), "suffix": F.right(t, F.lit(3)),
    }


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """Common and joint distinct words of two texts, and their shares."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    both, joint = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return {"n_common": both, "n_joint": joint, "jaccard": F.try_divide(both, joint), "share_a": F.try_divide(both, F.size(x)), "share_b": F.try_divide(both, F.size(y))}


def substituted(c: Column, source: str, target: str) -> Column:
    """Substitution cipher: each character of ``source`` becomes its twin in ``target``."""
    return F.translate(c, source, target)


def shifted(c: Column, by: int) -> Column:
    """Caesar shift of the ASCII letters."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turn = lambda s: s[by % 26 :] + s[: by % 26]
    return F.translate(c, low + up, turn(low) + turn(up))


def without_tags(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go, white space is single."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[ \n\r\t]+", " "))


def url_parts(c: str) -> dict[str, Column]:
    u = F.col(c)
    host = F.regexp_extract(u, r"^[a-z]+://([^/:?#]*)", 1)
    path = F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return {
        "scheme": F.regexp_extract(u, r"^([a-z]+)://", 1), "host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "path": path,
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")), "has_query": u.contains("?").cast("int"), "url_length": F.length(u),
    }


# JSON

def json_names(cell: Column, field: str = "name") -> Column:
    """A field of each dictionary of a list in a text cell; none where the cell doesn't parse."""
    names = F.transform(F.from_json(cell, f"array<struct<`{field}`: string>>"), lambda x: x[field])
    return F.coalesce(names, F.array().cast("array<string>"))


def flattened(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested records as columns of joined names, at any depth."""

    def leaves(schema, path: tuple[str, ...]):
        for f in schema.fields:
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, ())))


# Arrays and vectors

def differences(a: Column) -> Column:
    """a[i+1] - a[i]; empty under two elements."""
    return F.when(F.size(a) > 1, F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda y, x: y - x)).otherwise(F.filter(a, lambda x: F.lit(False)))


def sign_changes(a: Column) -> Column:
    signs = F.filter(F.transform(differences(a), lambda x: F.signum(x)), lambda s: s != 0)
    return F.size(F.filter(F.transform(signs, lambda s, i: s != F.get(signs, i - 1)), lambda b: b))


def is_monotone(a: Column) -> Column:
    d = differences(a)
    return F.forall(d, lambda x: x >= 0) | F.forall(d, lambda x: x <= 0)


def last_elements(a: Column, n: int) -> Column:
    """The last n elements, the last one first; 0 where there are fewer."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i <= F.size(a), F.get(a, F.size(a) - i)).otherwise(F.lit(0)))


def repeated_differences(a: Column, order: int) -> Column:
    for _ in range(order):
        a = differences(a)
    return a


def is_constant(a: Column, least: int = 3) -> Column:
    """Whether at least ``least`` elements are all equal."""
    return (F.size(a) >= least) & F.forall(a, lambda x: x == F.get(a, F.lit(0)))


def greatest_common_divisor(a: Column, rounds: int = 92) -> Column:
    """Of the non-zero elements' sizes, 0 without any. Euclid's steps for two elements are bounded: 92 are enough for 64 bits."""

    def step(s: Column, _: Column) -> Column:
        return F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y")))

    def both(x: Column, y: Column) -> Column:
        start = F.struct(x.alias("x"), y.alias("y"))
        return F.when(x == 1, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["x"]))

    return F.aggregate(F.transform(a, lambda x: F.abs(x).cast("long")), F.lit(0).cast("long"), lambda s, x: F.when(x == 0, s).otherwise(both(x, s)))


def ratios(a: Column) -> Column:
    """a[i+1] / a[i] where a[i] isn't 0."""
    pairs = F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), a, lambda y, x: F.try_divide(y.cast("double"), x.cast("double")))
    return F.filter(pairs, lambda r: r.isNotNull())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


# Places

def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(h))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def rotated(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    a = F.radians(F.lit(degrees))
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def grid_cell(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))

"""Sequences: the linear recurrence that one obeys, and how sequences that begin alike go on."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, passing, saved
from .relational import join_groups

#: Two primes; coefficients are found modulo both and put together.
PRIMES = (1 << 61) - 1, (1 << 89) - 1
#: Multipliers of the two hashes that stand for a prefix.
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def shortest_recurrence(terms: list[int], p: int, most: int) -> list[int] | None:
    """Coefficients c of the shortest recurrence s[i] = c[0] s[i-1] + c[1] s[i-2] + ... modulo p; None if it is longer than ``most`` (Berlekamp and Massey)."""
    now, before, order, gap, base = [1], [1], 0, 1, 1
    for i in range(len(terms)):
        off = terms[i] % p
        for j in range(1, order + 1):
            if j < len(now):
                off = (off + now[j] * terms[i - j]) % p
        if not off:
            gap += 1
            continue
        scale, old = off * pow(base, -1, p) % p, now
        now = now + [0] * (len(before) + gap - len(now))
        for j, b in enumerate(before):
            now[j + gap] = (now[j + gap] - scale * b) % p
        if 2 * order <= i:
            order, before, base, gap = i + 1 - order, old, off, 1
            if order > most:
                return None
        else:
            gap += 1
    now += [0] * (order + 1 - len(now))
    return [-c % p for c in now[1 : order + 1]]


def as_fraction(residue: int, modulus: int) -> Fraction | None:
    """The fraction of small numerator and denominator that has this residue."""
    bound = math.isqrt(modulus // 2)
    a, b, s, t = modulus, residue % modulus, 0, 1
    while b > bound:
        q = a // b
        a, b, s, t = b, a - q * b, t, s - q * t
    return Fraction(b, t) if t and abs(t) <= bound and math.gcd(b, t) == 1 else None


def recurrence(terms: list[int], most: int, spare: int) -> tuple[list[Fraction], int | None] | None:
    """(coefficients, next term) of the shortest recurrence of order ``most`` or less that all terms obey, with ``spare`` terms or more beyond those that fix it.

    The next term is None where it is no whole number.
    """
    if not terms:
        return None
    found = [shortest_recurrence(terms, p, most) for p in PRIMES]
    if None in found or len(found[0]) != len(found[1]) or len(terms) < 2 * len(found[0]) + spare:
        return None
    (p, q), out = PRIMES, []
    for a, b in zip(*found):
        c = as_fraction((a + p * ((b - a) * pow(p, -1, q) % q)) % (p * q), p * q)
        if c is None:
            return None
        out.append(c)
    following = lambda i: sum((c * terms[i - j] for j, c in enumerate(out, 1)), Fraction(0))
    if any(following(i) != terms[i] for i in range(len(out), len(terms))):
        return None
    ahead = following(len(terms))
    return out, int(ahead) if ahead.denominator == 1 else None


def recurrences(sequence: str, most: int = 6, spare: int = 1) -> Column:
    """The recurrence of an array column of whole numbers, or of texts of such, as a struct: order, coefficients (texts, the latest term's first) and next.

    A sequence of zeros has order 0. Found modulo two primes, and checked on all terms without bounds on their size;
    coefficients may be fractions ("3/2"), of numerators and denominators under 2^74. ``next`` is a text, so it can't overflow; it is null where it would be
    no whole number. The whole is null for an empty or null sequence, for one with a null or a term that is no whole
    number, and where no recurrence of order ``most`` or less is borne out by ``spare`` terms.
    """

    @F.pandas_udf("order int, coefficients array<string>, next string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for terms in b:
                try:
                    r = recurrence([int(x) for x in terms], most, spare)
                except (TypeError, ValueError):  # no sequence, a null, or no whole number
                    r = None
                rows.append((None, None, None) if r is None else (len(r[0]), [str(c) for c in r[0]], None if r[1] is None else str(r[1])))
            yield pd.DataFrame(rows, columns=["order", "coefficients", "next"]).astype({"order": "Int32"})

    out = found(F.transform(sequence, lambda x: x.cast("string")))
    return F.when(out["order"].isNotNull(), out)


def _hashes(sequence: str) -> Column:
    """Two hashes of every prefix of an array, from the empty one on, as arrays a and b; null elements equal each other."""

    @F.pandas_udf("a array<long>, b array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        powers = {m: np.ones(1, np.uint64) for m in (_M1, _M2)}
        for b in batches:
            out = []
            for x in b:
                x = np.asarray(x, np.int64).view(np.uint64)
                row = []
                for m, p in powers.items():
                    if len(p) < len(x):
                        p = powers[m] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * len(x), m, np.uint64)]))
                    row.append(np.concatenate([[np.uint64(0)], np.cumsum((x ^ (x >> np.uint64(31))) * p[: len(x)])]).astype(np.uint64).view(np.int64))
                out.append(row)
            yield pd.DataFrame(out, columns=["a", "b"])

    return hashed(F.transform(sequence, lambda x: F.xxhash64(x, x.isNull())))


def continuations(table: DataFrame, sequence: str) -> DataFrame:
    """(length, a, b, n, next): each prefix that some sequence goes on after, how often, and with what most often (ties: the least).

    Equal prefixes are counted with what follows before anything is shuffled, so a prefix that very many
    sequences share takes a row for each element that follows it.
    """
    rows = table.filter(F.size(sequence) > 0).select(F.col(sequence).alias("s"), _hashes(sequence).alias("h"))
    each = rows.select(F.posexplode("s").alias("length", "next"), "h").select("length", F.get("h.a", F.col("length")).alias("a"), F.get("h.b", F.col("length")).alias("b"), "next")
    counted = each.groupBy("length", "a", "b", "next").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("next").isNull().alias("none"), "next"))["next"]
    return counted.groupBy("length", "a", "b").agg(F.sum("n").alias("n"), first.alias("next"))


def longest_prefix(queries: DataFrame, table: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, length, n, next): the longest beginning of each query's sequence after which sequences of ``table`` go on, how many do, and with what most often.

    Ties go to the least element. A null or empty sequence has the empty beginning; length is null only where the
    table has no element at all. A prefix is known by two 64-bit hashes. If a prefix is in the table, all shorter ones are, so its
    length is found by binary search: each round joins the different prefixes in question, not their queries,
    with the table's, and a prefix that very many queries have is handed back by a broadcast.
    """
    with passing() as keep:
        known = saved(continuations(table, sequence), "prefixes")
        rows = queries.select(F.col(key).alias("key"), F.coalesce(F.col(sequence), F.array().cast(queries.schema[sequence].dataType)).alias("s"))
        asked = saved(rows.withColumn("h", _hashes("s")).select(F.monotonically_increasing_id().alias("q"), "key", F.size("s").alias("size"), "h"), "asked")
        total = asked.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
        state = saved(asked.select("q", F.lit(0).alias("low"), F.col("size").alias("high")), "state")
        at = ["length", "a", "b"]
        probed = lambda rows: rows.select("*", F.get("h.a", F.col("length")).alias("a"), F.get("h.b", F.col("length")).alias("b")).drop("h")

        def met(rows: DataFrame, columns: list[str]) -> DataFrame:
            """Rows (length, a, b and more) with what the table knows of their prefix, null where it doesn't."""
            counts = saved(rows.groupBy(*at).agg(F.count("*").alias("asks")).join(known.select(*at, *columns, F.lit(True).alias("there")), at, "left"), "probes")
            most = counts.agg(F.sum("asks").alias("all"), F.max("asks").alias("most")).first()
            return join_groups(rows, counts, at, "asks", most["all"] or 0, most["most"] or 0)

        for _ in range(int(total["size"] or 0).bit_length()):
            turn = state.join(asked.select("q", "h"), "q").withColumn("length", F.ceil((F.col("low") + F.col("high")) / 2).cast("int"))
            turn = saved(probed(turn), "turn")
            there = F.coalesce("there", F.lit(False)) | (F.col("low") == F.col("high"))
            new = saved(met(turn, []).select("q", F.when(there, F.col("length")).otherwise(F.col("low")).alias("low"), F.when(there, F.col("high")).otherwise(F.col("length") - 1).alias("high")), "state")
            discard(state)
            state = new
        last = saved(probed(state.join(asked.select("q", "key", "h"), "q").withColumn("length", F.col("low"))).select("key", *at), "last")
        out = saved(met(last, ["n", "next"]).select("key", F.when(F.col("there"), F.col("length")).alias("length"), "n", "next"), "found")
        keep(out)
    return out.withColumnRenamed("key", key)


def predicted_next(queries: DataFrame, table: DataFrame, key: str, sequence: str, most: int = 6, least: int = 2) -> DataFrame:
    """(key, method, next): what follows each sequence of whole numbers, as text: by its own recurrence, else by how others go on after the whole of it.

    ``method`` is recurrence or lookup; where neither says anything, and for lookups of fewer than ``least`` elements, both are null.
    A key has one row, of its sequences any one.
    """
    rows = queries.dropDuplicates([key])
    own = rows.select(F.col(key).alias("__key"), F.size(sequence).alias("__size"), recurrences(sequence, most)["next"].alias("__own"))
    found = longest_prefix(rows, table, key, sequence).select(F.col(key).alias("__key"), "length", F.col("next").cast("string").alias("__next"))
    fits = (F.col("length") == F.col("__size")) & (F.col("length") >= least)
    method = F.when(F.col("__own").isNotNull(), "recurrence").when(fits & F.col("__next").isNotNull(), "lookup")
    return own.join(found, "__key", "left").select(F.col("__key").alias(key), method.alias("method"), F.coalesce("__own", F.when(fits, F.col("__next"))).alias("next"))

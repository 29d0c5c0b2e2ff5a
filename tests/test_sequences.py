"""Recurrences and prefixes of sequences, against plain definitions."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.operators import sequences as S


def grown(start, coefficients, n):
    out = list(start)
    while len(out) < n:
        out.append(sum(c * out[-j] for j, c in enumerate(coefficients, 1)))
    return out


@given(st.lists(st.integers(-30, 30), min_size=1, max_size=5), st.lists(st.integers(-50, 50), min_size=5, max_size=5))
@settings(max_examples=200, deadline=None)
def test_planted_recurrences_are_found(coefficients, start):
    k = len(coefficients)
    terms = grown(start[:k], coefficients, 2 * k + 4)
    found = S.recurrence(terms, k, 1)
    assert found is not None
    out, ahead = found
    assert len(out) <= k and ahead == grown(start[:k], coefficients, 2 * k + 5)[-1]
    for i in range(len(out), len(terms)):
        assert sum(c * terms[i - j] for j, c in enumerate(out, 1)) == terms[i]


@given(st.lists(st.integers(-3, 3), min_size=7, max_size=9))
@settings(max_examples=200, deadline=None)
def test_no_shorter_recurrence_exists(terms):
    """By elimination over fractions: the order found is the least that solves all equations."""

    def solvable(k):
        rows = [[Fraction(terms[i - j]) for j in range(1, k + 1)] + [Fraction(terms[i])] for i in range(k, len(terms))]
        done = 0
        for c in range(k):
            at = next((r for r in range(done, len(rows)) if rows[r][c]), None)
            if at is None:
                continue
            rows[done], rows[at] = rows[at], rows[done]
            for r in range(len(rows)):
                if r != done and rows[r][c]:
                    f = rows[r][c] / rows[done][c]
                    rows[r] = [x - f * y for x, y in zip(rows[r], rows[done])]
            done += 1
        return not any(r[-1] for r in rows[done:])

    found = S.recurrence(terms, 3, 1)
    least = next((k for k in range(4) if solvable(k)), None)
    assert (found is None and (least is None or len(terms) < 2 * least + 1)) or len(found[0]) == least


CASES = [
    ([0, 1, 1, 2, 3, 5, 8, 13], (2, ["1", "1"], "21")), ([7] * 5, (1, ["1"], "7")), ([0] * 4, (0, [], "0")), ([5, 0, 0, 0], (1, ["0"], "0")), ([1, 4, 9, 16, 25, 36, 49], (3, ["3", "-3", "1"], "64")),
    ([16, 24, 36, 54], (1, ["3/2"], "81")), ([8, 12, 18, 27], (1, ["3/2"], None)), ([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], None), ([1, 2], None), ([1], None), ([], None), (None, None), ([1, 2, None, 8, 16], None),
    ([2**62, 2**62, 2**62], (1, ["1"], str(2**62))),
]


def test_recurrences_of_columns(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "id int, s array<long>").repartition(2)
    got = {r.id: r.r for r in df.select("id", S.recurrences("s").alias("r")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert (tuple(got[i]) if got[i] else None) == want, CASES[i]


def test_terms_of_any_size(spark):
    big = grown([1, 1], [10**15, 3], 12)
    rows = [(1, [str(x) for x in big]), (2, ["1", "two", "3", "4"]), (3, [" 4", "8 ", "16", "32"])]
    got = {r.id: r.r for r in spark.createDataFrame(rows, "id int, s array<string>").select("id", S.recurrences("s").alias("r")).collect()}
    assert tuple(got[1]) == (2, [str(10**15), "3"], str(grown([1, 1], [10**15, 3], 13)[-1])) and got[2] is None and got[3].next == "64"


def plain_prefix(sequence, table):
    for n in range(len(sequence or []), -1, -1):
        after = Counter(t[n] for t in table if t and len(t) > n and t[:n] == (sequence or [])[:n])
        if after:
            most = max(after.values())
            return n, sum(after.values()), min((x for x, c in after.items() if c == most), key=lambda x: (x is None, x))
    return None, None, None


@pytest.mark.parametrize("heavy", [1000, 3])
def test_longest_prefix_equals_plain_search(spark, monkeypatch, heavy):
    monkeypatch.setattr(R, "HEAVY", heavy)
    rng = random.Random(heavy)
    make = lambda: [rng.choice([1, 1, 2, None]) if rng.random() < 0.9 else rng.randint(-9, 9) for _ in range(rng.randint(0, 12))]
    table = [make() for _ in range(60)] + [[1, 2, 1, 2, 1, 2]] * 20 + [None, []]
    asked = [make() for _ in range(40)] + [[1, 2, 1, 2, 9]] * 15 + [None, [], [1] * 40]
    frame = lambda rows: spark.createDataFrame([(i, s, "x") for i, s in enumerate(rows)], "id long, s array<long>, length string").repartition(3)
    got = {r.id: (r.length, r.n, r.next) for r in S.longest_prefix(frame(asked), frame(table), "id", "s").collect()}
    assert got == {i: plain_prefix(s, table) for i, s in enumerate(asked)}


def test_prefixes_of_texts_and_nothing(spark):
    df = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x", "y"]), ("c", ["q"])], "id string, s array<string>")
    got = {r.id: (r.length, r.n, r.next) for r in S.longest_prefix(df, df, "id", "s").collect()}
    assert got == {"a": (2, 1, "z"), "b": (2, 1, "z"), "c": (0, 3, "x")}
    assert S.longest_prefix(df.limit(0), df, "id", "s").count() == 0
    assert [tuple(r)[1:] for r in S.longest_prefix(df, df.limit(0), "id", "s").collect()] == [(None, None, None)] * 3


def test_predictions_by_either_way(spark):
    table = spark.createDataFrame([(1, [4, 9, 2, 7, 7]), (2, [4, 9, 2, 8]), (3, [4, 9, 2, 7])], "id int, s array<long>")
    asked = spark.createDataFrame([(1, [1, 2, 4, 8, 16]), (2, [4, 9, 2]), (3, [4, 8, 1]), (4, None), (5, [4])], "id int, s array<long>")
    got = {r.id: (r.method, r.next) for r in S.predicted_next(asked, table, "id", "s").collect()}
    assert got == {1: ("recurrence", "32"), 2: ("lookup", "7"), 3: (None, None), 4: (None, None), 5: (None, None)}

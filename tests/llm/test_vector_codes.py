from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import vector_codes as V


def nearest(points, book):
    """Plain integers: the entry of the least squared distance, the first of equal ones."""
    out = []
    for p in points:
        far = [sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in book]
        out.append(far.index(min(far)))
    return out


def plain(rows, parts, entries, rounds=4, scale=1024):
    """The contract, step by step: rows of (id, vector, label) to (id, code, error, label_error) and the digest."""
    sound = [(i, [math.floor(scale * float(x)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(sound[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in sound[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for z, (_, v, _) in zip(nearest([cut(v, p) for _, v, _ in sound], books[p]), sound):
                own[z].append(cut(v, p))
            for z, vs in own.items():
                books[p][z] = [sum(c) // len(vs) for c in zip(*vs)]
    out, per = [], defaultdict(int)
    for i, v, c in sound:
        at = [nearest([cut(v, p)], books[p])[0] for p in range(parts)]
        error = sum((a - b) ** 2 for p in range(parts) for a, b in zip(cut(v, p), books[p][at[p]]))
        per[c] += error
        out.append([i, "".join(f"{z:02x}" for z in at), error, c])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, e, per[c], digest) for i, code, e, c in out), key=str)


@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 12), st.sampled_from([1, 2, 3, 8]), st.sampled_from([3, 50, 1 << 24, 1 << 30, 1 << 40]), st.sampled_from([1, 4, 16]))
@settings(max_examples=120, deadline=None)
def test_walk_equals_all_distances(seed, n, k, width, most, leaf):
    rng = np.random.default_rng(seed)
    points, book = rng.integers(-most, most, (n, width), endpoint=True), rng.integers(-most, most, (k, width), endpoint=True)
    points[rng.random(n) < 0.3] = points[0]
    book[rng.random(k) < 0.3] = book[0]
    chosen, number, total = V.assign(V.grow(points, leaf), points, book, leaf)
    assert chosen.tolist() == nearest(points, book)
    assert number.tolist() == np.bincount(chosen, minlength=k).tolist()
    for z in range(k):
        assert [int(x) for x in total[z]] == [sum(int(x) for x in points[chosen == z][:, j]) for j in range(width)]


def test_boxes_spare_comparisons():
    rng = np.random.default_rng(1)
    points = (rng.integers(0, 8, 4000)[:, None] * 1000 + rng.integers(0, 20, (4000, 4))).astype(np.int64)
    book = np.array([[i * 1000 + 10] * 4 for i in range(8)])
    counts: dict = {}
    V.assign(V.grow(points), points, book, counts=counts)
    assert counts["nodes"] < 4000 and counts.get("pairs", 0) < 4000 * 8 / 4
    same, counts = np.full((5000, 4), 7), {}
    V.assign(V.grow(same), same, book, counts=counts)
    assert counts == {"nodes": 8}  # the root is one point, so its whole tree goes at once


def test_whole_numbers_are_exact():
    x = np.array([[-0.1, 0.1, 1e-9, -1e-9, 3e38, -3e38, 1.7e308, 0.5]])
    assert [int(v) for v in V.whole_numbers(x)[0]] == [math.floor(1024 * __import__("fractions").Fraction(v)) for v in x[0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, id int")


@pytest.mark.parametrize("entries", [1, 6, 256])
def test_codes_equal_plain_rounds(spark, entries):
    rng = np.random.default_rng(entries)
    rows = [(int(i) if i % 17 else None, [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)], int(i % 3) if i % 4 else None) for i in range(90)]
    rows += [rows[5], rows[5], (None, None, 1), (3, [0.0] * 7 + [None], 1), (4, [float("nan")] + [0.0] * 7, 1), (5, [float("inf")] + [0.0] * 7, None), (1 << 60, [0.25] * 8, 2), (7, [], 1), (8, [1.0, 2.0, 3.0], 1), (9, [1.0] * 4, 1)]
    want = plain([r for r in rows if r[1] is None or len(r[1]) == 8], 4, entries)
    df = frame(spark, [(i, v, c, "x", 0) for i, v, c in rows]).repartition(5)
    got = V.vector_codes(df, entries=entries, block=32, leaf=2)
    assert sorted(map(tuple, got.table.collect()), key=str) == want
    assert [len(b) for b in got.books] == [min(entries, 93)] * 4


def test_large_components_and_wide_labels(spark):
    rows = [(i, [float(2**20 * (i % 5 - 2)), float(i), 1e3 * i, -0.5], "label") for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, V.vector_codes(df, entries=7).table.collect()), key=str) == plain(rows, 4, 7)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, "", 0), (2, [float("nan")] * 8, 1, "", 0), (3, [], 2, "", 1)]):
        got = V.vector_codes(frame(spark, rows))
        assert got.table.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.table.count() == 0
        assert [len(b) for b in got.books] == [0] * 4


def test_codes_give_vectors_back(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 8) / 8], 0, "", 0) for i in range(60)]
    got = V.vector_codes(frame(spark, rows))  # as many entries as vectors, so nothing is lost but half a step
    back = {r.vec_id: r.v for r in got.table.select("vec_id", V.decoded("code", got.books).alias("v")).collect()}
    for i, v, *_ in rows:
        assert np.allclose(back[i], v, atol=0.5 / 1024 + 1e-12)

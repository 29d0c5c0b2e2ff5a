from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import languages as L

WORDS = {
    "a": "the and river stone with from water house morning nothing",
    "b": "der und haus wasser nicht schön über straße morgen zwischen",
    "c": "город вода камень утро между ничего дорога слово",
}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def grams():
    return L.Grams()


@pytest.fixture(scope="module")
def profiles(spark):
    rng = random.Random(1)
    rows = [(i, text(lang, 30, rng), lang) for i, lang in enumerate("abc" * 30)]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))


def windows(text):
    """The n-grams as strings, by the definition."""
    places = [c if c.isalpha() else " " for c in " " + text.lower() + " "]
    places = [c for c, before in zip(places, ["x", *places]) if c != " " or before != " "]
    for n in L.ORDERS:
        for i in range(len(places) - n + 1):
            w = places[i : i + n]
            gap = [c == " " for c in w]
            if not any(gap[1:-1]) and not (gap[0] and gap[-1]):
                yield "".join(w)


@given(st.lists(st.text("abé C1.\n日", max_size=40), max_size=8))
@settings(max_examples=80, deadline=None)
def test_buckets_are_those_of_plain_windows(texts):
    g = L.Grams(16)
    found = {i: (at, n) for i, at, n in g.counts(texts)}
    assert sorted(found) == list(range(len(texts)))
    for i, t in enumerate(texts):
        want = Counter()
        for w in windows(t):
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in w:
                    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0 if c == " " else ord(c)) + np.uint64(1)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            want[int(x >> np.uint64(48))] += 1
        assert dict(zip(found[i][0].tolist(), found[i][1].tolist())) == want
    assert g.summed(texts).sum() == sum(n.sum() for _, n in found.values())


def test_pieces_lose_nothing(grams, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab .é") for _ in range(n)) for n in (0, 1, 49, 50, 51, 99, 100, 101, 500, 1003)]
    whole = [(at.tolist(), n.tolist()) for _, at, n in sorted(grams.counts(texts), key=lambda x: x[0])]
    for piece in (1, 2, 3, 5, 50):
        monkeypatch.setattr(L, "_PIECE", piece)
        assert [(at.tolist(), n.tolist()) for _, at, n in sorted(grams.counts(texts), key=lambda x: x[0])] == whole


def test_expectation_maximisation_climbs_to_the_top():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(50), 3).T
    n = rng.multinomial(2000, p @ [0.5, 0.3, 0.2]).astype(float)
    share, fit = L.maximised(n, p)
    assert abs(share.sum() - 1) < 1e-9 and np.abs(share - [0.5, 0.3, 0.2]).max() < 0.1
    for other in rng.dirichlet(np.ones(3), 500):
        assert fit >= n @ np.log(p @ other) - 0.05
    assert math.isclose(L.maximised(n, p[:, :1])[1], n @ np.log(p[:, 0]))


def test_the_early_end_changes_no_choice():
    """The slope bound only skips mixtures that can't win: the sets are those that all mixtures give."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        p = rng.dirichlet(np.ones(40) * 0.3, 3).T + 1e-6
        shares = rng.dirichlet(np.ones(3) * 0.3)
        n = rng.multinomial(int(rng.integers(1, 300)), (p @ shares) / (p @ shares).sum()).astype(float)
        kept = n > 0
        chosen, found = L.mixture(n[kept], np.log(p[kept]))
        penalty = L.LEAST_GAIN + L.PENALTY * math.log2(1 + n.sum())
        value = lambda s: L.maximised(n[kept], p[kept][:, s])[1] - penalty * (len(s) - 1)
        best = max(value([i]) for i in range(3))
        assert value(list(chosen)) >= best - 1e-9
        if len(chosen) == 1:
            assert value([0, 1, 2]) <= best + 0.05
        assert abs(found.sum() - 1) < 1e-9 and (np.diff(found) <= 0).all()


def test_mixed_texts_show_their_shares(profiles, grams):
    rng = random.Random(7)
    mixed = text("a", 140, rng) + " " + text("b", 60, rng)
    single, both, none, short = L.predict(profiles, [text("c", 50, rng), mixed, "123 !?", "wasser"], grams)
    assert single[0] == "c" and single[2] == ["c"] and single[1] > 0.95
    assert both[0] == "a" and both[2] == ["a", "b"] and 0.55 < both[3][0] < 0.8
    assert none == ("und", 0.0, [], [])
    assert short[0] == "b" and short[1] < single[1]


def test_odd_rows(spark, profiles):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " 12 \n"), (4, text("b", 12, rng)), (4, text("b", 12, rng)), (None, text("a", 12, rng)), (6, (text("c", 40, rng) + ". ") * 2000), (7, "日本語"), (8, "\u0000x the and퟿")]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = L.predicted(df, profiles, extra={"even": F.col("doc_id") % 2 == 0})
    assert got.columns == ["doc_id", "even", "lang_pred", "score", "languages", "shares"]
    rows = sorted(got.collect(), key=lambda r: (r.doc_id or 0))
    assert [r.lang_pred for r in rows[:7]] == ["a", "und", "und", "und", "b", "b", "c"]
    assert rows[7].lang_pred in "abc" and all(0 <= r.score <= 1 for r in rows)
    assert L.predicted(df.limit(0), profiles).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None), (2, None, "a")], "doc_id long, text string, lang string")
    empty = L.fit(df)
    assert empty.languages == ()
    assert [tuple(r) for r in L.predicted(df, empty).select("lang_pred", "score").collect()] == [("und", 0.0)] * 2


def test_profiles_do_not_depend_on_partitions(spark, profiles):
    rng = random.Random(1)
    rows = [(i, text(lang, 30, rng), lang) for i, lang in enumerate("abc" * 30)]
    other = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1))
    assert other.languages == profiles.languages == ("a", "b", "c") and np.array_equal(other.log, profiles.log)


def test_held_out_languages(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()["op13_languages"](spark, d)
    met = got.join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert met[0] > 0.97 and met[1] > 150

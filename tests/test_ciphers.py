"""Substitution ciphers with planted keys."""

from __future__ import annotations

import random
import string

import numpy as np

from millrace.operators import ciphers as C

ALPHABET = string.ascii_lowercase + " .,"


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz"[: rng.randint(5, 26)]) for _ in range(rng.randint(2, 9))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) + "." for _ in range(n)]


def encrypted(text, key, rng, wrong):
    return "".join(rng.choice(ALPHABET) if rng.random() < wrong else key.get(c, c) for c in text)


def planted(seed):
    rng = random.Random(seed)
    to = list(ALPHABET)
    rng.shuffle(to)
    return dict(zip(ALPHABET, to))


def test_planted_key_is_recovered_with_wrong_characters(spark):
    plain, key, rng = texts(120, 1), planted(2), random.Random(3)
    rows = [(i, t) for i, t in enumerate(plain)] + [(500, plain[3]), (501, None), (502, ""), (None, "no id at all but text")]
    secret = [(1000 + i, encrypted(t, key, rng, 0.05)) for i, t in enumerate(plain[:80])] + [(2000, "".join(rng.choice(ALPHABET) for _ in range(len(plain[0])))), (2001, None), (2002, "short")]
    make = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, votes string").repartition(3)
    found = C.solve(make(secret), make(rows), "id", "text")
    used = {c for t in plain[:80] for c in t}
    got = {r.cipher: r.plain for r in found.key.collect()}
    assert all(got[key[c]] == c for c in used)
    matches = {r.id: (r.plain_id, r.accuracy) for r in found.matches.collect()}
    assert all(matches[1000 + i][0] == i and matches[1000 + i][1] > 0.85 for i in range(80)) and not matches.keys() & {2000, 2001, 2002}


def test_padded_ciphers(spark):
    """Cipher texts are padded on both sides to hundreds."""
    plain, key, rng = texts(60, 4), planted(5), random.Random(6)

    def padded(t):
        size = -(-len(t) // 100) * 100
        left = (size - len(t)) // 2
        noise = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
        return noise(left) + encrypted(t, key, rng, 0.02) + noise(size - len(t) - left)

    made = spark.createDataFrame([(i, t, padded(t)) for i, t in enumerate(plain)], "id long, plain string, secret string")
    found = C.solve(made, made, "id", "secret", "id", "plain", padded=100)
    got = {r.cipher: r.plain for r in found.key.collect()}
    assert all(got[key[c]] == c for c in {c for t in plain for c in t})
    assert {r.id: r.plain_id for r in found.matches.collect()} == {i: i for i in range(60)}


def test_nothing_in_common(spark):
    a = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz")], "id long, text string")
    b = spark.createDataFrame([(2, "aabbccddeeffgghhiijjkkllmm")], "id long, text string")
    for x, y in ((a, b), (a, b.limit(0)), (a.limit(0), b)):
        found = C.solve(x, y, "id", "text")
        assert found.key.collect() == [] and found.matches.collect() == []


def test_patterns_ignore_the_letters():
    words = np.stack([C.points(w) for w in ("hello", "xubby", "xubbu", "aaaaa")])
    assert C.patterns(words).tolist() == [[0, 1, 2, 2, 4], [0, 1, 2, 2, 4], [0, 1, 2, 2, 1], [0, 0, 0, 0, 0]]


def test_pairs_are_aligned_once(spark, monkeypatch):
    """Later rounds only align what they match anew; a batch may hold no text that agrees, and ids of plain texts may repeat."""
    plain, key, rng = texts(60, 7), planted(8), random.Random(9)
    known = [(i, t) for i, t in enumerate(plain)] + [(3, plain[3]), (3, plain[3])]
    secret = [(1000 + i, encrypted(t, key, rng, 0.03)) for i, t in enumerate(plain[:30])]
    noise = [(2000 + i, plain[i][:30] + "".join(rng.choice(ALPHABET) for _ in range(len(plain[i]) - 30))) for i in range(30)]
    make = lambda rows: spark.createDataFrame(rows, "id long, text string")
    seen, aligned = [], C._aligned
    monkeypatch.setattr(C, "_aligned", lambda matched, *rest: (seen.extend(map(tuple, matched.select("id", "plain_id").collect())), aligned(matched, *rest))[1])
    found = C.solve(make(secret).coalesce(1).unionAll(make(noise).coalesce(1)), make(known), "id", "text")
    assert len(seen) == len(set(seen)) >= 30
    matches = {r.id: r.plain_id for r in found.matches.collect()}
    assert found.matches.count() == 30 and all(matches[1000 + i] == i for i in range(30))

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from millrace.llm.common import row_keys
from millrace.llm.components import components
from millrace.llm.jaccard_join import Schemes, entries, jaccard_join, most_apart, shingle_sets
from millrace.llm.suffix_dedup import shape, suffix_dedup


def removed(texts: list[str], length: int) -> list[tuple]:
    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [12, 40, 97])
def test_suffix_dedup_equals_brute_force(spark, length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(12)]
    texts = [" ".join(rng.choice([*passages, word(), word(), word(), word()]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += ["a" * 300, "a" * 41, "ab" * 100, "tail" + "ab" * 60, "abc" * 200 + "end" + "abc" * 90, "xyz " * 90 + "end", "", texts[3], "q" * (length - 1), "z" * length, "y" * (length + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(df, "id", "body", length, keep_text=False).collect()}
    for i, want in enumerate(removed(texts, length)):
        assert got[i] == want, (i, texts[i][:60])


def removed_words(texts: list[str], length: int) -> list[tuple]:
    """As ``removed``, by words: (bytes, bytes removed, runs, digest)."""
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    seen = Counter(tuple(m[0] for m in w[i : i + length]) for w in found for i in range(len(w) - length + 1))
    out = []
    for t, w in zip(texts, found):
        gone = [False] * len(t)
        for i in range(len(w) - length + 1):
            if seen[tuple(m[0] for m in w[i : i + length])] > 1:
                gone[w[i].start() : w[i + length - 1].end()] = [True] * (w[i + length - 1].end() - w[i].start())
        kept = "".join(c for c, g in zip(t, gone) if not g).encode()
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(t.encode()), len(t.encode()) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [4, 9, 50])
def test_suffix_dedup_of_words_equals_brute_force(spark, length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(1, 2 * length))) for _ in range(14)]
    texts = ["".join(rng.choice([*passages, word(), word(), word()]) + rng.choice([" ", "\n", " \t "]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += ["a " * 300, "ab cd " * 60, " \n ", "", texts[3], "q " * (length - 1), "z " * length, "y " * (length + 1), "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(df, "id", "body", length, keep_text=False, unit="words").collect()}
    for i, want in enumerate(removed_words(texts, length)):
        assert got[i] == want, (i, texts[i][:60])


def test_suffix_dedup_of_very_long_texts(spark):
    """Texts over a million bytes cross the passes in which anchors are chosen."""
    rng = random.Random(3)
    filler = lambda n: bytes(rng.choices(b"abcdefghijklmnop ", k=n)).decode()
    passage = filler(700)
    texts = [filler((1 << 20) - 350) + passage + filler(4000), filler(90) + passage + filler(60), passage[:399], filler(1_200_000)]
    got = {r.doc_id: r for r in suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(4)] == [700, 700, 0, 0]
    assert got[0].kept == texts[0].replace(passage, "") and got[3].kept == texts[3]


def test_shape_leaves_room_for_a_phrase():
    for length, longest in [(n, k) for n in range(4, 600) for k in (4, 16)]:
        k, w, reach = shape(length, longest)
        assert w + k - 1 <= length and reach >= w and k & (k - 1) == 0


def test_suffix_dedup_odd_rows(spark):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(900))
    rows = [(1, None, "x"), (2, "", "y"), (3, long, "a"), (3, long, "b"), (3, "other", "c"), (None, long[:500] + "tail", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()) for r in suffix_dedup(df).collect())
    assert got == [(0, 504, 500, True), (1, 0, 0, True), (2, 0, 0, True), (3, 5, 0, True), (3, 900, 900, True), (3, 900, 900, True)]
    assert suffix_dedup(df.limit(0)).count() == 0
    carried = suffix_dedup(df.withColumnRenamed("kept", "lang"), carry=["lang"]).filter("doc_id = 1").first()
    assert carried.lang == "x" and carried.kept == ""


def linked(rows: list[tuple], k: int, per_cent: int) -> dict:
    sets, parent = [], list(range(len(rows)))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, t in rows:
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "").translate(lower)).split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d if d is not None else -1), len(sets[i]), best.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k, per_cent, seed", [(4, 85, 1), (5, 80, 2), (1, 70, 3), (2, 50, 4)])
def test_jaccard_join_equals_brute_force(spark, k, per_cent, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(400)]
    line = [rng.choice(vocabulary) for _ in range(12)]
    rows = []
    for group, (size, words, edits) in enumerate([(40, 80, 5), (30, 160, 9), (25, 30, 2), (20, 12, 1), (12, 400, 14), (15, 9, 1), (10, 5, 1)]):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [" ".join([rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] + line) for _ in range(40)]  # one line in common
    rows += ["One Two three four", "one two three FOUR", "one\ttwo", "one two", "", " \n ", "É b c d", "é b c d"]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(df, words=k, per_cent=per_cent).collect())
    assert got == linked(rows, k, per_cent)


def test_jaccard_join_odd_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, None), (None, "alone here"), (9, "long " * 30000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_shingles string")
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id) for r in jaccard_join(df).collect()) == linked(rows, 4, 85)
    assert jaccard_join(df.limit(0)).count() == 0


def test_entries_meet_for_all_linked_sizes():
    """Any two sets that just link share as many entries as either needs."""
    rng = random.Random(9)
    schemes = Schemes(85, 10_000)
    import numpy as np

    for n in [2, 3, 5, 6, 7, 8, 9, 13, 14, 20, 33, 50, 71, 72, 107, 150, 243, 400, 700, 1300]:
        for _ in range(6):
            m = rng.randint(n, n * 100 // 85)
            apart = most_apart(n + m, 85)
            only_b = (apart + m - n) // 2
            only_a = only_b - (m - n)
            if only_a < 0 or only_b < 0:
                continue
            common = [rng.getrandbits(64) for _ in range(n - only_a)]
            a = np.array(sorted({*common, *(rng.getrandbits(64) for _ in range(only_a))}), np.uint64)
            b = np.array(sorted({*common, *(rng.getrandbits(64) for _ in range(only_b))}), np.uint64)
            if not len(a) or not len(b) or 100 * len(common) < 85 * (len(common) + only_a + only_b) or (only_a == 0 and only_b == 0):
                continue
            (x, need_x), (y, need_y) = entries(a, schemes), entries(b, schemes)
            assert len(np.intersect1d(x, y)) >= max(need_x, need_y, 1), (n, m)


def test_small_sets_far_apart_in_size_meet(spark):
    rows = [(1, "a b c"), (2, "a b c d e"), (3, "v w x y"), (4, "v w x y z u"), (5, "k"), (6, "k l")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), words=1, per_cent=50).collect())
    assert got == linked(rows, 1, 50)


def test_row_keys_differ_where_hashes_do_not(spark):
    rows = [(i % 40, f"t{i % 60}") for i in range(240)] + [(None, None), (None, ""), (1, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    key = row_keys(df, "id", "t", first=lambda *c: F.pmod(F.xxhash64(*c), F.lit(9)))
    found = {(r.id, r.t): r.k for r in df.select("id", "t", key.alias("k")).collect()}
    assert len(set(found.values())) == len(set(rows))
    plain = {(r.id, r.t): r.k for r in df.select("id", "t", row_keys(df, "id", "t").alias("k")).collect()}
    assert len(set(plain.values())) == len(set(rows))


def test_one_header_in_very_many_documents(spark):
    """A passage after different text in most documents: found everywhere, with few rows of it in any one task."""
    rng = random.Random(8)
    header = "".join(rng.choice("abcdefgh ") for _ in range(420))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(30 + i % 7)) + header + "".join(rng.choice("qrstuv ") for _ in range(50))) for i in range(500)]
    got = sorted(tuple(r)[:5] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), keep_text=False).collect())
    assert got == [(i, *want) for i, want in enumerate(removed([t for _, t in rows], 400))]


def test_words_in_repeated_passages(spark):
    """Beside what is removed, the words of shorter passages are counted, in texts of any length."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    own = lambda n: " ".join(word() for _ in range(n))
    passages = [own(rng.randint(50, 55)) for _ in range(15)]
    rows = [f"{own(rng.randint(0, 60))}\n{passages[i % 15]} {own(rng.randint(0, 60))}" for i in range(30)]
    repeats = own(60)
    rows += [own(400), f"{repeats} {own(3)} {repeats}", own(49), None, "", passages[0].rsplit(" ", 25)[0], "z " * 50, "y " * 51, "x " * 3000, "v w " * 900 + own(70)]
    got = suffix_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), keep_text=False, passages=50).collect()
    words = [(t or "").split() for t in rows]
    seen = Counter(tuple(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    want = [len({j for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)}) for w in words]
    assert [r.n_passage_words for r in sorted(got)] == want and sum(map(bool, want)) == 34
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got)] == removed([t or "" for t in rows], 400)


def test_shingles_of_few_words():
    sets = shingle_sets(["", "  ", "a", "a b", "a b c d", "A B C D", "a b c d e", "a b c d a b c d"], 4)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 1, 2, 4 + 0]
    assert sets[4] == sets[5] and sets[2][0] != sets[3][0]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 130)}


def test_row_keys_see_which_column_is_null(spark):
    from millrace.llm.common import row_keys

    df = spark.createDataFrame([("x", None), (None, "x"), (None, None), ("x", "x"), ("x", None)], "id string, text string")
    keys = [r.k for r in df.select(row_keys(df, "id", "text").alias("k")).collect()]
    assert len(set(keys)) == 4 and keys[0] == keys[4]

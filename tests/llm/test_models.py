from __future__ import annotations

import random
import re
import string

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import quality_model as Q
from millrace.llm import toxicity as T


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.lists(st.text("abc", min_size=3, max_size=7), min_size=1, max_size=6), st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_automaton_equals_edit_distance(terms, words):
    text = np.array([ord(c) for c in "".join(words)], np.int64)
    ends = np.cumsum([len(w) for w in words])
    a = T.Automaton(tuple(terms), ())
    got = a.match(a.classes[text], ends - [len(w) for w in words], np.array([len(w) for w in words]))
    for w, k in zip(words, got):
        want = T.EXACT if w in terms else T.FUZZY if any(len(t) >= 5 and distance(w, t) <= 1 for t in terms) else 0
        assert k == want, (w, terms)


QUOTED = [
    ('he said "you moron" to them', 1), ('"moron"', 1), ("«un moron là»", 1), ("„ein moron“ meinte", 1), ("“a moron”", 1), ("it's a moron isn't", 0), ("'a moron'", 1),
    ('you moron', 0), ('"nice" moron "nice"', 0), ('"nice\nmoron "', 0), ('"nice\n" moron "', 1), ('" moron', 0), ('moron "', 0), ('"' + "w " * 15 + 'moron"', 0), ('"moron ' + "w " * 15 + '"', 0), ("`moron` and moron", 1),
    ('a "b" c "moron" moron', 1), ("", 0), ('"', 0), ("‘moron’ d’un", 1),
]


def test_quotation_is_told_from_abuse():
    s = T.Scanner(("moron",), ())
    texts, counts = zip(*QUOTED)
    assert np.expm1(s.features(list(texts))[:, 4]).round().astype(int).tolist() == list(counts)
    for t, n in QUOTED:
        assert np.expm1(s.features([t])[0, 4]).round() == n, t


@given(st.lists(st.lists(st.sampled_from(["moron", "moron", "mroon", "morxn", "loweischaft", "fine", "clean", '"moron', 'fine"', ",", "\n", "x\u00e9"]), max_size=40), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_features_equal_plain_counts(lists):
    texts = [" ".join(x) for x in lists]
    got = T.Scanner(("moron",), ("lowei",)).features(texts)
    for t, row in zip(texts, got):
        words = [(m.start(), m[0]) for m in re.finditer(r"[^\W_]+", t.lower())]
        kind = [T.EXACT if w == "moron" else T.STEM if w.startswith("lowei") else T.FUZZY if distance(w, "moron") <= 1 else 0 for _, w in words]
        sure = [i for i, k in enumerate(kind) if k in (T.EXACT, T.STEM)]
        near = max((sum(abs(i - j) <= T.WINDOW for j in sure) for i in sure), default=0)
        quoted = 0
        for i in sure:
            at, end = words[i][0], words[i][0] + len(words[i][1])
            line = t[: at].rfind("\n") + 1
            stop = t.find("\n", end) if "\n" in t[end:] else len(t)
            left, right = t[line:at].count('"'), t.find('"', end, stop)
            if left % 2 and right >= 0:
                mark = t.rfind('"', line, at)
                before = sum(mark < p < at for p, _ in words)
                after = sum(end <= p < right for p, _ in words)
                quoted += before <= T.WINDOW and after <= T.WINDOW
        want = [kind.count(T.EXACT), kind.count(T.STEM), kind.count(T.FUZZY), near, quoted, 100 * len(sure) / max(1, len(words))]
        assert np.allclose(np.expm1(row), want), (t, np.expm1(row), want)


def test_models_on_strange_rows(spark):
    """Clashing columns, repeated rows, nulls and very long texts: a score for each row, alike for like texts."""
    net = Q.train(["good text here", "BAD!! TEXT!!"] * 4, [1, 0] * 4, epochs=2)
    model = T.Model(("moron",), (), (1.0,) * T.FEATURES + (-3.0,))
    rows = [(1, "a moron", 0.5), (1, "a moron", 0.7), (None, None, None), (2, "", 0.1), (3, "moron " * 60_000, 0.2), (1, "other", 0.9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("label", F.lit("x"))
    for out in (T.toxicity(df, model), Q.quality(df, net)):
        got = [(r.doc_id, r.score) for r in out.collect()]
        assert len(got) == 6 and sorted(d for d, _ in got if d) == [1, 1, 1, 2, 3] and len({s for d, s in got if d == 1}) <= 2
        assert next(s for d, s in got if d is None) == next(s for d, s in got if d == 2)


def test_stems_and_context():
    s = T.Scanner(("moron",), ("lowei",))
    x = s.features(["a moron, a \"moron\"", "Loweischaft xlowei", "morron", "", "clean words"])
    assert np.expm1(x[0, [0, 4]]).round().tolist() == [2, 1] and np.expm1(x[1, 1]).round() == 1 and np.expm1(x[2, 2]).round() == 1
    assert not x[3].any() and not x[4].any()


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 6)))
    bad = ["grukzor", "blathix", "vermok"]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic, low = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        if low:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(not low), int(toxic)))
    return rows


def test_models_on_held_out_rows(spark):
    rows = corpus(500, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(900, None), (901, ""), (None, "x"), (902, "y " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (903, None, None)], "doc_id long, quality int, toxic int")
    trains = F.col("doc_id") % 4 != 0
    model = T.fit(docs, labels, trains)
    assert {"grukzor", "blathix", "vermok"} <= set(model.words) | set(model.stems)
    toxic = {r.doc_id: r.score for r in T.toxicity(docs, model).collect()}
    net = Q.fit(docs, labels, trains, size=150)
    good = {r.doc_id: r.score for r in Q.quality(docs, net).collect()}
    for scores, col in ((toxic, 3), (good, 2)):
        held = [(scores[r[0]] >= 0.5) == r[col] for r in rows if r[0] % 4 == 0]
        assert sum(held) >= 0.95 * len(held)
        assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 504
    assert T.toxicity(docs.limit(0), model).count() == 0 and Q.quality(docs.limit(0), net).count() == 0
    one_sided = T.fit(docs, labels.filter("toxic = 0"), trains)
    assert T.toxicity(docs, one_sided).filter("score > 0.5").count() == 0


@given(st.lists(st.text("ab é\n", max_size=400), min_size=1, max_size=4), st.integers(0, 9))
@settings(max_examples=25, deadline=None)
def test_scores_equal_a_plain_forward_pass(texts, seed):
    rng = np.random.default_rng(seed)
    net = Q.Network(rng.normal(0, 0.4, (Q.WIDTH, Q.SYMBOLS, Q.FILTERS)), rng.normal(0, 0.4, Q.FILTERS), rng.normal(0, 0.4, 2 * Q.FILTERS + 1))
    net.table[:, Q.SYMBOLS - 1] = 0
    for text in [*texts, texts[0] * 9]:
        raw = text.encode()
        repeated = [any(raw[i : i + Q.RUN] == raw[i - lag : i - lag + Q.RUN] and i + Q.RUN <= len(raw) and i >= lag for lag in range(2, Q.LAGS + 1)) for i in range(len(raw))]
        n_blocks = max(1, -(-len(raw) // Q.BLOCK))
        s = [b + 256 * r for b, r in zip(raw, repeated)]
        s += [Q.SYMBOLS - 1] * (n_blocks * Q.BLOCK + Q.WIDTH - 1 - len(s))
        z = [[sum(net.table[j, s[i + j], f] for j in range(Q.WIDTH)) for f in range(Q.FILTERS)] for i in range(n_blocks * Q.BLOCK)]
        starts = range(0, max(1, n_blocks - 1), Q.CHUNK - 1)
        h = [[max(0.0, net.bias[f] + max(z[i][f] for i in range(a * Q.BLOCK, min(a + Q.CHUNK, n_blocks) * Q.BLOCK))) for f in range(Q.FILTERS)] for a in starts]
        features = [sum(c[f] for c in h) / len(h) for f in range(Q.FILTERS)] + [max(c[f] for c in h) for f in range(Q.FILTERS)]
        logit = sum(a * b for a, b in zip(features, net.out)) + net.out[-1]
        assert np.isclose(Q.score(net, text), 1 / (1 + np.exp(-np.clip(logit, -30, 30))), atol=1e-9)


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = Q.Network(rng.normal(0, 0.4, (Q.WIDTH, Q.SYMBOLS, Q.FILTERS)), rng.normal(0, 0.4, Q.FILTERS), rng.normal(0, 0.4, 2 * Q.FILTERS + 1))
    net.table[:, Q.SYMBOLS - 1] = 0
    text = "some words of a text, and more of them " * 60
    s = Q.symbols(text)
    loss = lambda: -np.log(1 - Q.score(net, text)) * 0.7  # noqa: E731  of label 0
    for p, g in zip((net.table, net.bias, net.out), Q.gradients(net, s, 0.0, 0.7)):
        places = [tuple(i) for i in np.argwhere(g != 0)]
        for at in [places[i] for i in rng.choice(len(places), min(12, len(places)), replace=False)]:
            kept, found = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = kept + step
                found.append(loss())
            p[at] = kept
            assert np.isclose((found[0] - found[1]) / 2e-6, g[at], rtol=1e-3, atol=1e-6)


def test_repeats_are_seen_and_pieces_join():
    s = Q.symbols("abcdefgh " * 10)
    assert (s >= 256).sum() - Q.WIDTH + 1 > 30 and len(Q.symbols("")) == Q.BLOCK + Q.WIDTH - 1
    net = Q.train(["good text here", "BAD!! TEXT!!"] * 4, [1, 0] * 4, epochs=2)
    whole = Q.symbols("some words " * 200_000)
    piece, Q._PIECE = Q._PIECE, 4 * Q.BLOCK
    try:
        a, _ = Q._pooled(net, whole[: 400 * Q.BLOCK + Q.WIDTH - 1])
    finally:
        Q._PIECE = piece
    b, _ = Q._pooled(net, whole[: 400 * Q.BLOCK + Q.WIDTH - 1])
    assert np.allclose(a, b)


def test_terms_of_any_script_are_found():
    """Characters beyond U+3000 are told apart like all others, with edits too."""
    s = T.Scanner(("badword", "糞糕的词语", "\U0001d552\U0001d553\U0001d554\U0001d555\U0001d556"), ())
    texts = ["a badword here", "你 糞糕的词语。 好", "糞糕的词一", "糞糕", "x \U0001d552\U0001d553\U0001d554\U0001d555\U0001d556!", "、。 一二三四五"]
    counts = np.expm1(s.features(texts)[:, [0, 2]]).round().astype(int).tolist()
    assert counts == [[1, 0], [1, 0], [0, 1], [0, 0], [1, 0], [0, 0]]


def test_table_of_states_stays_small(monkeypatch):
    rng = random.Random(9)
    words = tuple(sorted({"".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(5, 9))) for _ in range(400)}))
    text = " ".join(rng.choice(words) if rng.random() < 0.3 else "".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(3000))
    want = T.Scanner(words, ("abc",)).features([text])
    monkeypatch.setattr(T, "RUN", 100)
    monkeypatch.setattr(T, "MOST_CELLS", 20_000)
    s, most = T.Scanner(words, ("abc",)), 0
    begin = s.automaton._begin
    begun = []
    monkeypatch.setattr(s.automaton, "_begin", lambda: (begun.append(len(s.automaton.sets)), begin()))
    assert np.array_equal(s.features([text]), want)
    assert len(begun) > 2 and max(begun) * s.automaton.width < 20_000 + 100 * 12 * s.automaton.width


def test_no_term_is_cut_off(spark):
    """Far more words than any fixed number of terms: all that stand in toxic texts alone are learned."""
    names = ["w" + "".join(chr(97 + int(d)) for d in f"{i:05d}") + "q" for i in range(12_000)]
    toxic = [(" ".join(f"c{k}c {n}" for n in names[i : i + 600] for k in (j,)), 1) for i in range(0, 12_000, 600) for j in range(12)]
    clean = [(" ".join(f"x{i}x y{j}y" for j in range(650)), 0) for i in range(650)]
    sample = spark.createDataFrame(toxic + clean, "text string, label int").repartition(4)
    words, _ = T.learn_terms(sample)
    assert set(names) <= set(words)

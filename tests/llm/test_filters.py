from __future__ import annotations

import datetime as dt
import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.chat_format import chat_digest, chat_examples, escape, escape_role, expand, read_back, unescape
from millrace.llm.decontaminate import decontaminate
from millrace.llm.quality_rules import quality_rules
from millrace.llm.url_filter import url_filter


def contaminated(docs, items, window=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    wins = {(i, tuple(w[s : s + window])) for i, t in items if (w := words(t)) for s in range(max(1, len(w) - window + 1))}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in wins:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit.update(range(p, p + len(x)))
                    found.add(i)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((-1 if d is None else d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("broadcast_windows", [0, 200_000])
def test_decontaminate_equals_brute_force(spark, broadcast_windows):
    rng = random.Random(1)
    v = ["the", "of", "Über", "x1", "cat", "dog", "RARE", "é", "zeta", "omega"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(v) for _ in range(n))
    items = [(i, text(rng.randint(4, 30))) for i in range(12)] + [(50, "word"), (51, "two words"), (52, ""), (53, None), (54, "word"), (None, "only here now")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, text(5) + " " + t + " " + text(5)) for i, t in items[:8] if t] + [(200, None), (201, ""), (202, "a word"), (203, "only here now two words"), (203, "only here now two words"), (None, "word"), (205, "word " * 5000)]
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in decontaminate(d, b, broadcast_windows=broadcast_windows).collect())
    assert got == contaminated(docs, items)
    assert decontaminate(d.limit(0), b).count() == 0
    assert decontaminate(d, b.limit(0)).filter("contaminated").count() == 0


def test_quality_rules_base_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one two", "a b c a b c", "a a a a a", "x\ny\nx\n\n \nx", "#*$ %&| <> word", "é\u00a0ü b", "w " * 20000]
    texts += [rng.choice(["\n", " "]).join(rng.choice(["the", "of", "ab", "c|d", "x y z", "x y z w\nq"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        rep = {j + k for j in range(len(w) - 2) if wins[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules(df.limit(0)).count() == 0
    plan = quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("broadcast_changes", [0, 10_000])
def test_url_filter_equals_brute_force(spark, broadcast_changes):
    rng = random.Random(3)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "notexample.com", "EXAMPLE.com", "x.org"]
    entries = [("example.com", "add", day(10)), ("example.com", "remove", day(100)), ("*.example.com/", "add", day(200)), ("a.example.com/p/q", "add", day(50)), ("x.org", "add", day(5)), ("x.org", "add", day(6)), ("x.org", "remove", day(6)), (None, "add", day(1)), ("x.org", "add", None), ("b.a.example.com", "add", day(0)), ("A.Example.com/P/Q", "add", day(70))]
    entries += [("a.example.com", rng.choice(["add", "remove"]), day(i)) for i in range(0, 300, 7)]
    pages = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts)}{rng.choice(['', ':80'])}{rng.choice(['', '/', '/p', '/p/q', '/p/q/r?x=1', '/P/Q#f', '/pq'])}", day(rng.randint(0, 400))) for i in range(300)]
    pages += [(900, None, day(3)), (901, "nonsense", day(3)), (902, "http://x.org/", None), (903, "http://x.org/", day(5)), (903, "http://x.org/", day(5))]
    got = {r.page_id: (r.n_active, r.matched) for r in url_filter(spark.createDataFrame([(*p, "y") for p in pages], "page_id long, url string, fetched date, blocked string"), spark.createDataFrame(entries, "entry string, action string, at date"), broadcast_changes=broadcast_changes).collect()}
    clean = {}
    for e, action, at in entries:
        if e and at:
            host, slash, path = re.sub(r"^(\*\.|\.)", "", e).rstrip("/").partition("/")
            clean.setdefault(host.lower() + slash + path, {}).setdefault(at, []).append(action)
    for i, url, at in pages:
        found = []
        m = re.match(r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)[^/?#]*([^?#]*)", url or "")
        if m and at:
            host, steps = m[1].lower(), [s for s in m[2].split("/") if s]
            for e, changes in clean.items():
                past = [d for d in changes if d <= at]
                active = bool(past) and "remove" not in changes[max(past)]
                eh, *ep = e.split("/")
                if active and ((host == eh and steps[: len(ep)] == ep) if ep else (host == eh or host.endswith("." + eh))):
                    found.append(e)
        assert got[i] == (len(found), max(found, key=lambda e: (len(e), e), default=None)), (url, at)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a<b>\n\\n"]), st.text(alphabet="\\<>/#ntur \n:é ", max_size=20)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_chat_reads_back(turns):
    back, trained, size = read_back(expand(turns))
    assert back == turns
    assert trained == [t for r, t in turns if r == "assistant"]
    assert all(unescape(escape(t)) == t and "</turn>" not in escape(t) and "### " not in re.sub(r"\\###", "", escape(t)) for _, t in turns)
    assert all(unescape(escape_role(r)) == r for r, _ in turns)


def test_chat_digest(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<turn> \\"), (1, 2, "user", None), (2, 1, "assistant", "b"), (2, 0, "assistant", ""), (2, 1, "assistant", "b"), (None, 0, None, "x"), (4, None, "assistant", "null turn"), (4, 0, "user", "w " * 20000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    got = {r.conv_id: r for r in chat_digest(chat_examples(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        all_text = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own)
        loss = "".join(t or "" for _, r, t in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(all_text.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(t) for t, _, _ in expand([(r or "", t or "") for _, r, t in own]))
    assert chat_examples(df.limit(0)).count() == 0


def test_rows_without_conversation_are_their_own(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (None, None, None, None), (3, 0, "assistant", "c")]
    got = chat_digest(chat_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (0, 1, 1), (3, 1, 1)]


def test_url_filter_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", dt.date(2024, 1, 1))], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("a.org", "add", dt.date(2023, 1, 1))], "entry string, action string, at date")
    assert [tuple(r)[3:] for r in url_filter(pages, entries).collect()] == [("a.org", 1, "a.org", True)]
    assert [tuple(r)[3:] for r in url_filter(pages, entries.limit(0)).collect()] == [("a.org", 0, None, False)]
    assert url_filter(pages.limit(0), entries).count() == 0

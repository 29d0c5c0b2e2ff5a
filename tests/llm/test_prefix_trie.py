from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import prefix_trie as P
from millrace.operators import relational as R

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth string, size int"


def plain(rows, every=20, rebuilt=True):
    """The nodes by the definition: all prefixes of all conversations, in dictionaries."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), role[:64].encode(), text[:64].encode(), digest, (role, text)))
    convs = {c: [t[-1] for t in sorted(ts)] for c, ts in convs.items()}
    if rebuilt:
        quotient = lambda c: int(c / every) if c >= 0 else -(-c // every)
        made = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 4
            made[c] = convs.get(every * quotient(c), [])[:h] + own[h:]
        convs = made
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []

    def walk(node):
        own = (len(members[node]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
        below = [walk(k) for k in kids[node]]
        leaves, saved = sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if convs:
        walk(())
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)


def rebuilt(df):
    return P.prefix_trie(df, every=20, heads=F.crc32(F.col("conv").cast("string")) % 4, longest=3)


def made(seed, convs=70, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 400), convs):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", "a  b c", "é　ü\n x"][: texts + 2])))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    return rows


def test_nodes_equal_plain_tries(spark):
    for seed in (1, 2):
        rows = made(seed)
        got = rebuilt(frame(spark, rows).repartition(3))
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_without_rebuilding(spark):
    rows = made(5, convs=40) + [(None, 1, "user", "lost"), (None, None, None, None)]
    got = P.prefix_trie(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, rebuilt=False)


def test_heavy_groups_are_split(spark, monkeypatch):
    """All of a node's members, a long conversation and its copy: with the bounds low, every way is taken."""
    monkeypatch.setattr(R, "HEAVY", 5)
    monkeypatch.setattr(P, "UNROLLED", 4)
    monkeypatch.setattr(P, "ID_BITS", 2)
    rows = [(c, t, "user", "same words here") for c in range(100, 160) for t in range(2)] + [(c, t, "user", f"turn {t}") for c in (7, 300) for t in range(12)] + [(300, 12, "user", "more"), (300, 13, "x", "y z")]
    assert sorted(map(tuple, P.prefix_trie(frame(spark, rows)).collect()), key=str) == plain(rows, rebuilt=False)
    assert sorted(map(tuple, rebuilt(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_turns_are_lost_without_a_base(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert [tuple(r) for r in rebuilt(frame(spark, rows)).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == plain(rows)


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        got = rebuilt(frame(spark, rows))
        assert got.count() == 0 and got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_long_texts_that_differ_late(spark):
    long = "word " * 100_000
    rows = [(1, 0, "user", long + "a"), (2, 0, "user", long + "b"), (3, 0, "user", long + "a")]
    assert sorted(map(tuple, P.prefix_trie(frame(spark, rows)).collect()), key=str) == plain(rows, rebuilt=False)

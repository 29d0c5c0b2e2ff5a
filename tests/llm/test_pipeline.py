from __future__ import annotations

import os
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as P

    docs, out = P.read(spark, DATA, "documents"), {}
    out["documents"] = docs
    for name, stage in P.STAGES:
        docs = out[name] = P.saved(stage(spark, docs, DATA), name)
    return out


def test_stages_keep_columns_and_only_lose_documents(spark, stages):
    import corpus_pipeline as P

    ids = lambda n: {r.doc_id for r in stages[n].select("doc_id").distinct().collect()}
    names = ["documents", *(n for n, _ in P.STAGES)]
    for a, b in zip(names, names[1:]):
        assert ids(b) <= ids(a)
        if b != names[-1]:
            assert stages[b].columns == P.COLUMNS
    assert ids("repeated_spans") == ids("near_duplicates") and ids("packing") == ids("benchmark_passages")
    assert ids("near_duplicates") < ids("toxicity") < ids("documents")


def test_run_equals_the_stages(spark, stages):
    import corpus_pipeline as P

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "doc_tokens").sum("length").collect())
    assert total(P.run(spark, DATA)) == total(stages["packing"])
    assert set(cols) <= set(stages["packing"].columns)


def words(name: str, n: int = 60) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", "made", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates_decide_by_row(spark):
    import corpus_pipeline as P

    a, b, c, d = map(words, "abcd")
    rows = [
        (1, a), (2, a + " end"), (2, b),  # one id with two texts, of which one is a near copy
        (3, c), (3, c), (3, c),  # repeated rows
        (None, d), (None, d + " end"), (None, d + " end"),  # a group without ids
        (None, a), (None, words("e")),  # a copy and a single row without ids
        (4, ""), (4, ""), (None, None), (None, None),  # no words
    ]
    got = kept(P.near_duplicates(spark, made(spark, rows), DATA))
    of_d = [r for r in got if r[1] in (d, d + " end")]
    assert len(of_d) == 1 and of_d[0][0] is None
    assert [r for r in got if r not in of_d] == sorted([(1, a), (2, b), (3, c), (None, words("e")), (4, ""), (4, ""), (None, None), (None, None)], key=str)


def test_benchmark_passages_decide_by_row(spark):
    import corpus_pipeline as P

    item = next(r.text for r in P.read(spark, DATA, "benchmark").collect() if len(r.text.split()) >= 12)
    bad, good, other = f"{words('x')} {item} {words('y')}", words("g"), words("h")
    rows = [(None, bad), (None, good), (1, bad), (1, good), (2, other), (2, other), (None, None)]
    assert kept(P.benchmark_passages(spark, made(spark, rows), DATA)) == sorted([(None, good), (1, good), (2, other), (2, other), (None, None)], key=str)


def test_repeated_spans_takes_short_passages_whole(spark):
    """Passages of 51 words and under 400 bytes go from every document that holds them; documents without any stay as they are."""
    import corpus_pipeline as P

    passages = [" ".join(f"{n}{i:02d}ab" for i in range(51)) for n in ("p", "q")]
    short = " ".join(f"s{i}" for i in range(49))  # fewer words than count
    assert all(300 < len(x.encode()) < 400 for x in passages)
    rows = [(i, f"{words(f'a{i}x', 40)}\n{passages[i % 2]}\n{words(f'z{i}x', 40)}") for i in range(20)]
    clean = [(100 + i, f"{words(f'c{i}x')} {short} {words(f'd{i}x')}") for i in range(20)]
    got = dict(kept(P.repeated_spans(spark, made(spark, rows + clean), DATA)))
    assert got == {i: t.replace(passages[i % 2], "") for i, t in rows} | dict(clean)


def test_run_equals_brute_force(spark, tmp_path):
    """The whole pipeline on a made corpus, each stage against plain Python."""
    import corpus_pipeline as P
    from test_dedup import linked
    from test_filters import contaminated
    from tokenizers import Tokenizer

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    bad, passages, items = ["grukzor", "blathix", "vermok"], [text(55) for _ in range(4)], [text(14) for _ in range(5)]
    texts, toxic = [], set()
    for i in range(420):
        words = text(rng.randint(25, 70)).split(" ")
        if i % 4 == 0:
            toxic.add(i)
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
    for i in (401, 402, 403):
        texts[i] = texts[i - 8] + " " + word()  # near copies
    texts[405] = texts[406]
    for i in (301, 302, 303, 305, 306):
        texts[i] = f"{texts[i]}\n{passages[i % 4]}\n{text(20)}"
    for i in (309, 310):
        texts[i] = f"{texts[i]} {items[i % 5]} {text(9)}"
    rows = list(enumerate(texts))
    made(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in rows if i not in toxic]
    left = [(i, t) for (i, t), (d, _, root) in zip(left, linked(left, 5, 80)) if d == i == root]
    found = [list(re.finditer(r"\S+", t)) for _, t in left]
    seen = Counter(tuple(m[0] for m in w[i : i + 50]) for w in found for i in range(len(w) - 49))
    cut = []
    for (i, t), w in zip(left, found):
        spans = [(w[k].start(), w[k + 49].end()) for k in range(len(w) - 49) if seen[tuple(m[0] for m in w[k : k + 50])] > 1]
        cut.append((i, "".join(c for at, c in enumerate(t) if not any(a <= at < z for a, z in spans))))
    assert sum(a != b for a, b in zip(left, cut)) == 4
    dirty = {r[0] for r in contaminated(cut, list(enumerate(items))) if r[-1]}
    assert dirty == {309, 310}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in cut if i not in dirty}
    got = P.run(spark, str(tmp_path)).groupBy("doc_id", "doc_tokens").agg(P.F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want and all(r.n == r.doc_tokens for r in got)


STRANGE = [
    (None, None), (1, None), (2, ""), (3, " \n\t "), (4, words("k")), (4, words("k")), (4, words("m")), (None, words("n")), (5, "w" * 70_000), (6, words("v", 30_000)),
]


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "repeated_spans", "benchmark_passages", "packing"])
def test_stage_on_strange_rows(spark, name):
    """Null ids and texts, blanks, repeated and very long rows, clashing columns and empty tables."""
    import corpus_pipeline as P

    docs = made(spark, STRANGE).withColumns({c: P.F.lit("clash") for c in ("score", "_row", "kept", "component_id", "key", "token", "label")})
    stage = dict(P.STAGES)[name]
    got = kept(stage(spark, docs, DATA)) if name != "packing" else []
    rows = sorted(STRANGE, key=str)
    if name == "toxicity" or name == "benchmark_passages":
        assert got == rows
    elif name == "near_duplicates":
        assert got == sorted(set(STRANGE), key=str)
    elif name == "repeated_spans":  # the rows that repeat each other are emptied, null texts are empty
        assert got == sorted([(i, "" if (i, t) == (4, words("k")) else t or "") for i, t in STRANGE], key=str)
    else:
        total = {(r[0], r[1]) for r in stage(spark, docs, DATA).groupBy("doc_id", "doc_tokens").count().select("doc_id", "doc_tokens").collect()}
        assert {d for d, _ in total} == {d for d, _ in STRANGE} and (1, 1) in total and (2, 1) in total
    empty = stage(spark, docs.limit(0), DATA)
    assert empty.count() == 0 and (name == "packing" or empty.columns == P.COLUMNS)


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op3_decontaminate", "op4_jaccard_join", "op5_chat_format", "op9_quality_rules", "op10_url_filter"])
def test_query_equals_its_sql(spark, name):
    from millrace.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got = queries()[name](spark, DATA)
    want = con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))

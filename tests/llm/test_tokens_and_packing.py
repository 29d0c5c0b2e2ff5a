from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.packing import Ids, differencing, pack, pack_stream, windows
from millrace.llm.token_counts import Counter, token_counts

ODD = ["", "a" * 3000, " " * 1500, "ab " * 900, "▁x" * 500, "<s> </s><unk>" * 90, "é\n\n  \t" * 300, "日本語テキスト" * 100, "🙂 🙃" * 200, "e\u0301" * 300, "x"]


@pytest.fixture(scope="module")
def model():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_chunks_give_the_counts_of_whole_texts(model):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3000))) for alphabet in ("ab \n.", "aé▁ ", "abcdefg", "the ou ") for _ in range(20)]
    small = Counter(model, chunk=120, overlap=4)
    assert small.exact
    for t in texts:
        assert small.count(t) == len(small.processor.encode(t)), t[:40]


def test_token_counts_of_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "y"), (3, "one two", None), (3, "one two", None), (None, "héllo", "z"), (5, "word " * 20000, "n")]
    df = spark.createDataFrame(rows, "id long, body string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, "id", "body", chunk=500, overlap=10).collect())
    p = Counter(model).processor
    want = sorted((i or 0, len((t or "").encode()), len(p.encode(t or "")), len(p.encode(t or "")) > 4096) for i, t, _ in rows)
    assert got == want
    assert token_counts(df.limit(0), "id", "body").count() == 0


def test_ids_equal_the_json_tokenizer():
    ids, plain = Ids(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ODD + ["<|endoftext|> a<|endoftext|>", "it's    12 ①²\u200b\r\n", "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(3000)), "".join(rng.choice(" \n\t'sdlre12.é\u3000") for _ in range(3000))]
    for t in texts:
        want = plain.encode(t, add_special_tokens=False).ids
        assert ids(t, None).tolist() == want
        assert ids._slow(t).tolist() == want


def test_differencing_balances():
    rng = random.Random(3)
    sizes = [rng.randint(1, 512) for _ in range(300)]
    dealt = differencing(sizes, 20)
    assert sorted(i for w in dealt for i in w) == list(range(300))
    sums = [sum(sizes[i] for i in w) for w in dealt]
    assert max(sums) - min(sums) <= 5
    for w in windows([5] * 7 + [9] * 3, 10):
        assert sum(([5] * 7 + [9] * 3)[i] for i in w) <= 10
    assert differencing([], 3) == []


def test_pack_stream_keeps_every_id():
    rng = np.random.default_rng(4)
    docs = [(i, rng.integers(0, 50000, n).astype("<u4")) for i, n in enumerate([1, 64, 63, 65, 640, 0, *rng.integers(1, 400, 200)])]
    rows = list(pack_stream(iter(docs), 64, group=8, item=16))
    spans, rooms = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, n, seq, at in rows:
        ids = docs[doc][1]
        assert n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes()) and length > 0
        spans[doc].append((start, length))
        rooms[seq].append((at, length))
    for doc, ids in docs:
        at = 0
        for start, length in sorted(spans[doc]):
            assert start == at
            at += length
        assert at == len(ids)
    for pieces in rooms.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(rooms) * 64 <= 1.1 * sum(len(i) for _, i in docs) + 64


def test_pack_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "one two", 3), (3, "one two", 3), (None, "x " * 6000, 4)], "doc_id long, text string, start int")
    rows = pack(df).collect()
    per = defaultdict(int)
    for r in rows:
        per[r.doc_id] += r.length
    assert per == {1: 1, 2: 1, 3: 2 * (len(Ids()("one two"))), None: len(Ids()("x " * 6000))}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert pack(df.limit(0)).count() == 0

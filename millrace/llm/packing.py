"""Operator 8: packing token ids into windows by multiway Karmarkar-Karp differencing."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import narrowed, small_batches

#: Windows of one group that differencing balances; bounds its work and memory.
GROUP_WINDOWS = 128
#: Tokens of the largest item that differencing moves as one; longer rests are cut.
ITEM = 512
#: Part of a group's room that is filled before it is balanced.
FILL = 0.998
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Errors of the fast tokenizer's pattern engine.
_GIVES_UP = ("ValueError", "PanicException")


class Ids:
    """Token ids as the .json file of a byte-level BPE gives them, by the same vocabulary's ranks where possible."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import tiktoken

        lines = open(public_tokenizers.path(f"{name}.tiktoken"), "rb").read().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.name, self.plain = name, None
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

    def __call__(self, text: str, end: int | None = 1) -> np.ndarray:
        try:
            ids = self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the pattern engine gives up on some endless runs of white space
            if type(e).__name__ not in _GIVES_UP:
                raise
            ids = self._slow(text)
        return np.append(ids, end).astype("<u4") if end is not None else ids.astype("<u4")

    def _slow(self, text: str) -> np.ndarray:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items into ``k`` near-equal windows: the two partial partitions of the greatest spread are
    merged again and again, the fullest windows of one with the emptiest of the other."""
    if not sizes:
        return []
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        (_, _, a, xs), (_, _, b, ys) = heapq.heappop(heap), heapq.heappop(heap)
        both = len(a) + len(b) - k  # windows that hold items of either
        if both <= 0:
            merged = [*zip(a, xs), *zip(b, ys)]
        else:
            low = len(a) - both
            merged = [*zip(a[:low], xs[:low]), *zip(b[: len(b) - both], ys[: len(b) - both])]
            merged += [(a[low + j] + b[-1 - j], xs[low + j] + ys[-1 - j]) for j in range(both)]
        merged.sort(key=lambda x: -x[0])
        sums = [s for s, _ in merged]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), tie, sums, [x for _, x in merged]))
        tie += 1
    return heap[0][3]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Differencing into the fewest windows; their number rises while one exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        k += 1


def pack_stream(docs: Iterator[tuple[object, np.ndarray]], capacity: int, group: int = GROUP_WINDOWS, item: int = ITEM) -> Iterator[tuple]:
    """(doc_id, start, length, crc, doc_tokens, sequence, offset) for a stream of (doc_id, ids).

    A document's whole windows stand alone; its rest is cut into items, and a group of items that
    fills ``group`` windows is balanced at once. Holds the ids of one document and one group's sizes.
    """
    item = min(item, capacity)
    room, sequence, waiting, total = int(group * capacity * FILL), 0, [], 0

    def flush() -> Iterator[tuple]:
        nonlocal sequence, waiting, total
        for window in windows([p[2] for p in waiting], capacity):
            at = 0
            for i in window:
                yield (*waiting[i], sequence, at)
                at += waiting[i][2]
            sequence += 1
        waiting, total = [], 0

    for doc, ids in docs:
        n = len(ids)
        at = 0
        while at < n:
            if n - at >= capacity:
                yield doc, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), n, sequence, 0
                sequence += 1
                at += capacity
                continue
            length = min(n - at, item, room - total)
            waiting.append((doc, at, length, zlib.crc32(ids[at : at + length].tobytes()), n))
            total += length
            at += length
            if total == room:
                yield from flush()
    yield from flush()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, group: int = GROUP_WINDOWS, item: int = ITEM, end: int | None = 1) -> DataFrame:
    """Pack every document's ids (and the id ``end``) into windows of at most ``capacity`` tokens.

    Each partition packs its own documents, so nothing is shuffled: only a partition's last group
    may leave a window part empty, and a group's balance leaves under one per cent.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null text is empty: a piece with the end id alone (no piece if ``end`` is None). Repeated rows
    and ids are packed as documents of their own. Other columns are ignored; an empty table gives no
    pieces. The same input partitions give the same pieces, so a lost task can run again.
    """
    small_batches(docs.sparkSession)
    source = narrowed(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = Ids()
        first = TaskContext.get().partitionId() << 33
        stream = ((d, ids(t, end)) for b in batches for d, t in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), b["text"]))
        names, rows = [x.split()[0] for x in SCHEMA.split(", ")], []
        for row in pack_stream(stream, capacity, group, item):
            rows.append((*row[:5], first + row[5], row[6]))
            if len(rows) == 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return source.mapInPandas(run, SCHEMA.replace("doc_id long", f"doc_id {kind}"))

"""Operator 2: removal of long repeated strings, of bytes or of words, by distributed prefix doubling.

Sorting every suffix of a corpus moves each byte many times, so the positions that are ranked are
anchors: in every ``w`` neighbouring k-grams the one of the least hash. Which anchors a string holds
depends on its bytes alone, so two equal strings of ``length`` bytes hold the same chain of them.
The first anchor of a position, and the phrases between the next ones, stand for the position:

1. each document gives its anchors with the hash of the phrase up to the next one;
2. Spark sorts the rank pairs of anchors 1, 2, 4, ... phrases apart, names each pair that occurs
   twice anew in that order, and drops unique ones, until the chain is past what two equal strings
   must share;
3. what is left is checked exactly: the positions of one anchor by the hash of the whole string
   that they span, and, where that is unique, position by position.

A text is a row of symbols: its bytes, or its words, of which each stands as a hash of its bytes.

Equality is by two 64-bit polynomial hashes of different multipliers (step 3), the chance of a false match
at n compared strings is about n^2 / 2^97 or less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DEAL_BYTES, SPACE, blobs_of, dealt, discard, passing, row_keys, saved, saved_apart, small_batches

_M1, _M2, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
#: Windows of one pass over a long document.
_PASS = 1 << 20
#: Strings that one task compares, at 25 bytes each.
PART = 1 << 22


def shape(length: int, longest: int = 16) -> tuple[int, int, int]:
    """(k, w, reach): symbols of a gram (at most ``longest``), grams of a window, symbols after an anchor that equal strings share."""
    k = 1
    while k < longest and 4 * k <= length:
        k *= 2
    w = max(1, (length - k + 2) // 3)
    return k, w, length - 2 * w - k + 2


def plain_shape(length: int) -> tuple[int, int, int]:
    """As ``shape``, with grams of a sixth to a third of a string: few anchors, each ranked by its own gram, and no chain."""
    k = 1 << max(length // 3, 1).bit_length() - 1
    return k, length - k + 1, 0


class Powers:
    """Prefix sums that give the hash of any substring in constant time."""

    def __init__(self, multiplier: int):
        self.m, self.inverse = np.uint64(multiplier | 1), np.uint64(pow(multiplier | 1, -1, 1 << 64))
        self.p = self.q = np.ones(1, np.uint64)

    def sums(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        if len(self.p) <= n:
            size = 1 << (n + 1).bit_length()
            self.p, self.q = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, m, np.uint64)])) for m in (self.m, self.inverse))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(x * self.p[:n], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.q[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX) + (end - start).astype(np.uint64)
        return h ^ (h >> np.uint64(29))


#: Symbols of a gram at most: enough to tell grams apart.
_GRAM = {"bytes": 16, "words": 4}
#: Bytes that part words.
_BLANK = np.isin(np.arange(256), np.frombuffer(SPACE.encode(), np.uint8))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between ASCII white space begin and end."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_BLANK[np.frombuffer(raw, np.uint8)]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


@dataclass
class Symbols:
    """A text's symbols and their prefix sums for both hashes; words are told apart by another hash for each."""

    x: np.ndarray
    s1: np.ndarray
    s2: np.ndarray


def symbols(raw: bytes, units: list[str], one: Powers, two: Powers) -> dict[str, Symbols]:
    """The symbols of a text for each unit."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    out = {"bytes": Symbols(x, one.sums(x), two.sums(x))}
    if "words" in units:
        start, end = word_bounds(raw)
        words = one.of(out["bytes"].s1, start, end)
        out["words"] = Symbols(words, one.sums(words), two.sums(two.of(out["bytes"].s2, start, end)))
    return out


def chosen(x: np.ndarray, k: int, w: int) -> np.ndarray:
    """For each window of ``w`` k-grams, where its leftmost gram of the least hash begins."""
    total, out, mask = len(x) - k - w + 2, [], np.uint64((1 << 22) - 1)
    for at in range(0, total, _PASS):
        end = min(total, at + _PASS)
        h, step, m = x[at : end + w + k - 2], 1, _M1 | 1
        while step < k:
            h = h[:-step] * np.uint64(m) + h[step:]
            m, step = m * m % (1 << 64), 2 * step
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX)
        least = ((h ^ (h >> np.uint64(33))) & ~mask) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        out.append((least & mask).astype(np.int64) + at)
    return np.concatenate(out)


_ANCHORS = "key long, idx int, phrases int, lo int, hi int, rank long, core long, b1 long, b2 long"


def in_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair (a, b): how many equal ones there are, and how many of them stand before it."""
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(a)]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    size, place = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
    size[order], place[order] = np.diff(np.append(first, len(a)))[group], np.arange(len(a)) - first[group]
    return size, place


def _rows(key: int, n: int, **cols: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of ``_ANCHORS``; columns that aren't given are 0."""
    kinds = {c: np.int32 if kind == "int" else np.int64 for c, kind in (x.split() for x in _ANCHORS.split(", "))}
    return {c: np.full(n, key, np.int64) if c == "key" else cols[c].astype(k) if c in cols else np.zeros(n, k) for c, k in kinds.items()}


def _anchors(key: int, text: Symbols, length: int, unit: str, chained: bool, one: Powers, two: Powers) -> Iterator[dict[str, np.ndarray]]:
    """A text's anchors, and ranges (``idx`` -2) of positions whose strings it holds twice itself.

    Of a block that occurs more than twice in the text, as in endless repetitions, only the first two
    are anchors for others to meet; the rest stays only where the chain of a kept anchor runs through.
    """
    x, s1, s2 = text.x, text.s1, text.s2
    n = len(x)
    if n < length:
        return
    k, w, reach = shape(length, _GRAM[unit]) if chained else plain_shape(length)
    sel = chosen(x, k, w)
    lo = np.flatnonzero(np.concatenate([[True], sel[1:] != sel[:-1]]))
    at = sel[lo]
    hi = np.minimum(np.append(lo[1:] - 1, len(sel) - 1), n - length)
    if chained:  # the last anchor has no phrase; those past the last string's reach are not needed
        m = min(len(at) - 1, int(np.searchsorted(at, at[hi >= lo][-1] + reach, "right")))
        at, nxt, lo, hi = at[:m], at[1 : m + 1], lo[:m], hi[:m]
        rank, phrases = one.of(s1, at, nxt), np.searchsorted(np.append(at, nxt[-1]), at + reach, "right") - 1 - np.arange(m)
    else:
        m = int((hi >= lo).sum())
        at, lo, hi = at[:m], lo[:m], hi[:m]
        rank, phrases = one.of(s1, at, at + k), np.zeros(m, np.int64)
    own = np.flatnonzero(hi >= lo)
    core, b1, b2 = (np.zeros(m, np.uint64) for _ in range(3))
    core[own] = one.of(s1, at[own], at[own] + length - w + 1)
    b1[own], b2[own] = one.of(s1, lo[own], hi[own] + length), two.of(s2, lo[own], hi[own] + length)

    if len(np.unique(b1[own])) == len(own):  # as in most texts
        again, asks = own[:0], own
    else:
        size, place = in_order(b1[own], b2[own])
        again, asks = own[size > 1], own[place < 2]
    if len(again):
        cut = np.flatnonzero(lo[again][1:] != hi[again][:-1] + 1) + 1
        a, z = again[np.concatenate([[0], cut])], again[np.append(cut - 1, len(again) - 1)]
        yield _rows(key, len(a), idx=np.full(len(a), -2), lo=lo[a], hi=hi[z])
    kept = slice(None)
    if len(again):
        turns = np.bincount(asks, minlength=m + 1) - np.bincount(np.minimum(asks + phrases[asks] + 1, m), minlength=m + 1)
        kept = np.flatnonzero(np.cumsum(turns)[:m] > 0)
        only_chain = np.ones(m, bool)
        only_chain[asks] = False
        hi = np.where(only_chain, lo - 1, hi)
        m = len(kept)
    cols = {"idx": np.arange(len(at)), "phrases": phrases, "lo": lo, "hi": hi} | {c: v.view(np.int64) for c, v in (("rank", rank), ("core", core), ("b1", b1), ("b2", b2))}
    yield _rows(key, m, **{c: v[kept] for c, v in cols.items()})


def anchors(keyed: DataFrame, asked: list[tuple[int, str, bool]]) -> DataFrame:
    """Anchors for each of some lengths, each with its unit and whether anchors are chained; ``part`` says which."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Powers(_M1), Powers(_M2)
        for b in batches:
            parts = [[] for _ in asked]
            for key, text in zip(b["key"], b["text"]):
                found = symbols(text.encode(), [unit for _, unit, _ in asked], one, two)
                for part, (length, unit, chained) in zip(parts, asked):
                    part += _anchors(key, found[unit], length, unit, chained, one, two)
            for i, part in enumerate(parts):
                if part:
                    yield pd.DataFrame({c: np.concatenate([p[c] for p in part]) for c in part[0]}).assign(part=i)

    return keyed.mapInPandas(run, f"{_ANCHORS}, part int")


def doubled(rows: DataFrame) -> DataFrame:
    """The anchors whose chain of phrases, as far as equal strings must share it, occurs twice.

    ``rows`` is a saved table, and is deleted once its repeated part is saved.
    """
    out, step = None, 1
    pairs = rows.filter("idx >= 0").withColumn("next", F.lit(0).cast("long"))
    while True:
        twice = pairs.groupBy("rank", "next").count().filter("count > 1").select("rank", "next")
        named = saved(twice.sortWithinPartitions("rank", "next").withColumn("name", F.monotonically_increasing_id()), "ranks")
        pairs = saved(pairs.join(named, ["rank", "next"]).select(*(F.col("name").alias("rank") if c == "rank" else F.col(c) for c in rows.columns)), "repeated")
        discard(named, *([rows] if step == 1 else []))
        done = pairs.filter((F.col("phrases") < 2 * step) & (F.col("hi") >= F.col("lo")))
        out = done if out is None else out.unionAll(done)
        if pairs.filter(F.col("phrases") >= 2 * step).isEmpty():
            return out
        ahead = pairs.groupBy("key", (F.col("idx") - step).alias("idx")).agg(F.first("rank").alias("next"))
        pairs = pairs.filter(F.col("phrases") >= 2 * step).join(ahead, ["key", "idx"])
        step *= 2


def runs_of(arrays: Iterator[dict[str, np.ndarray]], size: int) -> Iterator[dict[str, np.ndarray]]:
    """Parallel arrays put together up to about ``size`` bytes at once."""
    held, n = [], 0
    for x in arrays:
        held.append(x)
        n += sum(v.nbytes for v in x.values())
        if n > size:
            yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held, n = [], 0
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def weighed(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(group of each string, weight of each group): equal strings form a group; one that is known to occur twice weighs 2."""
    order = np.lexsort((x["h2"], x["h1"]))
    h1, h2 = x["h1"][order], x["h2"][order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group, weights=1 + x["twice"]) if len(order) else np.zeros(0)


def spread(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) ^ np.uint64(_MIX)) * np.uint64(_M1)


def _positions(keyed: DataFrame, ranges: DataFrame, length: int, unit: str) -> DataFrame:
    """(key, at): for each text, the positions inside ``ranges`` whose string of ``length`` symbols occurs twice among them.

    Ranges of blocks that are known to be repeated count twice and are not returned. A task sends one of
    the equal strings of each few megabytes that it makes, and says that there are several, so that a
    string that very many texts share does not gather in one task. Strings are dealt out to as many parts
    as their number needs, ``ranges`` being a saved table, so that no part has more than about ``PART`` of them.
    """
    number = ranges.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    parts = max(2 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-number // PART))
    asked = ranges.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "twice")).alias("ranges"))
    texts = keyed.join(asked, "key").select("key", "text", "ranges.lo", "ranges.hi", "ranges.twice")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Powers(_M1), Powers(_M2)

        def strings() -> Iterator[dict[str, np.ndarray]]:
            for b in batches:
                for key, text, los, his, twice in zip(*(b[c] for c in ("key", "text", "lo", "hi", "twice"))):
                    own = symbols(text.encode(), [unit], one, two)[unit]
                    s1, s2 = own.s1, own.s2
                    at = np.concatenate([np.arange(a, z + 1) for a, z in zip(los, his)])
                    flags = np.repeat(np.asarray(twice, np.uint8), np.asarray(his) - np.asarray(los) + 1)
                    yield {"h1": one.of(s1, at, at + length), "h2": two.of(s2, at, at + length).astype(np.uint32), "key": np.full(len(at), key, np.int64), "at": at.astype(np.int32), "twice": flags}

        for x in runs_of(strings(), 4 * DEAL_BYTES):
            group, weight = weighed(x)
            known = weight[group] > 1
            hit = known & (x["twice"] == 0)
            own = {c: v[hit] for c, v in x.items()}
            own["h1"] = np.full(len(own["key"]), spread(own["key"][:1])[0] if hit.any() else 0, np.uint64)  # to any one part
            yield from dealt([own], "h1", parts, kind=1)
            _, first = np.unique(group, return_index=True)
            yield from dealt([{c: v[first] for c, v in x.items()} | {"twice": known[first].astype(np.uint8)}], "h1", parts)

    def met(part: pd.DataFrame) -> pd.DataFrame:
        kinds = {"h1": np.uint64, "h2": np.uint32, "key": np.int64, "at": np.int32, "twice": np.uint8}
        known, x = blobs_of(part[part["kind"] == 1], kinds), blobs_of(part[part["kind"] == 0], kinds)
        group, weight = weighed(x)
        hit = (weight[group] > 1) & (x["twice"] == 0)
        key, at = np.concatenate([known["key"], x["key"][hit]]), np.concatenate([known["at"], x["at"][hit]])
        rows = list(dealt([{"key": key, "at": at, "to": spread(key)}], "to", parts))
        return pd.concat(rows)[["part", "key", "at"]] if rows else pd.DataFrame({c: pd.Series([], dtype=k) for c, k in (("part", np.int32), ("key", object), ("at", object))})

    def by_text(part: pd.DataFrame) -> pd.DataFrame:
        x = blobs_of(part, {"key": np.int64, "at": np.int32})
        order = np.lexsort((x["at"], x["key"]))
        key, at = x["key"][order], x["at"][order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return pd.DataFrame({"key": key[cut], "at": pd.Series(np.split(at, cut[1:]), dtype=object)})

    blobs = texts.mapInPandas(hashed, "kind tinyint, part int, h1 binary, h2 binary, key binary, at binary, twice binary")
    hits = blobs.groupBy("part").applyInPandas(met, "part int, key binary, at binary")
    return hits.groupBy("part").applyInPandas(by_text, "key long, at array<int>")


def _cover(long_enough: DataFrame, rows: DataFrame, length: int, unit: str) -> DataFrame:
    """(key, lo, hi, at): where repeated strings start in each text, as ranges and as positions. ``rows`` are the anchors, a saved table."""
    known = saved(rows.filter("idx = -2").select("key", "lo", "hi"), "known")
    found = doubled(rows)
    blocks = ["core", "b1", "b2"]
    counted = saved(found.groupBy(*blocks).agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi")).alias("rep")), "blocks")
    shared = counted.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core")
    whole = found.join(counted.filter("n > 1").select(*blocks), blocks).select("key", "lo", "hi").unionAll(known)
    ranges = saved(counted.join(shared, "core").select("rep.key", "rep.lo", "rep.hi", (F.col("n") > 1).cast("byte").alias("twice")), "ranges")
    single = saved(_positions(long_enough, ranges, length, unit), "positions")

    a = whole.groupBy("key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return saved(a.join(single, "key", "full"), "cover")


def _covered(lo, hi, at, length: int) -> int:
    """Symbols inside strings of ``length`` that start in the ranges and at the positions given."""
    pairs = [(a, z) for a, z in ((lo, hi), (at, at)) if a is not None and len(a)]
    if not pairs:
        return 0
    start, end = (np.concatenate([np.asarray(p[i], np.int64) for p in pairs]) for i in (0, 1))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order] + length)
    return int((end - np.maximum(start, np.concatenate([[0], end[:-1]]))).clip(0).sum())


_OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(text: str, lo, hi, at, length: int, unit: str, keep_text: bool) -> tuple:
    raw = text.encode()
    n = len(raw)
    edge = np.zeros(n + 1, np.int64)
    first, last = word_bounds(raw) if unit == "words" else (None, None)
    for starts, ends in ((lo, hi), (at, at)):
        if starts is not None and len(starts):
            a, z = np.asarray(starts, np.int64), np.asarray(ends, np.int64) + length
            a, z = (a, z) if unit == "bytes" else (first[a], last[z - 1])
            np.add.at(edge, a, 1)
            np.add.at(edge, z, -1)
    gone = np.cumsum(edge)[:n] > 0
    removed = int(gone.sum())
    spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if n else 0))
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if removed else raw
    return n, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if keep_text else None


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_text: bool = True, carry: list[str] | None = None, unit: str = "bytes", passages: int | None = None) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    With ``unit="words"`` the strings are ``length`` words between ASCII white space; how much of it
    stands between two words does not matter, and that between removed words goes with them.

    With ``passages``, a number of words, n_passage_words counts a text's words that stand inside a run
    of so many words that also starts anywhere else, whatever ``length`` is. They are found in the
    same way, but anchors are fewer and ranked by grams, without doubling.

    Returns a row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``passages``, n_passage_words, with ``keep_text``, kept: the remaining text without characters that were cut in part; and the columns
    named in ``carry``, as they are. A null text is
    empty; texts shorter than ``length`` stay whole. A text that goes in full is left as an empty one, and its row stays. Repeated rows are documents of their own, so
    long ones repeat each other and go; rows of one id and other texts are told apart. A task's
    memory grows with its longest text, by about 80 bytes for each of its bytes. Empty tables give empty results; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carried = F.struct(*(F.col(c) for c in carry or [])) if carry else F.lit(None).cast("string")
    renamed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("carried"))
    keyed = renamed.select("doc_id", row_keys(renamed, "doc_id", "text").alias("key"), "text", "carried")
    if unit not in ("bytes", "words"):
        raise ValueError(f"unit is bytes or words, not {unit}")
    enough = lambda n, unit: keyed.filter(F.octet_length("text") >= (n if unit == "bytes" else 2 * n - 1)).select("key", "text")
    asked = [(length, unit, True), *([(passages, "words", False)] if passages else [])]
    least = min(n if u == "bytes" else 2 * n - 1 for n, u, _ in asked)
    texts = keyed.filter(F.octet_length("text") >= least).select("key", "text")
    with passing() as keep:
        tables = saved_apart(anchors(texts, asked), "anchors", "part", list(range(len(asked))))
        covers = [_cover(enough(n, u), rows, n, u) for (n, u, _), rows in list(zip(asked, tables))[::-1]][::-1]
        cover = covers[0]
        if passages:
            cover = saved(cover.join(covers[1].select("key", *(F.col(c).alias(f"w_{c}") for c in ("lo", "hi", "at"))), "key", "full"), "covers")
        keep(cover)
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [_cut(*r, length, unit, keep_text) for r in zip(x["text"], x["lo"], x["hi"], x["at"])]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
            if passages:
                out.insert(4, "n_passage_words", [_covered(*r, passages) for r in zip(x["w_lo"], x["w_hi"], x["w_at"])])
            out.insert(0, "doc_id", x["doc_id"].astype(object).where(x["doc_id"].notna(), None).to_numpy())
            yield out.assign(carried=x["carried"].to_numpy())

    more = ["w_lo", "w_hi", "w_at"] if passages else []
    joined = keyed.join(cover, "key", "left").select("doc_id", "text", "lo", "hi", "at", *more, "carried")
    schema = _OUT.replace(", kept string", ", n_passage_words long, kept string") if passages else _OUT
    out = joined.mapInPandas(run, f"doc_id {kind}, {schema}, carried {keyed.schema['carried'].dataType.simpleString()}")
    names = [c.split()[0] for c in schema.split(", ")[: None if keep_text else -1]]
    return out.select("doc_id", *names, *(F.col(f"carried.{c}") for c in carry or []))

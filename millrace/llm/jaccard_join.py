"""Operator 4: exact Jaccard self-join of shingle sets by partitioning the universe.

Sets in one size band differ in at most H shingles if they are similar enough. Shingles are hashed
into segments; with budgets v over the segments that sum to H + 1 + slack, two such sets differ in
less than v shingles in some segment (pigeonhole). A segment of budget 1 is indexed by its subset
alone, one of budget 2 also by every subset without one shingle. Documents that share an entry are
candidates, and those are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DEAL_BYTES, blobs_of, dealt, discard, narrowed, passing, row_keys, saved, small_batches
from .components import components

_A, _B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
#: Documents of one index entry up to which all pairs are taken; larger groups go by a representative.
PAIRS = 8
#: Ids of candidates up to which they are broadcast to the texts (under 32 MB); beyond, texts are shuffled.
BROADCAST_IDS = 1_000_000
#: An entry's row holds a set's size and, as a multiple of this, how many entries its links share.
NEED = 1 << 26
#: Bytes of texts whose index entries one task compares.
PART_BYTES = 256 << 20
#: How a group's size grows from band to band.
BAND = 1.5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``k`` words, as sorted 64-bit hashes; of fewer words, the whole.

    Short texts are hashed together, about 256 thousand characters at once.
    """
    out, run, size = [], [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size > 1 << 18:
            out += _shingle_sets(run, k)
            run, size = [], 0
    return out + _shingle_sets(run, k) if run else out


def _shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    raws = [t.encode() for t in texts]
    x = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    inside = ~_SPACE[x]
    at = np.flatnonzero(inside)
    if not len(at):
        return [np.zeros(0, np.uint64) for _ in texts]
    first = np.flatnonzero(inside[at] & ~np.concatenate([[False], inside])[at])
    size = np.diff(np.append(first, len(at)))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()) - 1, _A, np.uint64)]))
    place = np.arange(len(at)) - np.repeat(first, size)
    words = _mix(np.add.reduceat((_LOWER[x[at]] + np.uint64(1)) * powers[place], first) + size.astype(np.uint64))
    ends = np.searchsorted(at[first], np.cumsum([len(r) + 1 for r in raws]))
    rolled = words[: max(0, len(words) - k + 1)].copy()
    for j in range(1, k):
        rolled = rolled * _A + words[j : j + len(rolled)]
    rolled, out, begin = _mix(rolled), [], 0
    for end in ends:
        n = end - begin
        if n >= k:
            out.append(np.unique(rolled[begin : end - k + 1]))
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[begin:end]:
                    h = h * _A + w
            out.append(_mix(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out


def most_apart(total: int, per_cent: int) -> int:
    """The largest symmetric difference of two linked sets whose sizes sum to ``total``."""
    return total - 2 * -(-per_cent * total // (100 + per_cent))


@dataclass(frozen=True)
class Scheme:
    """How sets of one band are indexed: ``m`` segments, of which ``double`` have a budget of 2."""

    band: int
    low: int
    high: int
    reach: int  # the largest set of the next band that can link with one of this band
    m: int
    double: int
    slack: int


def _poisson(mean: float, most: int) -> float:
    """Chance of at most ``most`` events."""
    term = total = math.exp(-mean)
    for i in range(1, most + 1):
        term *= mean / i
        total += term
    return min(1.0, total)


def allocate(band: int, low: int, high: int, per_cent: int, n_docs: int, share: float = 1e-4) -> Scheme:
    """Budgets of a band that cost least: index entries of a set, and false candidates expected by them.

    ``share`` is the chance that two unrelated sets share a given shingle. Empty and one-shingle
    segments collide most, so few large segments of budget 2, or slack for empty ones, can pay. An
    eighth more segments than that are slack as well: then links share several entries, which
    tells them from chance in large groups.
    """
    reach = high * 100 // per_cent
    h = max(most_apart(t, per_cent) for t in range(max(2, high + reach - 3), high + reach + 1))
    n, best = math.sqrt(low * high), None
    slacks = sorted({*range(9), *(round(8 * 1.25**i) for i in range(1, 80))} & set(range(9 + h // 12)))
    for double in [d for d in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24) if d <= h + 1]:
        for slack in slacks:
            m = h + 1 + slack - double
            if m < max(1, double):
                continue
            full = n / m
            empty = m * math.exp(-low / m)
            tail = 1 - _poisson(empty, slack)
            single = full * math.exp(-full)
            false = n_docs * (m * single * single * share + (m + double * full) * share ** max(1.0, full) + max(0.0, tail) ** 2)
            cost = m + double * full + false
            if best is None or cost < best[0]:
                best = cost, Scheme(band, low, high, reach, m, double, slack)
    chosen = best[1]
    more = max(1, chosen.m // 8)
    return replace(chosen, m=chosen.m + more, slack=chosen.slack + more)


class Schemes:
    def __init__(self, per_cent: int, n_docs: int):
        self.make = lru_cache(None)(lambda b: allocate(b, self.edge(b), self.edge(b + 1) - 1, per_cent, n_docs))

    @staticmethod
    @lru_cache(None)
    def edge(b: int) -> int:
        return b + 1 if b < 6 else math.ceil(Schemes.edge(b - 1) * BAND)

    def of(self, n: int) -> list[Scheme]:
        b = 0
        while self.edge(b + 1) <= n:
            b += 1
        found = [self.make(b)]
        while b and n <= (before := self.make(b - 1)).reach:
            found.insert(0, before)
            b -= 1
        return found


def entries(shingles: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, int]:
    """The index entries of one set, and how many of them any set that links with it must share."""
    out, value, need = [], _mix(shingles + _A), 31
    for s in schemes.of(len(shingles)):
        segment = ((shingles >> np.uint64(16)) % np.uint64(s.m)).astype(np.int64)
        sums = np.zeros(s.m, np.uint64)
        np.add.at(sums, segment, value)
        size = np.bincount(segment, minlength=s.m)
        salt = _mix(np.arange(s.m, dtype=np.uint64) + np.uint64((s.band + 1) * int(_A) % (1 << 64)))
        budget = np.where(np.arange(s.m) < s.double, 2, 1)
        keep = np.ones(s.m, bool)
        without = segment < s.double
        # What an empty segment could match by is left out while the slack makes up for it.
        left_out = int(budget[size == 0].sum() + (size[: s.double] == 1).sum())
        need = min(need, max(1, 1 + s.slack - left_out))
        if left_out <= s.slack:
            keep = size > 0
            without &= size[segment] > 1
        out.append(_mix(sums[keep] ^ salt[keep]))
        if without.any():
            seg = segment[without]
            out.append(_mix((sums[seg] - value[without]) ^ salt[seg]))
    return np.unique(np.concatenate(out)), need


def fingerprint(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two independent sums over a set, 128 bits: equal sets have equal ones, and no other sets can be expected to."""
    n = np.uint64(len(shingles))
    return tuple(_mix(np.array([_mix(shingles + salt).sum() + n]))[0] for salt in (_C, _D))


def equal_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): where each distinct row of two numbers first stands, and each row's place among these."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ranked = pairs[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)]) if len(pairs) else np.zeros(0, bool)
    of = np.empty(len(pairs), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


_MET = "kind string, a long, b long, n long, entry long"


def _candidates(keyed: DataFrame, k: int, per_cent: int, n_docs: int, parts: int) -> DataFrame:
    """Rows of four kinds: set (document a has n shingles), same (a equals b), pair, and member (a, of n
    shingles, is in the large group ``entry``; what links with it shares b entries).

    A task sends one of its equal sets, and of a large group with one entry one representative, so
    no part of the shuffle holds more of a hot group than a few rows from each task.
    """

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in gathered(batches):
            yield x.reindex(columns=["kind", "part", "x", "a", "b", "n"]).astype(object).where(lambda v: v.notna(), None)

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        schemes, size = Schemes(per_cent, n_docs), 0
        keys, ns, needs, prints, sigs = [], [], [], [], []

        def flush() -> Iterator[pd.DataFrame]:
            key, n, fp = np.array(keys, np.int64), np.array(ns, np.int64), np.array(prints, np.uint64)
            at, of = equal_pairs(fp)
            rep = key[at][of]
            yield from dealt([{"x": _mix(key.view(np.uint64)), "a": key, "b": rep, "n": n}], "x", parts, kind=1)
            yield from dealt([{"x": fp[at, 0], "b": fp[at, 1].view(np.int64), "a": key[at]}], "x", parts, kind=2)
            sig = np.concatenate([sigs[i] for i in at])
            who = np.repeat(at, [len(sigs[i]) for i in at])
            order = np.argsort(sig, kind="stable")
            sig, who = sig[order], who[order]
            cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.diff(np.append(cut, len(sig)))
            lead = np.repeat(cut, count)
            large = np.repeat(count > PAIRS, count)
            send = ~large | (np.arange(len(sig)) == lead)
            sizes = (n + np.array(needs, np.int64) * NEED)[who].astype(np.int32)
            yield from dealt([{"x": sig[send], "a": key[who[send]], "n": np.where(large, -sizes, sizes)[send]}], "x", parts, kind=0)
            if large.any():  # the group's other members go straight on; its size, below zero, says that there are some
                yield from dealt([{"x": _mix(key[who[large]].view(np.uint64)), "b": sig[large], "a": key[who[large]], "n": sizes[large]}], "x", parts, kind=3)

        for b in batches:
            for key, s in zip(b["key"], shingle_sets(list(b["text"]), k)):
                keys.append(key)
                ns.append(len(s))
                prints.append(fingerprint(s) if len(s) else (np.uint64(key % (1 << 64)), np.uint64(0)))
                own, need = entries(s, schemes) if len(s) else (np.zeros(0, np.uint64), 1)
                sigs.append(own)
                needs.append(need)
                size += sigs[-1].nbytes
            if size > DEAL_BYTES:
                yield from flush()
                keys, ns, needs, prints, sigs, size = [], [], [], [], [], 0
        if keys:
            yield from flush()

    def rows(kind: str, a, b=None, n=None, entry=None) -> pd.DataFrame:
        zero = np.zeros(len(a), np.int64)
        return pd.DataFrame({"kind": kind, "a": a, "b": zero if b is None else b, "n": zero if n is None else n, "entry": zero if entry is None else entry})

    def met(part: pd.DataFrame) -> pd.DataFrame:
        out, by = [], dict(list(part.groupby("kind")))
        if 1 in by:
            x = blobs_of(by[1], {"a": np.int64, "b": np.int64, "n": np.int64})
            out.append(rows("set", x["a"], n=x["n"]))
            other = x["a"] != x["b"]
            out.append(rows("same", x["a"][other], x["b"][other]))
        if 2 in by:
            x = blobs_of(by[2], {"x": np.uint64, "b": np.uint64, "a": np.int64})
            at, of = equal_pairs(np.column_stack([x["x"], x["b"]]))
            rep = x["a"][at][of]
            other = rep != x["a"]
            out.append(rows("same", x["a"][other], rep[other]))
        if 3 in by:
            x = blobs_of(by[3], {"b": np.int64, "a": np.int64, "n": np.int32})
            out.append(rows("member", x["a"], x["n"] // NEED, x["n"] % NEED, x["b"]))
        if 0 in by:
            x = blobs_of(by[0], {"x": np.uint64, "a": np.int64, "n": np.int32})
            order = np.argsort(x["x"], kind="stable")
            sig, key, n = x["x"][order], x["a"][order], x["n"][order].astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.diff(np.append(cut, len(sig)))
            large = (count > PAIRS) | (np.minimum.reduceat(n, cut) < 0)
            need, n = np.divmod(np.abs(n), NEED)
            for g in range(2, PAIRS + 1):  # all groups of one size at once
                begin = cut[(count == g) & ~large]
                for i in range(g):
                    for j in range(i + 1, g):
                        a, b = begin + i, begin + j
                        ok = (100 * np.minimum(n[a], n[b]) >= per_cent * np.maximum(n[a], n[b])) & (key[a] != key[b])
                        lo, hi = np.minimum(key[a], key[b])[ok], np.maximum(key[a], key[b])[ok]
                        if len(lo):
                            out.append(rows("pair", *np.unique(np.stack([lo, hi]), axis=1)))
            many = np.repeat(large, count)
            if many.any():
                out.append(rows("member", key[many], need[many], n[many], sig[many].view(np.int64)))
        return pd.concat(out) if out else rows("set", np.zeros(0, np.int64))

    blobs = keyed.mapInPandas(indexed, "kind tinyint, part int, x binary, a binary, b binary, n binary")
    return blobs.groupBy("part").applyInPandas(met, _MET)


def _verified(pairs: DataFrame, keyed: DataFrame, k: int, per_cent: int, differences: bool = False) -> DataFrame:
    """Each pair (a, b) with whether it links, its Jaccard distance ``apart`` and sizes, from both whole sets.

    With ``differences``, also what a has and b lacks (``added``), and the reverse (``missing``).
    Without, pairs first meet with half of each hash, which can only make sets look more alike, and
    only what still looks linked is verified and returned.
    """

    def joined(pairs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                sets = shingle_sets(list(x["text"]), k)
                yield pd.DataFrame({"key": x["key"], "s": [(s >> np.uint64(64 - bits)).astype(f"u{bits // 8}").tobytes() for s in sets]})

        nodes = saved(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "nodes")
        few = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
        table = saved(keyed.join(few, "key").mapInPandas(made, "key long, s binary"), "sets")
        sets = table.groupBy("key").agg(F.first("s").alias("s"))
        both = pairs.join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
        return both.select("a", "b", "sa", "sb"), table

    def screened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            on = []
            for sa, sb in zip(x["sa"], x["sb"]):
                a, b = np.frombuffer(sa, np.uint32), np.frombuffer(sb, np.uint32)
                common = max(int(np.isin(a, b).sum()), int(np.isin(b, a).sum()))
                on.append(100 * common >= per_cent * (len(a) + len(b) - common))
            yield x.loc[on, ["a", "b"]]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for sa, sb in zip(x["sa"], x["sb"]):
                a, b = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                shared = np.intersect1d(a, b, assume_unique=True)
                common, union = len(shared), len(a) + len(b) - len(shared)
                only = [(np.setdiff1d(v, shared, assume_unique=True) >> np.uint64(32)).astype(np.uint32).view(np.int32) if differences else [] for v in (a, b)]
                rows.append((100 * common >= per_cent * union, 1 - common / union, len(a), len(b), *only))
            yield pd.DataFrame(rows, columns=["linked", "apart", "na", "nb", "added", "missing"]).assign(a=x["a"], b=x["b"])

    if not differences:
        both, table = joined(pairs, 32)
        pairs = saved(both.mapInPandas(screened, "a long, b long"), "screened")
        discard(table)
    both, made_sets = joined(pairs, 64)
    out = "a long, b long, linked boolean, apart double, na int, nb int, added array<int>, missing array<int>"
    verified = saved(both.mapInPandas(compared, out), "verified")
    discard(made_sets)
    return verified


def _beyond(stars: DataFrame, roots: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) in large groups that may still link two components; ``stars`` are verified (member, representative) pairs.

    Let c be a group's representative, x a member outside its component, and D(x) = x △ c. As x does
    not link with c, it can link with y only if D(x) and D(y) share at least
    t = (|D(x)| + |D(y)| - H(x, y)) / 2 > 0 shingles: either some of those that c lacks, at least t less
    the missing ones that they can share, or else t of the missing ones. Both are prefix-filtered: with
    the group's rarest shingles first, k common ones of m include one of the first m - k + 1.
    Shingles are told apart by 32 bits here, which can only add candidates.
    """
    limit, alpha = 1 - per_cent / 100 + 1e-9, (100 - per_cent) / (100 + per_cent)
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    of = stars.select(F.col("a").alias("x"), F.col("b").alias("c"), F.col("na").alias("n"), "apart", F.size("added").alias("added"), F.size("missing").alias("missing"))
    of = of.join(named("x"), "x", "left").join(named("c"), "c", "left").select("x", "c", "n", "apart", "added", "missing", F.coalesce("x_root", "x").alias("root"), F.coalesce("c_root", "c").alias("c_root"))
    of = saved(of, "sides")
    open_groups = of.filter("root != c_root").select(F.col("c").alias("b")).distinct()
    if open_groups.isEmpty():
        return of.select(F.col("x").alias("a"), F.col("c").alias("b")).limit(0)
    stars = stars.join(open_groups, "b")
    pair = [F.least("x", "y_x").alias("a"), F.greatest("x", "y_x").alias("b")]
    apart = (F.col("root") != F.col("y_root")) & (F.abs(F.col("apart") - F.col("y_apart")) <= limit)
    room = F.floor((F.col("n") + F.col("y_n")) * alpha + 1e-9)
    most = F.floor(F.col("na") * (1 + 100 / per_cent) * alpha + 1e-9)  # room with any y
    t = F.ceil((F.col("added") + F.col("missing") + F.col("y_added") + F.col("y_missing") - room) / 2)
    kinds = {"added": (most + 1, t - F.least("missing", "y_missing")), "missing": (most - F.size("added") + 1, t)}
    out = None
    for kind, (first_ones, common) in kinds.items():
        cast = stars.select(F.col("a").alias("x"), F.col("b").alias("c"), first_ones.alias("ones"), F.explode(kind).alias("el")).filter("ones > 0")
        rarity = saved(cast.groupBy("c", "el").count(), "rarity")  # a table, so that the join can split hot shingles
        order = F.row_number().over(Window.partitionBy("c", "x").orderBy("count", "el"))
        ranked = cast.join(rarity, ["c", "el"]).withColumn("rank", order).filter("rank <= ones").select("x", "c", "el", "rank")
        ranked = saved(ranked.join(of, ["x", "c"]), "prefixes")
        other = ranked.select("c", "el", *(F.col(v).alias(f"y_{v}") for v in ranked.columns if v not in ("c", "el", "c_root")))
        k = F.greatest(common, F.lit(1))
        inside = (F.col("rank") <= F.col(kind) - k + 1) & (F.col("y_rank") <= F.col(f"y_{kind}") - k + 1)
        met = ranked.filter("root != c_root").join(other, ["c", "el"]).filter(apart & inside).select(*pair).distinct()
        out = met if out is None else out.unionAll(met)
    return out.distinct()


def _linked(texts: DataFrame, words: int, per_cent: int, n_docs: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of linked texts and (key, n) of all."""
    found = saved(_candidates(texts, words, per_cent, n_docs, parts), "candidates")

    # A link that no small group shows shares only entries of large ones, ``need`` at least. So a
    # document with fewer has none, and of k entries the k - need + 1 in the smallest groups are enough
    # (with one order for all, the rarest shared entry is among these for both).
    member = saved(found.filter("kind = 'member'").select("a", "n", F.col("b").alias("need"), "entry").distinct(), "members")
    sizes_of = member.groupBy("entry").agg(F.count("*").alias("size"))
    rarest, own = Window.partitionBy("a").orderBy("size", "entry"), Window.partitionBy("a")
    ranked = member.join(sizes_of, "entry").withColumn("at", F.row_number().over(rarest)).withColumn("k", F.count("*").over(own))
    ranked = saved(ranked.filter("at <= k - need + 1").select("a", "n", "entry"), "rarest")
    discard(member)
    member = ranked.join(ranked.groupBy("entry").count().filter("count > 1").select("entry"), "entry")
    # A group's representative: of its member in most groups, the neighbour in most groups. That is near
    # to what they all copy, and the same for most groups of one family.
    central = member.groupBy("a").count()
    best = saved(member.join(central, "a").groupBy("entry").agg(F.max(F.struct("count", "a")).alias("best")), "best")
    above = member.join(best, "entry").groupBy("a").agg(F.max("best").alias("above")).select(F.col("a").alias("of"), F.col("above.a").alias("b"))
    best = best.join(above, F.col("best.a") == F.col("of")).select("entry", "b")
    member = saved(member.join(best, "entry"), "stars")
    sizes = saved(found.filter("kind = 'set'").select(F.col("a").alias("key"), "n").distinct(), "sizes")
    star = _verified(member.filter("a != b").select("a", "b").distinct(), texts, words, per_cent, differences=True)
    in_order = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    met = star.select(*in_order)
    pairs = saved(found.filter("kind = 'pair'").select("a", "b").distinct().join(met, ["a", "b"], "left_anti"), "pairs")
    others = _verified(pairs, texts, words, per_cent)
    same = found.filter("kind = 'same'").select("a", "b").distinct()
    links = star.filter("linked").select("a", "b").unionAll(others.filter("linked").select("a", "b")).unionAll(same)
    roots = saved(components(links), "roots")

    again = saved(_beyond(star, roots, per_cent).join(met.unionAll(pairs), ["a", "b"], "left_anti"), "again")
    if not again.isEmpty():
        links = links.unionAll(_verified(again, texts, words, per_cent).filter("linked").select("a", "b"))
        roots = saved(components(links), "roots")
    return roots, sizes


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, per_cent: int = 85) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``per_cent`` or more, exactly.

    Groups of up to ``PAIRS`` documents with a common entry give all pairs. In larger ones every
    member is compared with a central representative; a member that comes into its component neither
    so nor through others then meets the members that its difference from the representative allows
    (see ``_beyond``). No link is lost that would join two components.

    A task's memory grows with its longest text, by about 40 bytes for each of its bytes.

    Returns a row for each input row: doc_id, n_shingles, component_id (the smallest id reachable by
    links). Null and empty texts have no shingles and no links. Repeated rows link with each other.
    Rows without an id take part; their component_id is the smallest id they reach, or null. Other
    columns are ignored; empty tables give empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = narrowed(docs, id_col, text_col)
    keyed = named.select("doc_id", row_keys(named, "doc_id", "text").alias("key"), "text")
    texts = keyed.select("key", "text")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.bytes or 0) // PART_BYTES))
    with passing() as keep:
        roots, sizes = _linked(texts, words, per_cent, size.n, parts)
        keep(roots, sizes)

    ids = keyed.select("doc_id", "key")
    least = roots.join(ids, F.col("node") == F.col("key")).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # The table is small beside the texts: a row for each linked document.
    named = roots.join(least, "root").select("node", "component_id")
    out = ids.join(sizes, "key").join(named, F.col("key") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

"""Substitution ciphers: texts matched to their plain texts by patterns that no substitution changes, and the key by votes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, passing, saved
from .relational import join_groups

#: Characters of a window, steps from one to the next, and different characters that it must have for its pattern to say anything.
WINDOW, STEP, KINDS = 20, 10, 8
#: Windows of a text, evenly over all of it; with one character in twenty wrong a third of them are still whole.
PLACES = 64
#: Windows whose characters are compared at once, and characters of texts that are taken together.
_AT_ONCE, _CHARS = 1 << 14, 1 << 21


class Solved(NamedTuple):
    """``key``: cipher, plain, votes for each character; ``matches``: id, plain_id, accuracy for each text that was matched."""

    key: DataFrame
    matches: DataFrame


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def patterns(windows: np.ndarray) -> np.ndarray:
    """For each row of characters, where each of them stands first in it: equal for a text and its encryption."""
    out = [np.zeros((0, windows.shape[1]), np.uint32)]
    for at in range(0, len(windows), _AT_ONCE):
        w = windows[at : at + _AT_ONCE]
        out.append((w[:, :, None] == w[:, None, :]).argmax(2).astype(np.uint32))
    return np.concatenate(out)


def _together(texts: pd.Series) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Neighbouring texts of about ``_CHARS`` characters: which ones, their lengths, and all of their characters in one array."""
    sizes = texts.str.len().to_numpy(np.int64)
    group = (np.cumsum(sizes) - sizes) // _CHARS
    for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
        if len(part):
            yield (at := slice(part[0], part[-1] + 1)), sizes[at], points("".join(texts.iloc[at]))


def _reading(key: dict[str, str]) -> np.ndarray:
    """What every code point stands for; those without a place in the key stay as they are."""
    out = np.arange(0x110000, dtype=np.uint32)
    for a, b in key.items():
        out[ord(a)] = ord(b)
    return out


def _windows(texts: DataFrame, padded: int, patterned: bool, key: dict[str, str] | None = None) -> DataFrame:
    """(id, what): windows of (id, text) at fixed places of the text as it is padded on both sides to a multiple of ``padded``.

    ``what`` is a hash of 64 bits of the padded length, the place, and the window's pattern or its characters as ``key`` reads them. Windows only
    find pairs; what a pair says of the key is taken from all of both texts. Longer texts have them farther apart, the same for all texts of one size.
    """
    weights = np.random.default_rng(11).integers(1, 1 << 62, WINDOW + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reads = _reading(key) if key else None
        for b in batches:
            for part, lengths, x in _together(b["text"]):
                x = x if reads is None else reads[x]
                sizes = -(-lengths // padded) * padded
                left, begins = (sizes - lengths) // 2, np.cumsum(lengths) - lengths
                steps = STEP * np.maximum(1, -(-sizes // (STEP * PLACES)))
                places = [np.arange(-(-a // step) * step, a + n - WINDOW + 1, step) for a, n, step in zip(left.tolist(), lengths.tolist(), steps.tolist())]
                row, at, ids = np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate(places), b["id"].iloc[part].to_numpy()
                start = at - left[row] + begins[row]
                for i in range(0, len(start), _AT_ONCE):
                    w = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[start[i : i + _AT_ONCE]]
                    found = patterns(w)
                    told = (found == np.arange(WINDOW)).sum(1) >= KINDS
                    of, told_at = row[i : i + _AT_ONCE][told], at[i : i + _AT_ONCE][told]
                    signs = np.column_stack([(found if patterned else w)[told], sizes[of], told_at]).astype(np.uint64)
                    h = ((signs + np.uint64(1)) * weights).sum(1)
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    yield pd.DataFrame({"id": ids[of], "what": h.view(np.int64)})

    return texts.select("id", "text").mapInPandas(run, f"id {kind}, what long")


def _matched(ciphers: DataFrame, plain: DataFrame, padded: int, key: dict[str, str] | None) -> DataFrame:
    """(id, plain_id): for each cipher the plain text that it shares most windows with, ties going to the least; saved.

    Windows are patterns while there is no key. Of plain texts with one window at one place the least stands for all, so that copies give no pairs.
    """
    known = _windows(plain, padded, key is None).groupBy("what").agg(F.min("id").alias("plain_id"))
    asked = saved(_windows(ciphers, 1, key is None, key), "windows")
    groups = saved(asked.groupBy("what").agg(F.count("*").alias("n")).join(known, "what"), "groups")
    size = groups.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    shared = join_groups(asked, groups, ["what"], "n", size["all"] or 0, size["most"] or 0).groupBy("id", "plain_id").agg(F.count("*").alias("shared"))
    out = saved(shared.groupBy("id").agg(F.min_by("plain_id", F.struct(-F.col("shared"), F.col("plain_id"))).alias("plain_id")), "matched")
    discard(asked, groups)
    return out


def _aligned(matched: DataFrame, ciphers: DataFrame, plain: DataFrame) -> DataFrame:
    """(id, plain_id, pairs, counts, sure) of each matched pair; saved.

    ``pairs`` are the two characters (code points in 32 bits each) that stand at one place, and ``counts`` how often they do; ``sure`` is the
    share of places at which a character stands for what it most often stands for.
    """
    met = matched.join(ciphers.select("id", F.col("text").alias("a")), "id").join(plain.select(F.col("id").alias("plain_id"), F.col("text").alias("b")), "plain_id")
    kinds = f"{_kinds(matched)}, pairs array<long>, counts array<long>, sure double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b in zip(batch["a"], batch["b"]):
                x, y = points(a), points(b)
                left = max(0, (len(x) - len(y)) // 2)
                n = min(len(x) - left, len(y))
                pairs, counts = np.unique(x[left : left + n].astype(np.int64) << 32 | y[:n], return_counts=True)
                begins = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
                out.append((pairs, counts, np.maximum.reduceat(counts, begins).sum() / counts.sum()))
            yield pd.concat([batch[["id", "plain_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["pairs", "counts", "sure"])], axis=1)

    return saved(met.select("id", "plain_id", "a", "b").mapInPandas(run, kinds), "aligned")


def _kinds(matched: DataFrame) -> str:
    return f"id {matched.schema['id'].dataType.simpleString()}, plain_id {matched.schema['plain_id'].dataType.simpleString()}"


def _scored(aligned: DataFrame, key: dict[str, str] | None, least: float) -> DataFrame:
    """(id, plain_id, accuracy) of the pairs of which the share ``least`` or more agrees, and (cipher, plain, n), their votes, in other rows; saved.

    A task adds up the votes of each batch, so that they are no more than its pairs of characters.
    Without a key, what a pair's characters most often stand for says how far it agrees with any key.
    """
    columns = ["id", "plain_id", "accuracy", "cipher", "plain", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reads = _reading(key) if key is not None else None
        for b in batches:
            if len(b):
                pairs, counts = np.concatenate(b["pairs"].to_numpy()), np.concatenate(b["counts"].to_numpy())
                row = np.repeat(np.arange(len(b)), b["pairs"].str.len().to_numpy(np.int64))
                share = b["sure"].to_numpy()
                if reads is not None:
                    agrees = reads[pairs >> 32] == (pairs & 0xFFFFFFFF)
                    share = np.bincount(row, counts * agrees, len(b)) / np.bincount(row, counts, len(b))
                good = share >= least
                if not good.any():
                    continue
                yield b[["id", "plain_id"]].assign(accuracy=share, cipher=None, plain=None, n=None)[good]
                votes, place = np.unique(pairs[good[row]], return_inverse=True)
                n = np.bincount(place, counts[good[row]], len(votes)).astype(np.int64)
                yield pd.DataFrame({"id": None, "plain_id": None, "accuracy": None, "cipher": [chr(v >> 32) for v in votes.tolist()], "plain": [chr(v & 0xFFFFFFFF) for v in votes.tolist()], "n": n}, columns=columns)

    return saved(aligned.mapInPandas(run, f"{_kinds(aligned)}, accuracy double, cipher string, plain string, n long"), "scored")


def _assigned(votes: DataFrame) -> DataFrame:
    """(cipher, plain, votes): one to one. Characters that vote for each other most are joined, and taken out, again and again; saved."""
    left, out = saved(votes, "votes"), None
    while True:
        order = lambda c: F.struct(-F.col("votes"), F.col(c))
        a = left.groupBy("cipher").agg(F.min_by("plain", order("plain")).alias("plain"))
        b = left.groupBy("plain").agg(F.min_by("cipher", order("cipher")).alias("cipher"))
        sure = saved(left.join(a, ["cipher", "plain"]).join(b, ["cipher", "plain"]), "sure")
        if sure.isEmpty():
            return left if out is None else out
        out = sure if out is None else saved(out.unionByName(sure), "sure")
        rest = saved(left.join(sure.select("cipher"), "cipher", "left_anti").join(sure.select("plain"), "plain", "left_anti"), "votes")
        discard(left)
        left = rest


def solve(ciphers: DataFrame, plain: DataFrame, id_col: str, text_col: str, plain_id: str | None = None, plain_text: str | None = None, least: float = 0.8, padded: int = 1, rounds: int = 10) -> Solved:
    """The key of a substitution, and which plain text each cipher text stands for, from texts of which some are encryptions of the others.

    Texts meet if they have the same length (or the plain one's, padded on both sides to a multiple of ``padded``) and the same pattern
    of repeated characters in a window at the same place, which needs no key. Characters at the same places vote, and
    a one-to-one key is taken from the votes. With it, pairs of which less than the share ``least`` agrees lose their votes, and cipher texts
    meet plain ones again by windows as they read when decrypted. That is repeated until the key stays as it is, ``rounds`` times at most.

    Wrong characters in a cipher text are outvoted, and only spoil the windows that hold them. A character that is never at the same place
    as another has no place in the key and stays as it is. Null and empty texts and null ids take no part; of equal plain texts the least id counts.
    The key is as long as the alphabet, and passes the driver; texts don't.
    """
    asked = ciphers.filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = plain.filter(F.col(plain_id or id_col).isNotNull() & (F.length(plain_text or text_col) > 0)).select(F.col(plain_id or id_col).alias("id"), F.col(plain_text or text_col).alias("text"))
    both = ["id", "plain_id"]
    with passing() as keep:
        asked, before, last = saved(asked, "ciphers"), None, None
        # Of equal texts every window names the least id, so they need not be found, unless ids are not unique.
        if not plain.groupBy(F.col(plain_id or id_col).alias("id")).count().filter("id IS NOT NULL AND count > 1").isEmpty():
            known = saved(known.groupBy("text").agg(F.min("id").alias("id")), "plain")
        for _ in range(rounds):
            matched = _matched(asked, known, padded, before)
            if last is None:
                aligned = _aligned(matched, asked, known)
            else:  # what was aligned before stays as it is
                gone, new = saved(last.join(matched, both, "left_anti"), "gone"), saved(matched.join(last, both, "left_anti"), "new")
                aligned = aligned.join(gone, both, "left_anti").unionByName(_aligned(new, asked, known))
            last = matched
            scored = _scored(aligned, before, least)
            key = _assigned(scored.filter("n IS NOT NULL").groupBy("cipher", "plain").agg(F.sum("n").alias("votes")))
            now = {r.cipher: r.plain for r in key.collect()}
            if now == before:
                break
            before = now
        matches = saved(scored.filter("n IS NULL").select(*both, "accuracy"), "matches")
        keep(key, matches)
    return Solved(key, matches)

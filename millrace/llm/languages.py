"""Operator 13: the languages of a text, as a mixture whose shares expectation maximisation finds."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrowed, small_batches

#: Lengths of the n-grams, in letters; the end of a word counts as one.
ORDERS = (1, 2, 3, 4)
#: Buckets of n-grams are a power of two, this one at most; fewer with so many languages that buckets times languages pass ``CELLS``.
MOST_BITS, CELLS = 16, 1 << 22
#: Share of a language's n-grams that is spread over all buckets, so that unknown ones say nothing.
UNKNOWN = 0.02
#: What a further language must add to the log-likelihood: this, and ``PENALTY`` for each doubling of the text.
LEAST_GAIN, PENALTY = 6.0, 2.0
#: Rounds of expectation maximisation at most, and the largest change of a share that ends them.
ROUNDS, STILL = 60, 1e-4
#: N-grams of no language that a share is weighed against, so that short texts are less sure.
DOUBT = 4.0
#: Characters that are turned into n-grams at once.
_PIECE = 1 << 18


@dataclass(frozen=True)
class Profiles:
    """Log-probabilities of the buckets (rows) in each language (columns)."""

    languages: tuple[str, ...]
    log: np.ndarray
    bits: int


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        out[c] = chr(c).isalpha()
    return out


class Grams:
    """Bucket numbers of a text's n-grams; words are runs of letters, without regard to case."""

    def __init__(self, bits: int = MOST_BITS):
        self.letter, self.bits = letters(), bits

    def found(self, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, (place, bucket) of the n-grams of ``places``: letters, with a 0 between words.

        A word's n-grams reach over either end by one place, over one end at a time; a single place is a letter. The
        place is that of one of its letters.
        """
        inside, h = places != 0, np.zeros(len(places), np.uint64)
        for n in range(1, min(max(ORDERS), len(places)) + 1):
            h = h[: len(places) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + places[n - 1 :] + np.uint64(1)
            if n in ORDERS:
                ok = inside.copy() if n == 1 else inside[: len(h)] | inside[n - 1 :]
                for j in range(1, n - 1):
                    ok &= inside[j : j + len(h)]
                at = np.flatnonzero(ok)
                own = h[at]
                mixed = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield at + (n > 2 if n != 2 else ~inside[at]), (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _places(self, text: str) -> np.ndarray:
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(self.letter[x], x, 0).astype(np.uint64)

    def _long(self, text: str) -> np.ndarray:
        """Counts of a long text's buckets, by pieces: each begins with the last places of the one before, whose n-grams aren't counted again."""
        total, before = np.zeros(1 << self.bits, np.int64), np.zeros(1, np.uint64)
        for at in range(0, len(text), _PIECE):
            x = self._places(text[at : at + _PIECE])
            x = np.append(x, np.uint64(0)) if at + _PIECE >= len(text) else x
            x = np.concatenate([before, x[(x != 0) | (np.concatenate([before[-1:], x[:-1]]) != 0)]])
            old = [len(bucket) for _, bucket in self.found(before)]
            for (_, bucket), known in zip(self.found(x), [*old, *[0] * len(ORDERS)]):
                total += np.bincount(bucket[known:], minlength=1 << self.bits)
            before = x[-max(ORDERS) :]
        return total

    def _runs(self, texts: Iterable[str]) -> Iterator[tuple[list[int], np.ndarray | list[tuple[np.ndarray, np.ndarray]]]]:
        """(numbers, found) of runs of short texts, with (index in the run, bucket) by order; of a long text alone, the counts of its buckets."""
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            text = text.lower()
            if len(text) > _PIECE:
                yield [i], self._long(text)
                continue
            held.append((i, text))
            size += len(text)
            if size > _PIECE:
                yield self._run(held)
                held, size = [], 0
        if held:
            yield self._run(held)

    def _run(self, held: list[tuple[int, str]]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
        x = self._places("".join("\0" + t for _, t in held) + "\0")
        owner = np.repeat(np.arange(len(held) + 1), [*(len(t) + 1 for _, t in held), 1])
        kept = (x != 0) | (np.concatenate([[1], x[:-1]]) != 0)
        owner = owner[kept]
        return [i for i, _ in held], [(owner[at], bucket) for at, bucket in self.found(x[kept])]

    def counts(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number, buckets, how often each) of every text; long texts come before short ones that precede them."""
        for numbers, found in self._runs(texts):
            if isinstance(found, list):
                ends = [np.searchsorted(owner, np.arange(len(numbers) + 1)) for owner, _ in found]
                rows = ([bucket[e[j] : e[j + 1]] for (_, bucket), e in zip(found, ends)] for j in range(len(numbers)))
                rows = (np.sort(np.concatenate([np.zeros(0, np.int64), *r]).astype(np.uint16), kind="stable") for r in rows)
                begins = ((r, np.flatnonzero(np.concatenate([np.ones(min(1, len(r)), bool), r[1:] != r[:-1]]))) for r in rows)
                tallies = ((r[at].astype(np.int64), np.diff(np.append(at, len(r)))) for r, at in begins)
            else:
                tallies = [(np.flatnonzero(found), found[found > 0])]
            for i, (at, n) in zip(numbers, tallies):
                yield i, at, n

    def summed(self, texts: Iterable[str]) -> np.ndarray:
        """How often each bucket stands in all texts together."""
        total = np.zeros(1 << self.bits, np.int64)
        for _, found in self._runs(texts):
            for c in [np.bincount(bucket, minlength=1 << self.bits) for _, bucket in found] if isinstance(found, list) else [found]:
                total += c
        return total


def maximised(n: np.ndarray, p: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(shares, log-likelihood) of the mixture of the columns of p that makes n-grams counted n likeliest."""
    total = n.sum()
    share = np.full(p.shape[1], 1 / p.shape[1]) if start is None else start / start.sum()
    if p.shape[1] == 1:
        return np.ones(1), float(n @ np.log(p[:, 0]))
    for _ in range(ROUNDS):
        mix = p @ share
        new = share * ((n / mix) @ p) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < STILL:
            break
    return share, float(n @ np.log(p @ share))


def mixture(n: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, shares), the largest share first, of the set of languages with the best penalised likelihood.

    The mixture of all languages loses the one with the least share, again and again; each set on that way,
    and the best language alone, are weighed by their likelihood less the penalty for every further language.
    """
    log = log - log.max(1, keepdims=True)  # a bucket's common factor changes no choice
    alone = n @ log
    penalty = LEAST_GAIN + PENALTY * math.log2(1 + n.sum())
    first = int(alone.argmax())
    best = (float(alone[first]), np.array([first]), np.ones(1))
    # The likelihood is concave in the shares, so its slope at one language bounds what any mixture gains.
    with np.errstate(over="ignore"):
        if (n @ np.exp(log - log[:, [first]])).max() - n.sum() <= penalty:
            return best[1:]
    p = np.exp(log)
    left, share = np.arange(log.shape[1]), None
    while len(left) > 1:
        share, fit = maximised(n, p[:, left], share)
        if fit - penalty * (len(left) - 1) > best[0]:
            best = (fit - penalty * (len(left) - 1), left, share)
        if fit - penalty <= best[0]:  # smaller sets fit no better, and have one further language at least
            break
        gone = share * n.sum() < 1  # languages with less than one n-gram go together
        stays = ~gone if gone.any() and (~gone).sum() > 1 else np.arange(len(left)) != share.argmin()
        left, share = left[stays], share[stays]
    order = np.lexsort((best[1], -best[2]))
    return best[1][order], best[2][order]


def fit(docs: DataFrame, trains: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all languages named in ``lang_col``, from all whole texts of which ``trains`` holds.

    Every task counts its texts' n-grams by language and bucket; their sums, of stated size, go to the driver. Rows without
    text or language are not learned from, nor are languages without a letter in any text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.filter(trains) if trains is not None else docs
    rows = rows.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, counts = Grams(), {}

        def handed() -> Iterator[pd.DataFrame]:
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})
            counts.clear()

        for b in batches:
            for lang, texts in b["text"].groupby(b["lang"]):
                if lang not in counts:
                    if len(counts) == 64:
                        yield from handed()
                    counts[lang] = np.zeros(1 << MOST_BITS, np.int64)
                counts[lang] += grams.summed(texts)
        yield from handed()

    summed = rows.mapInPandas(run, "lang string, bucket long, n long")
    number = rows.select("lang").distinct().count()
    bits = max(6, min(MOST_BITS, (CELLS // max(1, number)).bit_length() - 1))
    folded = summed.groupBy("lang", F.shiftright("bucket", MOST_BITS - bits).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    langs = folded["lang"].to_numpy(zero_copy_only=False)
    names, column = np.unique(langs.astype(str), return_inverse=True) if len(langs) else (np.zeros(0, str), np.zeros(0, np.int64))
    counts = np.zeros((1 << bits, len(names)))
    counts[folded["bucket"].to_numpy(), column] = folded["n"].to_numpy()
    shares = counts / np.maximum(counts.sum(0), 1)
    return Profiles(tuple(map(str, names)), np.log((1 - UNKNOWN) * shares + UNKNOWN / (1 << bits)).astype(np.float32), bits)


def predict(profiles: Profiles, texts: Sequence[str], grams: Grams) -> list[tuple[str, float, list[str], list[float]]]:
    """(language, score, languages, shares) of each text, see ``predicted``."""
    out, many = [("und", 0.0, [], [])] * len(texts), len(profiles.languages)
    for i, at, n in grams.counts(texts):
        if len(n) and many:
            chosen, shares = mixture(n.astype(np.float64), profiles.log[at].astype(np.float64))
            size = n.sum() / len(ORDERS)
            out[i] = profiles.languages[chosen[0]], float((shares[0] * size + DOUBT / many) / (size + DOUBT)), [profiles.languages[j] for j in chosen], shares.tolist()
    return out


def predicted(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns of ``extra`` (over doc_id), lang_pred, score, languages and shares of every whole text.

    ``languages`` and ``shares`` are the mixture, the largest share first; ``lang_pred`` is its first, ties
    going to the first by name, and ``score`` that share, drawn towards an even one in short texts. A text
    that is null or has no letter, and every text if nothing was learned, is ``und`` with score 0 and no
    languages. A row for each input row, repeated ones alike. Very long texts are counted in pieces
    that share their ends, so nothing is lost between them. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = "lang_pred string, score double, languages array<string>, shares array<double>"

    @F.pandas_udf(kind)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams(profiles.bits)
        for b in texts:
            yield pd.DataFrame(predict(profiles, list(b), grams), columns=["lang_pred", "score", "languages", "shares"])

    rows = narrowed(docs, id_col, text_col).select("doc_id", *(c.alias(n) for n, c in (extra or {}).items()), found("text").alias("found"))
    return rows.select("doc_id", *(extra or {}), "found.*")

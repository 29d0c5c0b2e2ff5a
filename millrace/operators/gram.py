"""Fits that need sums of products alone: whitening, independent components, chained imputation.

Every round is one pass over the rows, whose sums are added up in Spark; the driver gets them as a few numbers a column and
does the algebra.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sums(df: DataFrame, cols: list[str], of) -> np.ndarray:
    """The total over all rows of ``of(matrix)``, a flat array for a batch of rows as floats (null: NaN)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                own = of(b.to_numpy(float, na_value=np.nan))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.i] = r.v
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    return x[np.isfinite(x).all(1)]


def _applied(df: DataFrame, cols: list[str], names: list[str], of) -> DataFrame:
    """``df`` with new columns: ``of(matrix)`` of the columns' values, NaN becoming null."""
    fields = ", ".join(f"`{n}` double" for n in names)

    @F.pandas_udf(fields)
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(of(b.to_numpy(float, na_value=np.nan)), columns=names).astype(object)
            yield out.where(out.notna(), None)

    row = F.struct(*(F.col(c).cast("double").alias(c) for c in cols))
    return df.withColumn("__made", made(row)).select(*(c for c in df.columns if c not in names), *(F.col(f"__made.{n}").alias(n) for n in names))


@dataclass(frozen=True)
class Components:
    """``rotation`` @ ``whitening`` @ (x - ``mean``) are the components."""

    mean: np.ndarray
    whitening: np.ndarray
    rotation: np.ndarray
    rounds: int

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.rotation @ self.whitening).T


def fit_whitening(df: DataFrame, cols: list[str], k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, whitening matrix) of the first ``k`` principal directions, of columns on a common scale, that vary at all; from one pass.

    Rows with a null or infinite value are left out.
    """
    d = len(cols)

    def of(x: np.ndarray) -> np.ndarray:
        x = np.column_stack([_whole(x), np.ones(len(_whole(x)))])
        return (x.T @ x).ravel()

    got = _sums(df, cols, of).reshape(d + 1, d + 1) if cols else np.zeros((1, 1))
    if not got.size or got[-1, -1] < 2:
        raise ValueError("too few rows without gaps")
    n, mean = got[-1, -1], got[-1, :-1] / got[-1, -1]
    spread = got[:-1, :-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.where(np.diag(spread) > 1e-12 * np.maximum(mean * mean, 1e-300), np.diag(spread), np.inf))
    values, vectors = np.linalg.eigh(spread / np.outer(scale, scale))
    order = [i for i in np.argsort(-values) if values[i] > 1e-9][:k]
    return mean, (vectors[:, order] / np.sqrt(values[order])).T / scale


def fit_independent(df: DataFrame, cols: list[str], k: int | None = None, rounds: int = 200, still: float = 1e-6, seed: int = 42) -> Components:
    """Independent components by fixed-point rounds on whitened columns, all at once, with log cosh as contrast; deterministic."""
    mean, whitening = fit_whitening(df, cols, k)
    k = len(whitening)

    def orthogonal(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w)
        return u @ v

    w = orthogonal(np.random.default_rng(seed).normal(size=(k, k)))
    done = 0
    for done in range(1, rounds + 1):

        def of(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = (_whole(x) - mean) @ whitening.T
            g = np.tanh(z @ w.T)
            return np.concatenate([(g.T @ z).ravel(), (1 - g * g).sum(0), [len(z)]])

        s = _sums(df, cols, of)
        n = s[-1]
        new = orthogonal(s[: k * k].reshape(k, k) / n - (s[k * k : -1] / n)[:, None] * w)
        moved = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if moved < still:
            break
    return Components(mean, whitening, w, done)


def independent_components(df: DataFrame, cols: list[str], k: int, model: Components | None = None) -> DataFrame:
    """ica_0 ... of variance 1, null in rows with a null or infinite column, and where columns have fewer directions. Signs and order are free."""
    model = model or fit_independent(df, cols, k)

    def of(x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            found = np.full((len(x), k), np.nan)
            found[:, : len(model.rotation)] = np.where(np.isfinite(x).all(1)[:, None], model.of(np.where(np.isfinite(x), x, 0)), np.nan)
            return found

    return _applied(df, cols, [f"ica_{i}" for i in range(k)], of)


@dataclass(frozen=True)
class Chain:
    """What fills gaps: means first, then for each round an intercept and weights of the other columns for every column."""

    means: np.ndarray
    steps: list[np.ndarray]

    def of(self, x: np.ndarray) -> np.ndarray:
        gaps = ~np.isfinite(x)
        out = np.where(gaps, self.means, x)
        for w in self.steps:
            out = np.where(gaps, w[:, 0] + out @ w[:, 1:].T, out)
        return out


def fit_chain(df: DataFrame, cols: list[str], rounds: int = 10, still: float = 1e-3, ridge: float = 0.0) -> Chain:
    """Regressions of every column on all others, fitted on the rows that have it, with the gaps of the others filled by the round before.

    Each round is one pass, which sums the products of all columns for the rows that have each of them; all columns are
    refitted at once. Rounds end when no weight that fills gaps has moved by ``still``, on the scale of the columns' spread.
    """
    d = len(cols)

    def known(x: np.ndarray) -> np.ndarray:
        ok = np.isfinite(x)
        y = np.where(ok, x, 0)
        return np.concatenate([ok.sum(0), y.sum(0), (y * y).sum(0), [len(x)]])

    first = _sums(df, cols, known)
    if not first.size or not first[:d].all():
        raise ValueError("a column has no value at all")
    means = first[d : 2 * d] / first[:d]
    spread = np.sqrt(np.maximum(first[2 * d : 3 * d] / first[:d] - means**2, 0))
    scale, gapped = np.where(spread > 0, spread, 1), first[:d] < first[-1]
    chain, before = Chain(means, []), np.zeros((d, d + 1))
    for _ in range(rounds):

        def of(x: np.ndarray, chain: Chain = chain) -> np.ndarray:
            z = np.column_stack([np.ones(len(x)), (chain.of(x) - means) / scale])
            ok = np.isfinite(x)
            return np.concatenate([(z[ok[:, c]].T @ z[ok[:, c]]).ravel() for c in range(d)])

        grams = _sums(df, cols, of).reshape(d, d + 1, d + 1)
        step = np.zeros((d, d + 1))  # of columns on a common scale
        for c in range(d):
            own = [0, *(j + 1 for j in range(d) if j != c)]
            a = grams[c][np.ix_(own, own)] + ridge * np.diag([0.0, *[1.0] * (d - 1)])
            step[c, own] = np.linalg.lstsq(a, grams[c][own, c + 1], rcond=None)[0]
        weights = scale[:, None] * step[:, 1:] / scale
        chain = Chain(means, [*chain.steps, np.column_stack([means + scale * step[:, 0] - weights @ means, weights])])
        if (np.abs(step - before).max(1)[gapped] < still).all():
            break
        before = step
    return chain


def impute_chained(df: DataFrame, cols: list[str], rounds: int = 10, still: float = 1e-3, chain: Chain | None = None) -> DataFrame:
    """``df`` with the nulls, NaN and infinities of the columns filled by regressions on each other, see ``fit_chain``; the columns become doubles."""
    chain = chain or fit_chain(df, cols, rounds, still)
    return _applied(df, cols, cols, chain.of).select(*df.columns)

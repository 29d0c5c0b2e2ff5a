"""Operator 6: a byte-level convolutional network in numpy that rates text quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrowed, passing, small_batches
from .toxicity import sampled

#: Labelled rows of either label that a network is fitted on at most.
SAMPLE = 1_500
#: Filters, and the bytes that each sees.
FILTERS, WIDTH = 8, 4
#: Bytes of a block; a chunk is ``CHUNK`` blocks and shares one with the next.
BLOCK, CHUNK = 128, 8
#: A byte counts as repeated if this many bytes from it on stand up to ``LAGS`` bytes earlier, too.
RUN, LAGS = 16, 32
SYMBOLS = 513  # a byte, a repeated byte, padding
#: Symbols that go through the network at once.
_PIECE = 1 << 18


@dataclass(frozen=True)
class Network:
    table: np.ndarray  # WIDTH, SYMBOLS, FILTERS
    bias: np.ndarray
    out: np.ndarray  # weights of mean and maximum over chunks, then the intercept


def symbols(text: str) -> np.ndarray:
    """A text's bytes, each told apart by whether it begins a repetition of what stands just before it; padded to whole blocks."""
    x = np.frombuffer(text.encode(), np.uint8)
    n = len(x)
    repeated = np.zeros(n, bool)
    for lag in range(2, min(LAGS, n - RUN) + 1):
        same = x[lag:] == x[:-lag]
        span = 1
        while span < RUN:
            same = same[:-span] & same[span:]
            span *= 2
        repeated[lag : lag + len(same)] |= same
    out = np.full(max(1, -(-n // BLOCK)) * BLOCK + WIDTH - 1, SYMBOLS - 1, np.int16)
    out[:n] = x.astype(np.int16) + 256 * repeated
    return out


def _convolved(net: Network, s: np.ndarray) -> np.ndarray:
    n = len(s) - WIDTH + 1
    z = net.table[0][s[:n]]
    for j in range(1, WIDTH):
        z += net.table[j][s[j : j + n]]
    return z


def _pooled(net: Network, s: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(chunks, filters): the largest response of each filter in each chunk, and where it is."""
    n_blocks = (len(s) - WIDTH + 1) // BLOCK
    tops, where = [], []
    per = _PIECE // BLOCK
    for b in range(0, n_blocks, per):
        e = min(n_blocks, b + per)
        z = _convolved(net, s[b * BLOCK : e * BLOCK + WIDTH - 1]).reshape(e - b, BLOCK, -1)
        if places:
            at = z.argmax(1)
            where.append(at + (np.arange(b, e) * BLOCK)[:, None])
            tops.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        else:
            tops.append(z.max(1))
    top = np.concatenate(tops)
    starts = np.arange(0, max(1, n_blocks - 1), CHUNK - 1)
    chunks = [slice(a, a + CHUNK) for a in starts]
    if not places:
        return np.stack([top[c].max(0) for c in chunks]), None
    at = np.concatenate(where)
    best = np.stack([top[c].argmax(0) + c.start for c in chunks])
    cols = np.arange(top.shape[1])
    return top[best, cols], at[best, cols]


def _combined(net: Network, z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    h = np.maximum(z + net.bias, 0)
    features = np.concatenate([h.mean(0), h.max(0)])
    return float(features @ net.out[:-1] + net.out[-1]), h, features


def score(net: Network, text: str) -> float:
    logit, _, _ = _combined(net, _pooled(net, symbols(text))[0])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def gradients(net: Network, s: np.ndarray, label: float, weight: float = 1.0) -> list[np.ndarray]:
    """Of the weighted logistic loss of one text's symbols, for the filter table, the bias and the output."""
    grads = [np.zeros_like(p) for p in (net.table, net.bias, net.out)]
    z, at = _pooled(net, s, places=True)
    logit, h, features = _combined(net, z)
    d = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
    grads[2][:-1] += d * features
    grads[2][-1] += d
    dh = np.repeat(d * net.out[None, :FILTERS] / len(h), len(h), 0)
    dh[h.argmax(0), np.arange(FILTERS)] += d * net.out[FILTERS:-1]
    dh = dh * (h > 0)
    grads[1] += dh.sum(0)
    f = np.broadcast_to(np.arange(FILTERS), at.shape)
    for j in range(WIDTH):
        np.add.at(grads[0][j], (s[at + j], f), dh)
    grads[0][:, SYMBOLS - 1] = 0  # padding stays at 0
    return grads


def train(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit filters and output by Adam on the logistic loss, both labels weighing alike."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
    table[:, SYMBOLS - 1] = 0
    net = Network(table, np.zeros(FILTERS, np.float32), np.append(rng.normal(0, 0.3, 2 * FILTERS), 0.0).astype(np.float32))
    if len(set(labels)) < 2:
        return Network(table * 0, net.bias, np.append(np.zeros(2 * FILTERS), 3.0 if 1 in labels else 0.0).astype(np.float32))
    inputs, y = [symbols(t) for t in texts], np.array(labels, np.float32)
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    params = [net.table, net.bias, net.out]
    first, second, steps = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(inputs))
        for begin in range(0, len(order), 32):
            grads = [np.zeros_like(p) for p in params]
            batch = order[begin : begin + 32]
            for i in batch:
                for total, g in zip(grads, gradients(net, inputs[i], y[i], weight[i] / len(batch))):
                    total += g
            steps += 1
            step = rate * (1 - epoch / epochs)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= step * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-7) + 1e-5 * p
    return net


def fit(docs: DataFrame, labels: DataFrame, trains: Column, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Network:
    """Train on at most ``size`` labelled rows of either label. The sample is bounded, so it fits the driver."""
    rows = []
    with passing():
        for value in (0, 1):
            rows += sampled(docs, labels, label, trains & (F.col(label) == value), size, id_col, text_col).collect()
    rows.sort(key=lambda r: (r.text, r.label))
    return train([r.text for r in rows], [r.label for r in rows])


def quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Score every whole text, chunk by chunk: doc_id, the columns of ``extra`` (over doc_id), score from 0 to 1.

    A row for each input row, repeated ones alike. Null and empty texts are one chunk of padding and
    get the network's score for that. Responses of very long texts are computed in pieces; their
    bytes are held whole, with about 8 bytes of a task's memory for each. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in texts:
            yield pd.Series([score(net, t) for t in b], dtype="float64")

    return narrowed(docs, id_col, text_col).select("doc_id", *(c.alias(n) for n, c in (extra or {}).items()), scored("text").alias("score"))

"""Operator 11: codes of vectors by one codebook for each part of them, learned by filtering Lloyd rounds.

Every block of vectors is turned once into a kd-tree for each part, whose nodes hold the box, the sum and
the number of their parts. A round walks those trees with the codebook: a node's box rules entries out, and
where one entry is left the whole subtree is assigned by its sum and number, without looking at its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import passing, saved, small_batches

#: Parts of a vector, entries of a codebook, rounds, and steps that a component of 1 has.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one block, which has its own trees, and parts of a leaf at least.
BLOCK, LEAF = 8192, 16
#: Rows of labels that are broadcast at most.
BROADCAST_LABELS = 10_000


def _kind(most: int, width: int) -> type:
    """A type in which the squared distances of integers up to ``most`` stay exact: floats, 64-bit or unbounded integers."""
    room = 16 * most * most * width
    return np.float64 if room < 1 << 53 else np.int64 if room < 1 << 63 else object


def _most(*arrays: np.ndarray) -> int:
    return max((int(np.abs(a).max(initial=0)) for a in arrays), default=0)


class Coded(NamedTuple):
    """What ``vector_codes`` returns: the codes, and each part's codebook (entries by components, as integers)."""

    table: DataFrame
    books: list[np.ndarray]


@dataclass
class Tree:
    """A kd-tree over points in heap order: level l has 2^l nodes, node i of it the points order[cuts[l][i]:cuts[l][i + 1]]."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def levels(n: int, leaf: int = LEAF) -> int:
    """Splits above the leaves of a tree over n points."""
    return max(0, (n // leaf).bit_length() - 1)


def cuts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end."""
    out = np.array([0, n])
    for _ in range(level):
        out = np.sort(np.concatenate([out, (out[:-1] + out[1:]) // 2]))
    return out


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Split at the median of the widest side, all nodes of a level at once."""
    n, order, boxes = len(points), np.arange(len(points)), []
    for level in range(levels(n, leaf) + 1):
        at, p = cuts(n, level), points[order]
        low, high = np.minimum.reduceat(p, at[:-1]), np.maximum.reduceat(p, at[:-1])
        boxes.append((low, high, np.add.reduceat(p, at[:-1])))
        if level < levels(n, leaf):
            node = np.repeat(np.arange(len(at) - 1), np.diff(at))
            widest = p[np.arange(n), (high - low).argmax(1)[node]]
            order = order[np.lexsort((widest, node))]
    return Tree(order, *(np.concatenate(x) for x in zip(*boxes)))


def assign(tree: Tree, points: np.ndarray, book: np.ndarray, leaf: int = LEAF, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point, number and sum of each entry's points): the nearest entry by squared distance, ties to the lower index.

    From the root down, a node keeps the entries that some point of its box may be nearest to: entry z goes
    if at every corner of the box, and so at every point, the entry nearest to the middle is nearer. ``counts``
    adds up under "pairs" how often a point met an entry, and under "nodes" how often a box did.
    """
    n, k = len(points), len(book)
    chosen, number, total = np.zeros(n, np.int64), np.zeros(k, np.int64), np.zeros(book.shape, points.dtype)
    kind = _kind(_most(points, book), book.shape[1])
    work, entries, low, high = (a.astype(kind) for a in (points, book, tree.low, tree.high))
    norms = (entries * entries).sum(1)
    apart = np.abs(entries[:, None] - entries[None])  # [nearest, other]
    index, depth = np.arange(k), levels(n, leaf)
    nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(depth + 1):
        if not len(nodes):
            break
        first, at = (1 << level) - 1, cuts(n, level)
        lo, hi = low[first + nodes], high[first + nodes]
        twice = (lo + hi) @ entries.T  # 2 (middle . entry)
        far = norms - twice  # squared distance to the middle, but for what all entries share
        if far.dtype == object:
            far = np.array([[x if ok else None for x, ok in zip(*row)] for row in zip(far, left)], object)
            near = np.array([min((x, i) for i, x in enumerate(row) if x is not None)[1] for row in far])
        else:
            near = np.where(left, far, np.inf if far.dtype == np.float64 else np.iinfo(np.int64).max).argmin(1)
        slack = norms - norms[near][:, None] - (twice - np.take_along_axis(twice, near[:, None], 1))
        if slack.dtype == object:
            slack = slack - np.array([(apart[i] * w).sum(1) for i, w in zip(near, hi - lo)], object).reshape(slack.shape)
        else:
            for i in np.unique(near):  # what the box adds: its sides along the way between two entries
                own = near == i
                slack[own] -= (hi - lo)[own] @ apart[i].T
        keep = left & ((slack < 0) | ((slack == 0) & (index <= near[:, None])))
        if counts is not None:
            counts["nodes"] = counts.get("nodes", 0) + int(left.sum())
        alone = keep.sum(1) == 1
        for node, i in zip(nodes[alone], keep[alone].argmax(1)):
            chosen[tree.order[at[node] : at[node + 1]]] = i
            number[i] += at[node + 1] - at[node]
            total[i] += tree.sums[first + node]
        nodes, left = nodes[~alone], keep[~alone]
        if level < depth:
            nodes, left = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([left, left])
    ends = cuts(n, depth)
    for node, open_ in zip(nodes, left):
        own, z = tree.order[ends[node] : ends[node + 1]], np.flatnonzero(open_)
        best = z[(norms[z] - 2 * (work[own] @ entries[z].T)).argmin(1)]
        if counts is not None:
            counts["pairs"] = counts.get("pairs", 0) + len(own) * len(z)
        chosen[own] = best
        np.add.at(number, best, 1)
        np.add.at(total, best, points[own])
    return chosen, number, total


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit where that holds it, else unbounded integers."""
    x = vectors.astype(np.float64)
    if np.abs(x).max(initial=0) < (1 << 48) / scale:  # a block's sums stay within 64 bits
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale)) for v in x.ravel()], object).reshape(x.shape)


def _dumps(a: np.ndarray) -> bytes:
    if a.dtype == object:
        return b"t" + ",".join(map(str, a.ravel())).encode()
    return b"8" + a.astype("<i8").tobytes() if _most(a) >= 1 << 31 else b"4" + a.astype("<i4").tobytes()


def _loads(b: bytes, width: int) -> np.ndarray:
    if b[:1] == b"t":
        return np.array([int(v) for v in b[1:].split(b",")], object).reshape(-1, width)
    return np.frombuffer(b, f"<i{b[:1].decode()}", offset=1).astype(np.int64).reshape(-1, width)


def kept_vectors(df: DataFrame, id_col: str, vector: str, label: str | None, parts: int) -> DataFrame:
    """(id, label, v) of the rows whose vector has no null and no non-finite component, and the length that most of them have."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(vector).isNotNull() & sound).select(F.col(id_col).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("size")).count().filter((F.col("size") > 0) & (F.col("size") % parts == 0)).agg(F.max_by("size", F.struct("count", "size")).alias("size")).first()
    return rows.filter(F.size("v") == (sizes.size if sizes.size else -1))


def _trees(rows: DataFrame, parts: int, width: int, scale: int, block: int, leaf: int) -> DataFrame:
    """A row for each block of vectors: ids and labels as text, and the points and tree of each part as binary columns."""
    blobs = [f"{c}{p} binary" for p in range(parts) for c in ("points", "order", "low", "high", "sums")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def made() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            x = whole_numbers(np.stack([np.asarray(v) for v in rows["v"]]), scale)
            out = {"ids": [list(rows["id"])], "labels": [list(rows["label"])]}
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                tree = grow(own, leaf)
                out |= {f"points{p}": [_dumps(own)], f"order{p}": [tree.order.astype("<i4").tobytes()], f"low{p}": [_dumps(tree.low)], f"high{p}": [_dumps(tree.high)], f"sums{p}": [_dumps(tree.sums)]}
            return pd.DataFrame(out)

        for b in batches:
            while len(b):
                held.append(b.iloc[: block - size])
                b, size = b.iloc[block - size :], size + len(held[-1])
                if size == block:
                    yield made()
                    held.clear()
                    size = 0
        if size:
            yield made()

    texts = [F.col(c).cast("string").alias(c) for c in ("id", "label")]  # numbers with nulls would become floats
    return rows.select(*texts, "v").mapInPandas(run, f"ids array<string>, labels array<string>, {', '.join(blobs)}")


def _read_tree(row, p: int, width: int) -> tuple[Tree, np.ndarray]:
    order = np.frombuffer(row[f"order{p}"], "<i4")
    return Tree(order, *(_loads(row[f"{c}{p}"], width) for c in ("low", "high", "sums"))), _loads(row[f"points{p}"], width)


def _moved(trees: DataFrame, books: list[np.ndarray], width: int, leaf: int) -> list[np.ndarray]:
    """The codebooks after one round. A task adds up its blocks, and Spark the tasks' sums: a row for each entry reaches the driver."""
    parts = len(books)
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for row in batch.to_dict("records"):
                for p in range(parts):
                    _, n, s = assign(*_read_tree(row, p, width), books[p], leaf)
                    number[p] += n
                    total[p] += s
        rows = [(p, int(i), int(number[p][i]), *map(str, total[p][i])) for p in range(parts) for i in np.flatnonzero(number[p])]
        if rows:
            yield pd.DataFrame(rows, columns=["part", "entry", "n", *names])

    sums = trees.drop("ids", "labels").mapInPandas(run, f"part int, entry int, n long, {', '.join(f'{c} string' for c in names)}")
    found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names)).collect()
    out = [b.copy() for b in books]
    for r in found:
        mean = [int(r[c]) // r.n for c in names]
        if max(map(abs, mean)) >= 1 << 62 and out[r.part].dtype != object:
            out[r.part] = out[r.part].astype(object)
        out[r.part][r.entry] = mean
    return out


def _coded(trees: DataFrame, books: list[np.ndarray], width: int, leaf: int) -> DataFrame:
    """(id, label, code, error) of every vector by the final codebooks, ids and labels as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                codes, error = [], 0
                for p, book in enumerate(books):
                    tree, points = _read_tree(row, p, width)
                    chosen, _, _ = assign(tree, points, book, leaf)
                    exact = object if _kind(_most(points, book), width * len(books)) is object else np.int64
                    off = points.astype(exact) - book[chosen]
                    error = error + (off * off).sum(1)
                    codes.append(chosen)
                if int(error.max()) >= 1 << 63:
                    raise ValueError("a squared distance is over what a 64-bit integer holds")
                yield pd.DataFrame({"id": row["ids"], "label": row["labels"], "code": ["".join(f"{c:02x}" for c in v) for v in zip(*codes)], "error": error.astype(np.int64)})

    return trees.mapInPandas(run, "id string, label string, code string, error long")


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> Coded:
    """(id_col, code, error, label_error, codebooks_sha256) of every kept vector, and the codebooks.

    A component x counts as floor(scale * x); a vector is cut into ``parts`` equal ones. A part's codebook
    begins as that part of the ``entries`` smallest ids (ties: by the vector), and each round moves every
    entry to the floored mean of the parts nearest to it. ``code`` has two hex digits a part, ``error`` is
    the squared distance to the code, ``label_error`` its sum over equal labels, null ones together.

    Rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of
    another length than most kept ones have that ``parts`` divides (ties: the longer). Repeated rows are
    vectors of their own; a null id comes after all others. Fewer vectors than ``entries`` make a smaller
    codebook. Other columns are ignored; an empty table gives an empty result. An error of 2^63 or more is
    an error. Only codebooks, of stated size, pass the driver.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry takes two hex digits, so there are 256 at most")
    spark = df.sparkSession
    small_batches(spark)
    with passing() as keep:
        rows = kept_vectors(df, id_col, vector, label, parts)
        first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        width = len(first[0].v) // parts if first else 1
        start = whole_numbers(np.array([r.v for r in first], np.float64).reshape(len(first), width * parts), scale)
        books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
        trees = saved(_trees(rows, parts, width, scale, block, leaf), "trees")
        for _ in range(rounds if first else 0):
            books = _moved(trees, books, width, leaf)
        coded = saved(_coded(trees, books, width, leaf), "coded")
        keep(coded)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    small = errors.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    out = coded.join(F.broadcast(errors) if small else errors, F.col("label").eqNullSafe(F.col("of")))
    return Coded(out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books)


def decoded(code: str, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vectors that a column of codes stands for, as array<double>: each component in the middle of its step. A null code gives null."""

    @F.pandas_udf("array<double>")
    def vectors(codes: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else np.concatenate([(b[i].astype(np.float64) + 0.5) / scale for b, i in zip(books, bytes.fromhex(c))]) for c in codes])

    return vectors(code)

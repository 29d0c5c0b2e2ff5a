"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, passing, release, saved, saved_apart, shared_dir

__all__ = ["discard", "passing", "release", "saved", "saved_apart", "shared_dir"]

#: ASCII white space, as the word definitions of operators 4 and 9 take it.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of one Arrow batch sent to a Python worker; bounds its memory with very long texts.
BATCH_BYTES = 1 << 20
#: Hashes that several rows share at most; 10^12 rows are expected to have 27,000.
MOST_SHARED = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application, wherever they were started."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root, folder = Path(__file__).resolve().parents[2], tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the file when they need it
    target = os.path.join(folder, "millrace_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "millrace").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(target)
    sc._millrace_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Prepare the workers, and bound Arrow batches by bytes unless the session already says how."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):  # unset, or Spark's default
        spark.conf.set(key, str(BATCH_BYTES))


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just ``doc_id`` and ``text`` (null: empty), so that no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_keys(df: DataFrame, *cols: str, first: Callable[..., Column] = F.xxhash64) -> Column:
    """A 64-bit key of the columns' values: equal values have equal keys, and different ones have different keys.

    Of 10^10 rows a few would share a 64-bit hash. Such hashes are found first, by a second one, in
    one grouped pass over two numbers a row, and the rows that have them get the second hash as key.
    """
    flags = [F.col(c).isNull() for c in cols]  # hashes pass nulls over, and so would not see which column has one
    key, other = first(*cols, *flags), F.xxhash64(F.lit(1), *cols, *flags)
    seen = df.select(key.alias("key"), other.alias("other")).groupBy("key").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    shared = [r.key for r in seen.filter("lo != hi").select("key").limit(MOST_SHARED + 1).collect()]
    if len(shared) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} row hashes are not unique")
    return F.when(key.isin(shared), other).otherwise(key) if shared else key


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in; other text a character map."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


#: Bytes that a task gathers before it deals them out.
DEAL_BYTES = 4 << 20


def dealt(arrays: Iterable[dict[str, np.ndarray]], by: str, parts: int, kind: int = 0) -> Iterator[pd.DataFrame]:
    """Deal parallel arrays out by the hash ``by``: a row for each part that got some, as binary columns.

    A shuffle of such rows moves the bare numbers, without a row's overhead for each.
    """

    def rows(held: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        x = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        part = ((x[by] >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.concatenate([part[order][1:] != part[order][:-1], [True]])) + 1
        cuts = list(zip([0, *ends[:-1]], ends))
        return pd.DataFrame({"kind": np.int8(kind), "part": part[order][ends - 1]} | {c: [v[order[a:z]].tobytes() for a, z in cuts] for c, v in x.items()})

    held, size = [], 0
    for x in arrays:
        if len(x[by]):
            held.append(x)
            size += sum(v.nbytes for v in x.values())
        if size > DEAL_BYTES:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def blobs_of(part: pd.DataFrame, kinds: dict) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(part[c]), kind) for c, kind in kinds.items()}

"""Intermediate tables in the cluster's shared folder: they cut lineage and survive lost executors.

All tables of an application lie in one folder of its own below ``spark.checkpoint.dir``. What an
operator needs only while it builds its plan it discards itself; what its lazy result still reads
stays until ``release``, which also runs when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local one is set where none is configured, on local masters only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def place(spark: SparkSession, name: str) -> str:
    """A new path for a table or files of this application."""
    sc = spark.sparkContext
    if not getattr(sc, "_millrace_releases", False):
        sc._millrace_releases = True
        atexit.register(_at_exit, spark)
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = place(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")  # the table replaces the shuffle files, which would else stay on disk
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def saved_apart(df: DataFrame, name: str, by: str, values: list) -> list[DataFrame]:
    """As ``saved``, in one pass, but a table of its own, without the column ``by``, for each of its few values."""
    spark, path, key = df.sparkSession, place(df.sparkSession, name), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(len(values)))  # so that rows need not be sorted by value
    try:
        df.write.partitionBy(by).parquet(path)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    out, schema = [], df.drop(by).schema
    for v in values:
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={v}")
        there = own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)
        part = spark.read.schema(schema).parquet(f"{path}/{by}={v}") if there else spark.createDataFrame([], schema)
        part.saved_at = f"{path}/{by}={v}"
        if _scopes:
            _scopes[-1].append(part)
        out.append(part)
    return out


#: Tables saved in the scopes that are open.
_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def passing() -> Iterator[Callable[..., None]]:
    """Tables saved inside are discarded at the end, and on failure, but for those given to ``keep``, which it yields."""
    made, kept = [], []
    _scopes.append(made)
    try:
        yield lambda *tables: kept.extend(tables)
    except BaseException:
        kept.clear()
        raise
    finally:
        _scopes.pop()
        for df in made:
            if any(df is k for k in kept):
                if _scopes:
                    _scopes[-1].append(df)
            else:
                discard(df)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.saved_at)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that were not written out can't be read afterwards."""
    _delete(spark, _own(spark))


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        release(spark)

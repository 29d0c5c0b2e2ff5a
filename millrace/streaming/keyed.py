"""Features of series on a stream, by state kept for each key: what is known of a series before each of its rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = StructType([StructField("last", DoubleType()), StructField("n", LongType()), StructField("mean", DoubleType()), StructField("m2", DoubleType()), StructField("smooth", DoubleType()), StructField("gap", LongType())])


class _Series(StatefulProcessor):
    """State of one key: the last time, number, mean and squared deviations of its values, and their smoothed mean with the rows since it moved."""

    def __init__(self, value: str, columns: list[str], span: float, idle: float | None, ttl: int | None):
        self.value, self.columns, self.idle, self.ttl = value, columns, idle, ttl
        self.alpha = 2.0 / (span + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", _STATE, self.ttl) if self.ttl else handle.getValueState("series", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch.columns = [*self.columns, "__t"]  # Spark renames columns that are no Python names
        batch = batch.sort_values("__t", kind="stable", na_position="first")
        last, n, mean, m2, smooth, gap = self.state.get() if self.state.exists() else (None, 0, 0.0, 0.0, None, 0)
        out = []
        for t, v in zip(batch["__t"], batch[self.value]):
            if math.isnan(t) or (last is not None and t < last):
                out.append((None, None, None, None, True))
                continue
            if self.idle is not None and last is not None and t - last > self.idle:
                n, mean, m2, smooth, gap = 0, 0.0, 0.0, None, 0
            out.append((n, mean if n else None, m2 / (n - 1) if n > 1 else None, smooth, False))
            last, gap = float(t), gap + 1
            if v is not None and not math.isnan(v):
                n += 1
                off = float(v) - mean
                mean += off / n
                m2 += off * (float(v) - mean)
                old = (1 - self.alpha) ** gap
                smooth, gap = float(v) if smooth is None else (old * smooth + self.alpha * float(v)) / (old + self.alpha), 0
        if last is not None:
            self.state.update((last, n, mean, m2, smooth, gap))
        made = pd.DataFrame(out, columns=["n_before", "mean_before", "var_before", "smooth_before", "late"], index=batch.index).astype({"n_before": "Int64"})
        yield pd.concat([batch[self.columns], made], axis=1)

    def close(self) -> None:
        pass


def series_features(rows: DataFrame, keys: list[str], time: str, value: str, span: float = 7, idle_seconds: float | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The rows of a stream with n_before, mean_before, var_before, smooth_before and late: what its key's earlier values come to.

    The smoothed mean is that of ``windows.ewm``, the others are those of ``windows.expanding``: a row never counts for
    itself, and nulls and NaN are gaps. Rows of a micro-batch go by time; one that is older than what its key has seen in earlier
    batches, or has no time, comes out as late, without features, and changes nothing. A key that pauses for more than ``idle_seconds`` begins
    anew; with ``ttl_ms`` its state is deleted when it has not been touched for so long. ``time`` is a date, a timestamp or a number (of seconds).

    State is a few numbers for each key. The session needs ``STATE_STORE`` as ``spark.sql.streaming.stateStore.providerClass``.
    """
    columns, seconds = rows.columns, F.col(time).cast("timestamp") if rows.schema[time].dataType == DateType() else F.col(time)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n_before long, mean_before double, var_before double, smooth_before double, late boolean"
    return rows.withColumn("__t", seconds.cast("double")).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Series(value, columns, span, idle_seconds, ttl_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )

"""State of series on a stream, against the batch operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.streaming import keyed as S

SCHEMA = "k long, t long, v double, other string"


@pytest.fixture
def streaming(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def streamed(session, tmp_path, batches, **how):
    """What a stream gives that reads the batches one after another."""
    for i, rows in enumerate(batches):
        session.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    (tmp_path / "now").mkdir()
    for i in range(len(batches)):  # a folder more for each run, so that batches come in order
        (tmp_path / "in" / str(i)).rename(tmp_path / "now" / str(i))
        source = session.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/now")
        sink = S.series_features(source, ["k"], "t", "v", **how).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        sink.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return session.read.parquet(f"{tmp_path}/out")


def test_streamed_features_equal_the_batch_operators(streaming, tmp_path):
    rng = random.Random(1)
    rows = [(k, t, None if rng.random() < 0.15 else rng.uniform(-5, 5) * 10 ** rng.randint(0, 3), "x") for t in range(60) for k in range(5) if rng.random() < 0.8]
    batches = [[r for r in rows if a <= r[1] < z] for a, z in ((0, 20), (20, 21), (21, 60))]
    for b in batches:
        rng.shuffle(b)
    got = {(r.k, r.t): r for r in streamed(streaming, tmp_path, batches).collect()}
    df = streaming.createDataFrame(rows, SCHEMA)
    want = {(r.k, r.t): r for r in W.ewm(W.expanding(df, "v", ["k"], ["t"], ["count", "mean", "var"]), "v", ["k"], ["t"], 7).collect()}
    assert got.keys() == want.keys() and not any(r.late for r in got.values())
    for at, r in got.items():
        w = want[at]
        assert r.n_before == w.v_exp_count and r.v == w.v and r.other == "x"
        for a, b in ((r.mean_before, w.v_exp_mean), (r.var_before, w.v_exp_var), (r.smooth_before, w.v_ewm)):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9))


def test_late_rows_and_pauses(streaming, tmp_path):
    batches = [[(1, 10, 4.0, "a"), (2, 10, 1.0, "a")], [(1, 5, 100.0, "late"), (1, 12, 6.0, "b"), (1, None, 7.0, "never")], [(1, 13, 1.0, "c"), (2, 50, 9.0, "new"), (2, 51, 3.0, "next"), (1, 13, 5.0, "same")]]
    got = {(r.k, r.other): (r.n_before, r.mean_before, r.late) for r in streamed(streaming, tmp_path, batches, idle_seconds=30.0).collect()}
    assert got == {
        (1, "a"): (0, None, False), (2, "a"): (0, None, False), (1, "late"): (None, None, True), (1, "b"): (1, 4.0, False), (1, "never"): (None, None, True),
        (1, "c"): (2, 5.0, False), (1, "same"): (3, pytest.approx(11 / 3), False), (2, "new"): (0, None, False), (2, "next"): (1, 9.0, False),
    }

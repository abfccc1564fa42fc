"""Bucketed scans equal plain ordered scans, whatever the bucket width."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalloom.operators import ledger, logs, series
from evalloom.plans import scan

ROWS = st.lists(
    st.tuples(st.integers(0, 2), st.integers(-50, 50)), min_size=1, max_size=40
)
SLOW = settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, rows):
    pdf = pd.DataFrame(rows, columns=["key", "value"])
    pdf["seq"] = np.arange(len(pdf))
    return pdf, spark.createDataFrame(pdf)


@SLOW
@given(rows=ROWS, width=st.sampled_from([1, 3, 1000]))
def test_running(spark, rows, width):
    pdf, df = frame(spark, rows)
    out = scan.running(
        df, ["key"], ["seq"], F.expr(f"seq div {width}"),
        {"total": ("sum", "value"), "top": ("max", "value"), "low": ("min", "value")},
    )
    got = out.toPandas().sort_values("seq").reset_index(drop=True)
    by = pdf.groupby("key")["value"]
    assert (got["total"] == by.cumsum()).all()
    assert (got["top"] == by.cummax()).all()
    assert (got["low"] == by.cummin()).all()


@SLOW
@given(rows=ROWS, width=st.sampled_from([1, 4, 1000]))
def test_neighbour_and_rank(spark, rows, width):
    pdf, df = frame(spark, rows)
    bucket = F.expr(f"seq div {width}")
    back = scan.neighbour(df, ["key"], ["seq"], bucket, ["value"]).toPandas().sort_values("seq")
    ahead = scan.neighbour(df, ["key"], ["seq"], bucket, ["value"], prefix="next_", ahead=True).toPandas().sort_values("seq")
    ranked = scan.ranked(df, ["key"], ["seq"], bucket).toPandas().sort_values("seq")
    by = pdf.groupby("key")["value"]
    assert back["prev_value"].fillna(99).tolist() == by.shift(1).fillna(99).tolist()
    assert ahead["next_value"].fillna(99).tolist() == by.shift(-1).fillna(99).tolist()
    assert ranked["idx"].tolist() == pdf.groupby("key").cumcount().tolist()


@SLOW
@given(rows=ROWS, width=st.sampled_from([1, 7, 1000]))
def test_percentiles(spark, rows, width):
    pdf, df = frame(spark, rows)
    probs = {"p4": 0.04, "p50": 0.5, "p96": 0.96}
    got = scan.percentiles(df, ["key"], "value", probs, F.floor(F.col("value") / width)).toPandas().set_index("key")
    for key, values in pdf.groupby("key")["value"]:
        for name, p in probs.items():
            assert got.loc[key, name] == pytest.approx(np.percentile(values, p * 100))


@SLOW
@given(rows=ROWS, block=st.sampled_from([4, 9, 1000]))
def test_moving_mean(spark, rows, block):
    pdf, df = frame(spark, rows)
    got = scan.moving_mean(df, ["key"], ["seq"], F.lit(0), "value", 4, block=block).toPandas()
    for key, values in pdf.groupby("key")["value"]:
        want = np.convolve(np.pad(values.to_numpy(float), 4, mode="edge"), np.ones(9) / 9, mode="valid")
        assert got[got.key == key].sort_values("idx")["smooth"].tolist() == pytest.approx(want.tolist())


@pytest.mark.parametrize("width", [2, 5, 1000])
def test_streaks_reset_across_buckets(spark, width):
    flags = [1, 1, 0, 1, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "key int, seq int, f int")
    out = ledger.streaks(df, ["key"], "seq", F.expr(f"seq div {width}"), F.col("f") == 1, 3).orderBy("seq").collect()
    assert [r.streak for r in out] == [1, 2, 0, 1, 2, 3, 4, 0, 0, 1]
    assert [r.at_limit for r in out] == [s >= 3 for s in [1, 2, 0, 1, 2, 3, 4, 0, 0, 1]]


@pytest.mark.parametrize("width", [2, 1000])
def test_segments_and_clusters(spark, width):
    flags = [1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([(0, i, bool(f)) for i, f in enumerate(flags)], "key int, seq int, f boolean")
    runs = logs.run_segments(df, ["key"], ["seq"], F.col("f"), F.expr(f"seq div {width}"), 2).orderBy("first").collect()
    assert [(r["first"].seq, r["last"].seq, r.width) for r in runs] == [(0, 1, 2), (3, 5, 3)]
    xs = spark.createDataFrame([(0, x) for x in [1, 2, 4, 8, 9, 20]], "key int, x int")
    groups = series.gap_clusters(xs, ["key"], "x", 3, F.expr(f"x div {width}")).orderBy("cluster").collect()
    assert [(g.n, g.centre) for g in groups] == [(3, 7 / 3), (2, 8.5), (1, 20.0)]


def test_smooth_cycles_match_numpy(spark):
    t = np.arange(400)
    values = np.sin(t * 2 * np.pi / 80) * 10
    df = spark.createDataFrame([(0, int(i), float(x)) for i, x in enumerate(values)], "key int, seq int, v double")
    out = series.count_cycles(df, ["key"], ["seq"], "v", F.expr("seq div 50"), F.floor(F.col("smooth")), minimum_run=8).first()
    assert out.cycles == 5


def test_null_keys_form_a_sequence(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), (1, 1, 7), (None, 300, 1)], "k int, t int, x int")
    got = scan.running(rows, ["k"], ["t"], F.expr("t div 100"), {"total": ("sum", "x")}).collect()
    assert sorted((r.k or 0, r.t, r.total) for r in got) == [(0, 1, 5), (0, 2, 11), (0, 300, 12), (1, 1, 7)]
    near = scan.neighbour(rows, ["k"], ["t"], F.expr("t div 100"), ["x"]).collect()
    assert sorted((r.k or 0, r.t, r.prev_x) for r in near) == [(0, 1, None), (0, 2, 5), (0, 300, 6), (1, 1, None)]

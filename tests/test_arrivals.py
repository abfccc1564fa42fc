"""Stream folds give the same answer for the same rows in 1, 3 and 50 files, the last rows first."""

import pytest
from pyspark.sql import functions as F

from evalloom.streaming import archive as SA
from evalloom.streaming import ledger as SL
from evalloom.streaming import ordered as SO
from tests.test_archive import POLICY, SCHEMA, one_by_one, rows


def reversed_files(spark, path, data, schema, n):
    """``data`` dealt to ``n`` files in falling order; neighbouring rows of one episode fall into different files."""
    size = -(-len(data) // n)
    for at in reversed(range(0, len(data), size)):
        spark.createDataFrame(data[at : at + size], schema).coalesce(1).write.mode("append").parquet(path)
    return SL.file_stream(spark, path, spark.createDataFrame(data[:1], schema), files_per_batch=1 if n < 10 else 10)


@pytest.mark.parametrize("n", [1, 3, 50])
def test_archive_does_not_depend_on_files(spark, tmp_path, n):
    data = [(c, e // 2, i, *rest) for c, e, i, *rest in rows(seed=8)]
    want, _ = one_by_one(data)
    stream = reversed_files(spark, str(tmp_path / "in"), data, SCHEMA, n)
    closing, progress = SO.Closing(spark, stream, "episode"), []
    decided = SL.drain(SA.stream_archive(closing.after(stream), POLICY, lateness=1000), "append", name="t", closing=closing, progress=progress)
    assert {r.candidate_id: (r.reason, r.admitted, r.replaced) for r in decided.collect()} == want
    assert SO.late_rows(progress) == 0
    if n == 3:
        decided = SA.fold_arrivals(stream, POLICY)
        assert {r.candidate_id: (r.reason, r.admitted, r.replaced) for r in decided.collect()} == want


@pytest.mark.parametrize("n", [1, 3, 50])
def test_breaker_does_not_depend_on_files(spark, tmp_path, n):
    data = [(i % 7 if i % 3 else 1, i, (i * 7919) % 11 > 3, float((i * 31) % 13) + 0.25) for i in range(400)] + [(None, 400 + i, True, None) for i in range(5)]
    want = {}
    state = {}
    for key, seq, missed, cost in data:
        streak, used = state.get(key, (0, 0.0))
        state[key] = streak, used = streak + 1 if missed else 0, used + (cost or 0)
        if key not in want and (streak >= 5 or used >= 150):
            want[key] = (seq, "streak" if streak >= 5 else "cost")
    stream = reversed_files(spark, str(tmp_path / "in"), data, "key bigint, seq bigint, miss boolean, cost double", n)
    closing = SO.Closing(spark, stream, "seq")
    found = SL.circuit_breaker(closing.after(stream), "key", seq="seq", miss="miss", cost="cost", max_streak=5, max_cost=150.0, lateness=1000)
    got = SL.drain(found, "append", name="t", closing=closing)
    assert {r.key: (r.stopped_at, r.cause) for r in got.collect()} == want
    if n == 3:
        got = SL.break_arrivals(stream, "key", seq="seq", bucket=F.expr("seq div 64"), miss="miss", cost="cost", max_streak=5, max_cost=150.0)
        assert {r.key: (r.stopped_at, r.cause) for r in got.collect()} == want
    assert {c for _, c in want.values()} == {"streak", "cost"}


def test_decisions_come_while_the_stream_runs(spark, tmp_path):
    """Rows in order, a few places late at most: all but the last ones are decided before the stream is closed."""
    data = [(0, i, i % 5 != 0, 1.0) for i in range(60)] + [(1, i, False, 0.0) for i in range(60)]
    for part in range(6):
        spark.createDataFrame([r for r in data if r[1] // 10 == part], "key bigint, seq bigint, miss boolean, cost double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = SL.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame(data[:1], "key bigint, seq bigint, miss boolean, cost double"), files_per_batch=1)
    found = SL.circuit_breaker(stream, "key", seq="seq", miss="miss", cost="cost", max_streak=4, max_cost=1e9, lateness=5)
    got = SL.drain(found, "append", name="t").collect()
    assert [(r.key, r.stopped_at, r.cause) for r in got] == [(0, 4, "streak")] and got[0].batch < 5

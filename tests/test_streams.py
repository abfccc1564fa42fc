"""Streams over several micro-batches end where the batch form ends."""

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.operators import ledger as L
from evalloom.streaming import ledger as SL

SF = "/root/testdata/sf0.001"


def batches(spark, tmp_path, frame, n=3):
    path = str(tmp_path / "in")
    for part in range(n):
        frame.filter(F.col("event_id") % n == part).coalesce(1).write.mode("append").parquet(path)
    return SL.file_stream(spark, path, frame, files_per_batch=1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_status(spark, tmp_path):
    ledger = v.v_ledger(spark, SF)
    updates = SL.drain(SL.latest_status(batches(spark, tmp_path, ledger)), "update", name="t")
    assert updates.select("batch").distinct().count() == 3
    assert rows(SL.latest(updates, ["sample_key"])) == rows(L.latest_status(ledger, ["sample_key"]))


def test_unique_events_and_open_attempts(spark, tmp_path):
    ledger = v.v_ledger(spark, SF)
    stream = batches(spark, tmp_path, ledger)
    once = SL.drain(SL.unique_events(stream.select("attempt_id"), "attempt_id"), "append", name="t")
    assert rows(once.select("attempt_id")) == rows(ledger.select("attempt_id").distinct())
    updates = SL.drain(SL.open_attempts(stream, "attempt_id"), "update", name="t")
    still = SL.latest(updates, ["attempt_id"]).filter("open").select("attempt_id")
    started = ledger.filter("status = 'attempt_started'").select("attempt_id").distinct()
    closed = ledger.filter("status IN ('scored', 'unparseable')").select("attempt_id")
    assert rows(still) == rows(started.join(closed, "attempt_id", "left_anti"))


def test_attempts_as_keyed_state(spark, tmp_path):
    kind = "attempt_id bigint, status string, seq bigint"
    data = [(i % 9, ("attempt_started", "api_error", "scored")[(i * 7) % 5 % 3], i) for i in range(45)]
    for part in range(3):
        spark.createDataFrame([r for r in data if r[2] % 3 == part], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = SL.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind), files_per_batch=1)
    kept = SL.latest(SL.drain(SL.kept_attempts(stream, "attempt_id", keep=100, lateness=100), "update", name="t"), ["attempt_id"])
    want = {k: (any(s == "attempt_started" for j, s, _ in data if j == k) and not any(s == "scored" for j, s, _ in data if j == k), max(q for j, _, q in data if j == k)) for k in range(9)}
    assert {r.attempt_id: (r.open, r.last_seq) for r in kept.collect()} == want


def test_closed_attempts_are_forgotten(spark, tmp_path):
    kind = "attempt_id bigint, status string, seq bigint"
    parts = [[(1, "attempt_started", 1), (1, "scored", 2), (2, "attempt_started", 3)], [(3, "api_error", 500)], [(3, "api_error", 501)], [(1, "attempt_started", 502), (2, "api_error", 503)]]
    for rows_ in parts:
        spark.createDataFrame(rows_, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = SL.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind), files_per_batch=1)
    last = {}
    for keep in (10, 10_000):
        got = SL.latest(SL.drain(SL.kept_attempts(stream, "attempt_id", keep=keep, lateness=10), "update", name="t"), ["attempt_id"])
        last[keep] = {r.attempt_id: r.open for r in got.collect()}
    assert last == {10: {1: True, 2: True, 3: False}, 10_000: {1: False, 2: True, 3: False}}

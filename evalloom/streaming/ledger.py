"""Ledgers as streams: the same folds kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evalloom.plans import scan
from evalloom.session import shared_folder
from evalloom.streaming.ordered import ZERO, Closing, fold_in_order

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("scored", "unparseable", "refused")


def file_stream(spark: SparkSession, path: str, like: DataFrame, *, files_per_batch: int = 1000) -> DataFrame:
    """Stream over parquet files, or one file, with the schema of a batch frame.

    The source only lists folders; as a pattern that matches just this name, a
    single file works as well.
    """
    name = path.rstrip("/")
    pattern = f"{name[:-1]}[{name[-1]}]"
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def drain(stream: DataFrame, mode: str, *, name: str, closing: Closing | None = None, progress: list | None = None) -> DataFrame:
    """Run a stream over all available input and return what it wrote, with the batch number.

    Every micro-batch replaces its own folder, so a batch that is run again after
    a failure leaves one copy.  State lives in RocksDB and in the checkpoint.  With
    ``closing`` the stream is then ended from the same checkpoint, so that rows that
    still wait are decided; ``progress`` collects the reports of the micro-batches.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out, checkpoint = shared_folder(spark, f"{name}-out"), shared_folder(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run() -> bool:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
        if progress is not None:
            progress.extend(query.recentProgress)
        return query.lastProgress is not None

    ran = run()
    if closing is not None:
        closing.close()
        ran = run() or ran
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    if not ran:
        return spark.createDataFrame([], f"{fields}, batch int")
    return spark.read.schema(f"{fields}, batch int").parquet(out)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update stream."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    picked = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def latest_status(events: DataFrame, key: str = "sample_key", seq: str = "seq") -> DataFrame:
    """Last status per sample in ledger order, whatever order the events arrive in."""
    return events.groupBy(key).agg(F.max_by("status", seq).alias("status"))


def unique_events(events: DataFrame, ident: str, *, within: str | None = None, at: str | None = None) -> DataFrame:
    """Ids seen for the first time; with ``within`` an id is remembered for that long after its time ``at``."""
    if within is None:
        return events.dropDuplicates([ident])
    if at is None:
        raise ValueError("a bound needs the name of the time column")
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([ident])


def open_attempts(events: DataFrame, key: str) -> DataFrame:
    """Attempts with a start and no terminal event yet.

    Two flags per attempt are all the state, so a built-in aggregation keeps it.
    """
    started = F.bool_or(F.col("status") == "attempt_started")
    finished = F.bool_or(F.col("status").isin(*TERMINAL))
    return events.groupBy(key).agg((started & ~finished).alias("open"), F.max("seq").alias("last_seq"))


class _Attempts(StatefulProcessor):
    """Two flags and the last event of an attempt; a closed attempt is forgotten once the stream is ``keep`` places on."""

    def __init__(self, key: str, keep: int):
        self.key, self.keep = key, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "started boolean, finished boolean, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started, finished, last = self.known.get() or (False, False, None)
        for frame in rows:
            started = started or bool((frame["status"] == "attempt_started").any())
            finished = finished or bool(frame["status"].isin(TERMINAL).any())
            newest = int(frame["place"].max())
            last = newest if last is None else max(last, newest)
        self.known.update((started, finished, last))
        if finished:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + ZERO + self.keep)
        yield pd.DataFrame({self.key: [key[0]], "open": [started and not finished], "last_seq": pd.array([last], "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def kept_attempts(events: DataFrame, key: str, *, keep: int, lateness: int) -> DataFrame:
    """:func:`open_attempts` whose state forgets a closed attempt when the newest event is ``keep + lateness`` places after its last one.

    Open attempts are kept for ever; a later event of an attempt that was forgotten
    starts it anew.  State is read for each attempt from Python, so this form is for
    ledgers that never end; a bounded one is cheaper by :func:`open_attempts`.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), "status", F.col("seq").cast("bigint").alias("place")).filter("place IS NOT NULL")
    rows = rows.withColumn("at", F.timestamp_millis(F.col("place") + ZERO)).withWatermark("at", f"{lateness} milliseconds")
    return rows.groupBy("key").transformWithStateInPandas(_Attempts(key, keep), f"{key} {kind}, open boolean, last_seq bigint", "Update", "EventTime")


def circuit_breaker(
    events: DataFrame, key: str, *, seq: str, miss: str, cost: str, max_streak: int, max_cost: float, lateness: int
) -> DataFrame:
    """One row per key at the event where its streak of misses or its spend reaches the limit, as soon as it is known.

    Events are folded in the order of ``seq`` once the newest event is ``lateness`` ahead,
    whatever files and micro-batches they came in.  An unknown outcome is no miss and an
    unknown cost is 0.
    """
    kind = events.schema[key].dataType.simpleString()
    unit = 10**6

    def step(state: dict, place: int, row: dict) -> list[tuple]:
        state["streak"] = state["streak"] + 1 if row[miss] else 0
        state["used"] += round((row[cost] or 0) * unit)
        if state["stopped"] or (state["streak"] < max_streak and state["used"] < max_cost * unit):
            return []
        state["stopped"] = True
        return [(place, "streak" if state["streak"] >= max_streak else "cost")]

    return fold_in_order(
        events, key, seq, [], [miss, cost], f"{key} {kind}, stopped_at bigint, cause string", lateness=lateness,
        begin=lambda: {"streak": 0, "used": 0, "stopped": False}, step=step,
    )


def break_arrivals(
    events: DataFrame, key: str, *, seq: str, bucket: str | Column, miss: str, cost: str, max_streak: int, max_cost: float, name: str = "breaker"
) -> DataFrame:
    """:func:`circuit_breaker` as a table: for keys of which one holds more events than a task should fold.

    Micro-batches are appended to a table; once the input is drained, bucketed scans
    over it give streaks and spend, so no task holds all rows of a key.
    """
    unit = 10**6
    rows = drain(events.select(key, seq, miss, cost), "append", name=name)
    spent = scan.running(rows, [key], [seq], bucket, {"used": ("sum", F.round(F.col(cost) * unit).cast("bigint"))})
    counted = scan.streak_lengths(spent, [key], [seq], bucket, F.coalesce(F.col(miss), F.lit(False)), "streak")
    streak = F.col("streak") >= max_streak
    cause = F.when(streak, "streak").otherwise("cost")
    stopped = counted.filter(streak | (F.col("used") >= int(max_cost * unit)))
    return stopped.groupBy(key).agg(F.min(seq).alias("stopped_at"), F.min_by(cause, seq).alias("cause"))

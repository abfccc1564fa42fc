"""Ordered folds over streams, as keyed state that Spark keeps.

A row waits in the state of its key until the watermark has passed its place; then
the rows that are due are folded in their order.  So decisions come while the stream
runs, they do not depend on files or micro-batches, and what is kept for a key is
the fold's own state and the rows of the last ``lateness`` places.  A row that comes
later than that is left out; Spark counts these (:func:`late_rows`).

Places are whole numbers (an episode, a sequence number) and count as milliseconds
for the watermark; a row without a place is left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from evalloom.session import shared_folder

#: places lie between -ZERO and ZERO, and count from ZERO as a time, since the first watermark is 0
ZERO = 1 << 42
#: a place after all others (times end in 2262); rows there only move the watermark
CLOSE = ZERO


class _Fold(StatefulProcessor):
    """Holds rows back until they are due and folds them in the order of (place, tie)."""

    def __init__(self, names: list[str], kinds: str, ties: list[str], begin, step, columns: list[str], integers: list[str]):
        self.names, self.kinds, self.ties, self.begin, self.step, self.columns, self.integers = names, kinds, ties, begin, step, columns, integers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.state = handle.getValueState("state", "packed string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[frame["place"] < CLOSE]
            if len(frame):
                self.waiting.appendList([tuple(_plain(v) for v in row) for row in frame.iloc[:, 1:-1].itertuples(index=False)])
                least = int(frame["place"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame(columns=self.columns)

    def _wake(self, place: int) -> None:
        """One timer a key, at its first waiting row."""
        timers = list(self.handle.listTimers())
        if not timers or min(timers) > place + ZERO:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(place + ZERO)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for row in self.waiting.get():
            (due if row[-1] + ZERO <= now else later).append(tuple(row))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(row[-1] for row in later) + ZERO)
        else:
            self.waiting.clear()
        held = self.state.get()
        state = self.begin() if held is None else json.loads(held[0])
        out = []
        named = [(row[-1], dict(zip(self.names, row[:-1], strict=True))) for row in due]
        for place, row in sorted(named, key=lambda x: (x[0], *[(x[1][c] is not None, x[1][c]) for c in self.ties])):
            out += [(*key, *decided) for decided in self.step(state, place, row)]
        self.state.update((json.dumps(state),))
        frame = pd.DataFrame(out, columns=self.columns)
        for name in self.integers:
            frame[name] = frame[name].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def _plain(value):
    """A value as state rows take it."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float) and value != value:
        return None
    return value


def fold_in_order(
    stream: DataFrame, key: str, place: str, ties: list[str], columns: list[str], out: str, *, lateness: int,
    begin: Callable[[], object], step: Callable[[object, dict], list[tuple]],
) -> DataFrame:
    """Rows of ``out`` (the key first) that ``step(state, place, row)`` gives for the rows of each key in order of ``place`` and ``ties``.

    ``step`` changes the state in place; the state is kept as JSON.
    """
    names = list(dict.fromkeys([*ties, *columns]))
    # state rows take plain names only
    rows = stream.select(F.col(key).alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(place).cast("bigint").alias("place"))
    rows = rows.filter("place IS NOT NULL").withColumn("at", F.timestamp_millis(F.col("place") + ZERO)).withWatermark("at", f"{lateness} milliseconds")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("key", "at"))
    wanted = StructType.fromDDL(out)
    integers = [f.name for f in wanted.fields if f.dataType.simpleString() in ("bigint", "int")]
    fold = _Fold(names, kinds, ties, begin, step, wanted.names, integers)
    return rows.groupBy("key").transformWithStateInPandas(fold, wanted, "Append", "EventTime")


class Closing:
    """Rows that end a stream, in a folder of their own: they come once :meth:`close` is called."""

    def __init__(self, spark: SparkSession, like: DataFrame, place: str):
        self.spark, self.place, self.schema = spark, place, like.schema
        self.folder = shared_folder(spark, "closing")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def after(self, stream: DataFrame) -> DataFrame:
        return stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def close(self) -> None:
        end = self.spark.range(1).select(*[(F.lit(CLOSE) if f.name == self.place else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        end.write.mode("append").parquet(self.folder)


def late_rows(progress: list) -> int:
    """Rows that came behind the watermark and were left out."""
    return sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators)

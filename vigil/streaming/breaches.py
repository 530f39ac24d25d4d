"""Runs of consecutive breaches, counted in event-time order.

Rows wait in the state of their key until the watermark has passed them, so a
run does not depend on the batch in which a row arrives.  What a key keeps is
its streak, the time of its last counted row, and the rows inside the
watermark's delay; a key that is silent for longer than ``ttl`` loses all of
it, which changes no result because a silence that long ends a streak anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil.functions.core import instant_to_ntz

#: State kept as files and deltas, with timers; needed by the processor below.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class BreachRuns(StatefulProcessor):
    """``transformWithStateInPandas`` processor: input columns (key, ``us_``
    event time in microseconds, ``bad_``), output (key, ``us_``, streak) for
    the rows at which a streak is at least ``least``."""

    def __init__(self, key: str, least: int, ttl_seconds: int) -> None:
        self.key, self.least, self.ttl = key, least, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, bad boolean")
        self.run = handle.getValueState("run", "streak long, last long, watermark long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList(list(zip(part["us_"].tolist(), part["bad_"].tolist())))
            self.handle.registerTimer(_millis(int(part["us_"].min())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        streak, last, seen = self.run.get() if self.run.exists() else (0, None, None)
        if seen == now:
            return  # an earlier timer of this batch has counted all that is due
        due, later = [], []
        for us, bad in self.waiting.get():
            (due if _millis(us) <= now else later).append((us, bad))
        found = []
        for us, bad in sorted(due):  # rows of one instant: those in order first
            if last is not None and us - last > self.ttl:
                streak = 0
            streak, last = (streak + 1 if bad else 0), us
            if streak >= self.least:
                found.append((us, streak))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(_millis(min(us for us, _ in later)))
        else:
            self.waiting.clear()
        silent_at = None if last is None else _millis(last + self.ttl) + 1
        if not later and (silent_at is None or silent_at <= now):
            self.run.clear()
        else:
            self.run.update((streak, last, now))
            if silent_at is not None:
                self.handle.registerTimer(max(silent_at, now + 1))
        if found:
            yield pd.DataFrame({self.key: [key[0]] * len(found), "us_": [u for u, _ in found], "streak": [s for _, s in found]})


def consecutive_breaches(series: DataFrame, key: str, ts: str, breach: str, n: int = 3, delay: str = "10 minutes",
                         ttl_seconds: int = 7 * 86400) -> DataFrame:
    """(key, ts, streak) of the rows at which a key's run of consecutive
    breaches reaches ``n`` or more, in order of their time ``ts`` (an
    instant; the result is naive UTC).

    A row without a breach (or a null one) ends the run, and so does a silence
    of more than ``ttl_seconds``; among rows of one instant those without a
    breach count first.  Rows are counted once the watermark (``delay`` behind
    the latest row) has passed them; later rows of that time are dropped.  Run
    with the settings of :data:`ROCKSDB`."""
    out = T.StructType([T.StructField(key, series.schema[key].dataType), T.StructField("us_", T.LongType()), T.StructField("streak", T.LongType())])
    rows = series.withWatermark(ts, delay).select(
        F.col(key), F.col(ts), F.unix_micros(ts).alias("us_"), F.coalesce(F.col(breach), F.lit(False)).alias("bad_"))
    found = rows.groupBy(key).transformWithStateInPandas(
        BreachRuns(key, n, ttl_seconds), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.select(key, instant_to_ntz(F.timestamp_micros("us_")).alias("ts"), "streak")

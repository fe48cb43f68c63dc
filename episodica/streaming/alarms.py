"""Alarms for runs that fall silent, as a stream with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from episodica.shipping import ship_package

ALARM = "run string, last timestamp, silent_s double"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SilenceAlarm(StatefulProcessor):
    """State of a run: the time of its last row. A timer stands `seconds` after it, and a new row puts it off."""

    def __init__(self, seconds: float, event_time: bool):
        self.ms, self.event_time = int(seconds * 1000), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["ms"].max()) for pdf in rows)
        known = self.last.get() if self.last.exists() else None
        if known is not None:
            newest = max(newest, known[0])
            self.handle.deleteTimer(known[1])
        due = (newest if self.event_time else timerValues.getCurrentProcessingTimeInMs()) + self.ms
        self.handle.registerTimer(due)
        self.last.update((newest, due))
        yield pd.DataFrame({"run": pd.Series([], dtype=object), "last": pd.Series([], dtype="datetime64[ns]"), "silent_s": pd.Series([], dtype=float)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, due = self.last.get()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        yield pd.DataFrame({"run": [key[0]], "last": pd.to_datetime([ms], unit="ms"), "silent_s": [max(now, due) / 1000 - (due - self.ms) / 1000]})

    def close(self) -> None:
        pass


def silence_alarms(log: DataFrame, run: str, ts: str, seconds: float = 900, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """run, last (the time of its last row) and silent_s: a row each time a run has had no row for `seconds`, at most one for each silence.

    By the clock of the machine (processing time), or by that of the log (event_time): how far the watermark, `late` behind the newest row of
    all runs, has come. State and timers are in the checkpoint, so alarms that are due while the query is down come when it runs again. The
    session needs the state store that PROVIDER names. Rows without a run or a time say nothing.
    """
    ship_package(log.sparkSession)
    rows = log.filter(F.col(run).isNotNull() & F.col(ts).isNotNull()).select(F.col(run).cast("string").alias("run"), F.col(ts).cast("timestamp").alias("at"))
    rows = rows.withColumn("ms", F.unix_millis("at"))
    mode = "EventTime" if event_time else "ProcessingTime"
    if event_time:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("run").transformWithStateInPandas(SilenceAlarm(seconds, event_time), ALARM, "append", mode)

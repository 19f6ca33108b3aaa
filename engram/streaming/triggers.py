"""Quiet periods and least intervals between firings, for every key, on event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIRED = "key string, fired timestamp, changes long"
_STATE = "last long, before long, changes long"


def due(last: int, before: int, quiet: int, interval: int) -> int:
    """When a key whose last change and last firing these are is to fire; all in milliseconds. before: -1 for none."""
    return last + quiet if before < 0 else max(last + quiet, before + interval)


class Debounce(StatefulProcessor):
    """Changes of a key are gathered until none has come for a quiet period, then it fires once; and never again before the
    least interval has passed. State is three numbers a key, a timer stands for what is pending."""

    def __init__(self, quiet: int, interval: int):
        self.quiet, self.interval = quiet, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _STATE)

    def read(self) -> tuple[int, int, int]:
        """(last change, last firing, pending changes)"""
        return tuple(int(x) for x in self.state.get()) if self.state.exists() else (-1, -1, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, before, changes = self.read()
        if changes:
            self.handle.deleteTimer(due(last, before, self.quiet, self.interval))
        fired = []
        for at in sorted(int(t) for part in rows for t in part["at"]):
            # What was due before this change has fired by then, whatever batch the changes come in.
            if changes and (then := due(last, before, self.quiet, self.interval)) <= at:
                fired.append((key[0], pd.Timestamp(then, unit="ms"), changes))
                before, changes = then, 0
            last, changes = max(last, at), changes + 1
        self.state.update((last, before, changes))
        if changes:
            self.handle.registerTimer(due(last, before, self.quiet, self.interval))
        yield pd.DataFrame(fired, columns=["key", "fired", "changes"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, before, changes = self.read()
        then = expiredTimerInfo.getExpiryTimeInMs()
        if not changes:
            return
        self.state.update((last, then, 0))
        yield pd.DataFrame([(key[0], pd.Timestamp(then, unit="ms"), changes)], columns=["key", "fired", "changes"])

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, quiet: int, interval: int, late: str = "0 seconds") -> DataFrame:
    """(key, fired, changes) of a stream of changes (key, ts): one firing a quiet period, none closer than the interval.

    quiet and interval are in milliseconds. A firing is known once the watermark, which is `late` behind the latest
    change, has passed it; changes older than the watermark are dropped. Needs the RocksDB state store.
    """
    spark = changes.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = changes.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Debounce(quiet, interval), outputStructType=FIRED, outputMode="append", timeMode="eventTime")

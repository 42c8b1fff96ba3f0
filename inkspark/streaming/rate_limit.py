"""Requests in fixed windows by key, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkspark.operators.ordering import numbered

LIMIT, SECONDS = 60, 60


def _window(moment: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(moment).cast("timestamp")) / (seconds * 1_000_000))


def limited(rows: DataFrame, key: str, moment: str, tie: str, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """Each request's number within its window (n), and whether it is over the limit.

    Positions in the order of key, moment and tie come from stored ranges, and a
    request's number is its position less that of its window's first one, which is
    an aggregate. So a key under attack is spread over many tasks. Moments and
    ties must tell a key's requests apart, or equal ones are numbered in any order.
    """
    placed = numbered(rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("key"), F.col(moment).alias("moment"), F.col(tie).alias("tie"), _window(moment, seconds).alias("window")), ["key", "moment", "tie"])
    firsts = placed.groupBy("key", "window").agg(F.min("position").alias("first")).withColumnsRenamed({"key": "key2", "window": "window2"})
    same = F.col("key").eqNullSafe(F.col("key2")) & F.col("window").eqNullSafe(F.col("window2"))
    n = F.col("position") - F.col("first") + 1
    return placed.join(firsts, same).select("row.*", n.alias("n"), (n > limit).alias("refused"))


def counts(rows: DataFrame, key: str, moment: str, seconds: int = SECONDS) -> DataFrame:
    """Requests by key and window; on a stream, give the rows a watermark first."""
    window = F.window(F.col(moment).cast("timestamp"), f"{seconds} seconds")
    return rows.groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), "n")


def watermarked(rows: DataFrame, moment: str, delay: str = "1 minute") -> DataFrame:
    return rows.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, delay)


class Limiter(StatefulProcessor):
    """Counts of one key's requests, by window; a timer drops each window's count when the watermark passes its end."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "window long", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            windows = batch.iloc[:, 1].astype("datetime64[us]").astype("int64") // (self.seconds * 1_000_000)
            before = {int(w): self._known(int(w)) for w in windows.unique()}
            n = windows.map(before) + windows.groupby(windows).cumcount() + 1
            for w, last in n.groupby(windows).max().items():
                self.counts.updateValue((int(w),), (int(last),))
            yield batch.assign(n=n, refused=n > self.limit)

    def _known(self, window: int) -> int:
        """A window's count so far. A new window gets a timer at its end."""
        if self.counts.containsKey((window,)):
            return self.counts.getValue((window,))[0]
        self.handle.registerTimer((window + 1) * self.seconds * 1000)
        return 0

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ended = expiredTimerInfo.getExpiryTimeInMs() // (1000 * self.seconds) - 1
        if self.counts.containsKey((ended,)):
            self.counts.removeKey((ended,))
        return iter(())

    def close(self) -> None:
        pass


#: What the stream needs of a session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def limited_stream(rows: DataFrame, key: str, moment: str, limit: int = LIMIT, seconds: int = SECONDS, delay: str = "1 minute") -> DataFrame:
    """A stream's requests in order of arrival, each with its number in its own window, and whether that is over the limit.

    rows: key (string), moment (timestamp). Gives key, moment, n and refused. A
    late request counts in its own window and leaves others alone; one that comes
    after its window's end and the delay is dropped by the watermark. State is a
    count for each key and open window, in the state store of ``STATE_STORE``, so a
    restart from the checkpoint goes on counting. The session's time zone must be
    UTC.
    """
    for name, value in STATE_STORE.items():
        rows.sparkSession.conf.set(name, value)
    timed = rows.select(F.col(key).alias(key), F.col(moment).alias(moment)).withWatermark(moment, delay)
    schema = f"{key} string, {moment} timestamp, n long, refused boolean"
    return timed.groupBy(key).transformWithStateInPandas(Limiter(limit, seconds), schema, "append", "EventTime")

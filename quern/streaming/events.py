"""Streams over events (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; timestamps without a zone are read as the session's, which watermarks need."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def daily_counts(events: DataFrame, types: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events of the given types a day. As a stream, a day closes when the watermark has passed it."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.where(F.col("event_type").isin(*types)).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


def without_repeats(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first event of each key; as a stream within the watermark, so state stays bounded."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


#: Where transformWithState keeps its state.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class DailyQuota(StatefulProcessor):
    """Per key a map from day to count, and a timer at the end of its first day: when the watermark passes it, the days that have ended go.
    Each call of the state is a message, so a batch reads a key's map at once and writes each day of its rows once."""

    def __init__(self, key: str, ts: str, limit: int):
        self.key, self.ts, self.limit = key, ts, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([r[self.ts].to_numpy() for r in rows]))
        # whole milliseconds since 1970 in the session's zone, in which the frame's times are
        found, start, more = np.unique(times.astype("datetime64[ms]").astype("int64") // DAY_MS, return_index=True, return_counts=True)
        held = {day[0]: n[0] for day, n in self.days.iterator()}
        if not held or found[0] < min(held):
            self.handle.registerTimer((int(found[0]) + 1) * DAY_MS)
        before = np.array([held.get(day, 0) for day in found.tolist()], np.int64)
        n = np.arange(1, len(times) + 1) + np.repeat(before - start, more)
        for day, k in zip(found.tolist(), (before + more).tolist()):
            self.days.updateValue((day,), (k,))
        yield pd.DataFrame({self.key: [key[0]] * len(times), self.ts: times, "n": n, "allowed": n <= self.limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [day[0] for day, _ in self.days.iterator()]
        left = [day for day in held if (day + 1) * DAY_MS > expiredTimerInfo.getExpiryTimeInMs()]
        for day in set(held) - set(left):
            self.days.removeKey((day,))
        if left:
            self.handle.registerTimer((min(left) + 1) * DAY_MS)
        return iter(())

    def close(self) -> None:
        pass


def running_quota(events: DataFrame, key: str, limit: int, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(key, ts, n, allowed) for each event of a stream: its number on its day, in order of arrival and, within a batch, of time,
    and whether the day's limit allows it. A late event counts on its own day as long as the watermark lets it in; behind the
    watermark a day's count leaves the state, and with the last one the key does. Days are the session's zone's, which must be UTC, as timers
    are. Needs a session whose spark.sql.streaming.stateStore.providerClass is STATE_STORE; rows without a key or a time are left out."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.select(key, ts).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    return timed.groupBy(key).transformWithStateInPandas(DailyQuota(key, ts, limit), f"{key} {kind}, {ts} timestamp, n long, allowed boolean", "Append", "EventTime")


def recent(events: DataFrame, key: str, ts: str = "ts", order: str = "event_id", n: int = 5) -> DataFrame:
    """The newest n events of each key, newest first, with their place."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(order))
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)

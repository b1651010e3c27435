"""Circuit breakers of providers as a stream with state and timers: closed, open until a time, then half open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a key that are made into a frame at a time; of the others a worker holds three numbers.
ROWS = 20_000
SCHEMA = "key string, id long, ms long, state string, streak long, until_ms long"


class Breaker(StatefulProcessor):
    """State of a key: the failure streak and the time (ms) until which the breaker is open."""

    def __init__(self, most: int, cooldown_ms: int, event_time: bool):
        self.most, self.cooldown, self.event_time = most, cooldown_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "streak long, until long")

    def _rows(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(rows, columns=["key", "id", "ms", "state", "streak", "until_ms"])
        yield frame.astype({"id": "Int64", "until_ms": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        streak, until = self.state.get() if self.state.exists() else (0, 0)
        parts = [tuple(frame[c].to_numpy(copy=True) for c in ("ms", "id", "failed")) for frame in rows]
        ms, ids, bad = (np.concatenate(column) for column in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, ms))
        for start in range(0, len(order), ROWS):
            part, out = order[start : start + ROWS], []
            for i, at, failed in zip(ids[part].tolist(), ms[part].tolist(), bad[part].tolist(), strict=True):
                now = at if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                if until > now:  # open: what comes is refused and counts for nothing
                    state = "refused"
                elif failed:
                    streak += 1
                    state = "closed"
                    if streak >= self.most:
                        until, state = now + self.cooldown, "open"
                        self.handle.registerTimer(until)
                else:
                    streak, until, state = 0, 0, "closed"
                out.append((key[0], i, at, state, streak, until or None))
            yield from self._rows(out)
        self.state.update((streak, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        streak, until = self.state.get() if self.state.exists() else (0, 0)
        at = expiredTimerInfo.getExpiryTimeInMs()
        # the streak stays: one more failure opens the breaker again, one success closes it for good
        return self._rows([(key[0], None, at, "half_open", streak, until)] if until == at else [])

    def close(self) -> None:
        pass


def breakers(events: DataFrame, most: int = 3, cooldown: float = 60.0, late: str | None = None) -> DataFrame:
    """[T03, T10] Every attempt with the state of its key's breaker after it, and a row (without id) when time half opens one.

    events: key, id, ts, failed. With ``late`` time is the events' own, behind a watermark so late; else the clock's, and
    breakers half open without any event.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = (events.withWatermark("ts", late) if late else events).withColumn("ms", F.unix_millis("ts"))  # whatever the session's time zone
    mode = "EventTime" if late else "ProcessingTime"
    processor = Breaker(most, int(cooldown * 1000), late is not None)
    out = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=SCHEMA, outputMode="Append", timeMode=mode)
    return out.select("key", "id", F.timestamp_millis("ms").alias("ts"), "state", "streak", F.timestamp_millis("until_ms").alias("open_until"))

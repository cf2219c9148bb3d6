"""Hit counters by user that expire: an extension, as the batch engine has no streams of its own.

A counter holds the hits of a user until the user has been idle for some time; then it is given out and its state goes, so that state
grows with the active users only. It has two state variables and one event-time timer. ``expired`` is the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "user_id long, hits long, since timestamp, until timestamp, expired boolean"


def _counters(idle_seconds: int) -> StatefulProcessor:
    idle = pd.Timedelta(seconds=idle_seconds)

    class Counters(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.hits = handle.getValueState("hits", "hits long")
            self.times = handle.getValueState("times", "since timestamp, until timestamp")

        def _row(self, key: tuple, hits: int, since, until, expired: bool) -> pd.DataFrame:
            return pd.DataFrame({"user_id": [key[0]], "hits": [hits], "since": [since], "until": [until], "expired": [expired]})

        def _timer(self, until, wanted: bool) -> None:
            at = int((until + idle).timestamp() * 1000) + 1  # the last moment at which a hit still counts is over
            (self.handle.registerTimer if wanted else self.handle.deleteTimer)(at)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            times = sorted(pd.Timestamp(t) for part in rows for t in part["ts"])
            hits, since, until = 0, None, None
            if self.hits.exists():
                hits, (since, until) = self.hits.get()[0], map(pd.Timestamp, self.times.get())
                self._timer(until, False)
            for t in times:
                if hits and t - until > idle:
                    yield self._row(key, hits, since, until, True)
                    hits = 0
                since, until, hits = (min(since, t), max(until, t), hits + 1) if hits else (t, t, 1)
            self.hits.update((hits,))
            self.times.update((since.to_pydatetime(), until.to_pydatetime()))
            self._timer(until, True)
            yield self._row(key, hits, since, until, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.hits.exists():
                since, until = map(pd.Timestamp, self.times.get())
                yield self._row(key, self.hits.get()[0], since, until, True)
                self.hits.clear()
                self.times.clear()

        def close(self) -> None:
            pass

    return Counters()


def counters(events: DataFrame, idle_seconds: int, late_seconds: int) -> DataFrame:
    """(user_id, hits, since, until, expired) of a stream (user_id, ts): after each batch the counters it touched, and those that expired.

    Hits may be late by less than ``late_seconds``, which must be less than ``idle_seconds``: so a late hit never stands alone before
    the counter that is open. Needs the RocksDB state store.
    """
    if late_seconds >= idle_seconds:
        raise ValueError("hits must not be later than counters live idle")
    rows = events.select("user_id", "ts").withWatermark("ts", f"{late_seconds} seconds")
    return rows.groupBy("user_id").transformWithStateInPandas(_counters(idle_seconds), _OUT, "Update", "eventtime")


def expired(events: DataFrame, idle_seconds: int, upto: str) -> DataFrame:
    """(user_id, hits, since, until) of the counters that have been idle long enough at a time: the batch form."""
    order = Window.partitionBy("user_id").orderBy("ts")
    at, idle = F.unix_micros("ts"), idle_seconds * 1_000_000
    gap = at - F.lag(at).over(order)
    fresh = F.when(gap.isNull() | (gap > idle), 1).otherwise(0)
    running = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.select("user_id", "ts").withColumn("_new", fresh).withColumn("_n", F.sum("_new").over(running))
    held = numbered.groupBy("user_id", "_n").agg(F.count("*").alias("hits"), F.min("ts").alias("since"), F.max("ts").alias("until"))
    return held.where(F.unix_micros("until") + idle < F.unix_micros(F.lit(upto).cast("timestamp"))).select("user_id", "hits", "since", "until")

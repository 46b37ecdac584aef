"""Keyed state over a stream of readings: silence against the network's clock, and sliding sums of each row.

The network's clock is the stream's watermark: the latest time of any station's reading, less the
lateness. Timers of event time fire when it passes, so that a station that says nothing is judged
because others speak. State is in RocksDB, which Spark's arbitrary state needs:
``spark.sql.streaming.stateStore.providerClass`` must name it (see ``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugewright.functions.stats import HOUR
from gaugewright.params import DEFAULTS, Params

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keyed operators need, unless the session names one."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, _PROVIDER)


def _us(ts) -> int:
    return pd.Timestamp(ts).value // 1000


class _Silence(StatefulProcessor):
    """State of a series: its last time and whether its silence was told."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, silent boolean")

    def _due(self, last_us: int) -> int:
        """The first whole millisecond at which the limit has passed."""
        return -(-(last_us + self.limit_us) // 1000)

    def _verdict(self, key, verdict: str, last_us: int, at_us: int) -> pd.DataFrame:
        return pd.DataFrame({"station": [key[0]], "sensor": [key[1]], "verdict": [verdict], "last_ts": [pd.Timestamp(last_us, unit="us")], "at": [pd.Timestamp(at_us, unit="us")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last_us, silent = self.last.get() if self.last.exists() else (None, False)
        times = sorted({_us(t) for part in rows for t in part["ts"]})
        times = [t for t in times if last_us is None or t > last_us]  # what is late or sent again is nothing new
        if not times:
            return
        if last_us is not None and not silent:
            self.handle.deleteTimer(self._due(last_us))
        for t in times:
            if last_us is not None and t - last_us >= self.limit_us:
                if not silent:  # the limit was passed between two readings of one batch
                    yield self._verdict(key, "silent", last_us, last_us + self.limit_us)
                yield self._verdict(key, "returned", last_us, t)
            last_us, silent = t, False
        self.last.update((last_us, False))
        self.handle.registerTimer(self._due(last_us))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last_us, silent = self.last.get()
        if not silent and self._due(last_us) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.update((last_us, True))
            yield self._verdict(key, "silent", last_us, last_us + self.limit_us)

    def close(self) -> None:
        pass


def silence(stream: DataFrame, params: Params = DEFAULTS, late: str = "10 minutes") -> DataFrame:
    """A verdict when a series passes the limit of silence, and one when it returns: station, sensor, verdict, last_ts, at. (STR-silence, L3)

    ``verdict`` is ``silent`` or ``returned``; ``at`` is the time at which the limit was passed, or the
    first reading after it. A silence is told once, whether it ends in a later batch or in the one
    that brings the clock forward; readings that are late or come again change nothing. The limit is
    that of the silence rule.
    """
    use_rocksdb(stream.sparkSession)
    rows = stream.where("ts is not null").select("station", "sensor", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    schema = "station string, sensor string, verdict string, last_ts timestamp, at timestamp"
    return rows.groupBy("station", "sensor").transformWithStateInPandas(_Silence(int(params.silence_h * HOUR)), schema, "Append", "EventTime")


def frame_sums(us: np.ndarray, values: np.ndarray, span_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by time, the sum and count of what isn't NaN over (us - span, us]; the sum of nothing is 0.

    Times are cut into buckets of a 24th of the span: a frame is the end of one, whole ones and the start
    of another, so that a row costs the same however many its frame holds. Nothing is subtracted.
    """
    if not len(us):
        return np.zeros(0), np.zeros(0, np.int64)
    known = ~np.isnan(values)
    own = np.where(known, values, 0.0)
    starts = np.flatnonzero(np.diff(us // max(1, span_us // 24), prepend=us[0] // max(1, span_us // 24) - 1))
    bounds = [*starts.tolist(), len(us)]
    upto, rest = np.empty(len(us)), np.empty(len(us))
    for a, b in zip(bounds, bounds[1:]):  # noqa: B905
        upto[a:b], rest[a:b] = np.cumsum(own[a:b]), np.cumsum(own[a:b][::-1])[::-1]
    whole, bucket = rest[starts], np.searchsorted(starts, np.arange(len(us)), "right") - 1
    first, last = np.searchsorted(us, us - span_us, "right"), np.searchsorted(us, us, "right") - 1
    total, at, to = upto[last], bucket[first], bucket[last]
    total = total + np.where(at < to, rest[first], 0.0)
    for d in range(1, int((to - at).max())):
        total = total + np.where(at + d < to, whole[np.minimum(at + d, len(whole) - 1)], 0.0)
    count = np.cumsum(known)
    return total, count[last] - count[first] + known[first]


class _Sliding(StatefulProcessor):
    """State of a series: rows that wait for the clock, rows told that a frame can still reach, both by buckets of time, and the time of the first that waits.

    A bucket's rows are two arrays as bytes, so that state is read and written by the bucket, not by the row.
    """

    #: Rows of one batch that are gathered before they are put into their buckets.
    GATHERED = 500_000

    def __init__(self, span_us: int):
        self.span_us = span_us
        self.bucket_us = max(1, span_us // 24)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "us binary, value binary")
        self.told = handle.getMapState("told", "bucket long", "us binary, value binary")
        self.timer = handle.getValueState("timer", "ms long")

    def _wait(self, at_us: int | None) -> None:
        """One timer a series: for the first time that waits."""
        old = self.timer.get()[0] if self.timer.exists() else None
        new = None if at_us is None else at_us // 1000 + 1
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(new)
            self.timer.update((new,))

    @staticmethod
    def _arrays(state) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(state[0], np.int64), np.frombuffer(state[1], np.float64)

    def _add(self, states, us: np.ndarray, values: np.ndarray) -> None:
        """Rows into their buckets, after those that are there."""
        order = np.argsort(us, kind="stable")
        us, values = us[order], values[order]
        buckets = us // self.bucket_us
        for part in np.split(np.arange(len(us)), np.flatnonzero(np.diff(buckets)) + 1):
            key, more = (int(buckets[part[0]]),), (us[part], values[part])
            if states.containsKey(key):
                more = [np.concatenate(x) for x in zip(self._arrays(states.getValue(key)), more)]  # noqa: B905
            states.updateValue(key, (more[0].tobytes(), more[1].tobytes()))

    def _all(self, states) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {k[0]: self._arrays(v) for k, v in states.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held, n = None, [], 0

        def put() -> None:
            if n:
                self._add(self.waiting, *[np.concatenate(x) for x in zip(*held)])  # noqa: B905

        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            if len(us):
                first = min(int(us.min()), first if first is not None else int(us.min()))
                held.append((us, part["value"].to_numpy(np.float64, na_value=np.nan)))
                n += len(us)
            if n >= self.GATHERED:
                put()
                held, n = [], 0
        put()
        waiting = self.timer.get()[0] if self.timer.exists() else None
        if first is not None and (waiting is None or first // 1000 + 1 < waiting):
            self._wait(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock_us = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, told = self._all(self.waiting), self._all(self.told)
        rows = [(*both, np.full(len(both[0]), waits)) for held, waits in ((told, False), (waiting, True)) for both in held.values()]
        us, values, waits = (np.concatenate(x) for x in zip(*rows))  # noqa: B905
        order = np.argsort(us, kind="stable")
        us, values, waits = us[order], values[order], waits[order]
        due = waits & (us < clock_us)
        left_us = us[waits & ~due]
        before = us < clock_us  # frames of what is due hold nothing later
        total, n = frame_sums(us[before], values[before], self.span_us)
        told_now = due[before]
        # what a later frame can reach stays, and what waits
        reach_us = min([clock_us, *left_us[:1].tolist()]) - self.span_us
        for bucket, both in waiting.items():
            late = both[0] >= clock_us
            if not late.all():
                now = ~late & (both[0] > reach_us)
                if now.any():
                    self._add(self.told, both[0][now], both[1][now])
                if late.any():
                    self.waiting.updateValue((bucket,), (both[0][late].tobytes(), both[1][late].tobytes()))
                else:
                    self.waiting.removeKey((bucket,))
        for bucket in told:
            if (bucket + 1) * self.bucket_us <= reach_us:
                self.told.removeKey((bucket,))
        self._wait(int(left_us[0]) if len(left_us) else None)
        if told_now.any():
            us, value, total, n = us[before][told_now], values[before][told_now], total[told_now], n[told_now]
            for a in range(0, len(us), 100_000):
                b = slice(a, a + 100_000)
                yield pd.DataFrame({"station": key[0], "sensor": key[1], "ts": pd.to_datetime(us[b], unit="us"), "value": value[b], "rolling": np.where(n[b] > 0, total[b], np.nan), "n": n[b]})

    def close(self) -> None:
        pass


def sliding_sums(stream: DataFrame, hours: float = 24.0, late: str = "1 day") -> DataFrame:
    """Each row with the sum and count of its series over (ts - hours, ts], once nothing can come before it any more. (STR-sliding, WIN-08)

    Rows: station, sensor, ts, value, rolling, n. Within the lateness the order of arrival doesn't
    matter: a row is given when the clock has passed it, and its values stay for the frames that reach
    back to them. Null values add nothing; a frame of nulls has a null.
    """
    use_rocksdb(stream.sparkSession)
    rows = stream.where("ts is not null").select("station", "sensor", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    schema = "station string, sensor string, ts timestamp, value double, rolling double, n long"
    return rows.groupBy("station", "sensor").transformWithStateInPandas(_Sliding(int(hours * HOUR)), schema, "Append", "EventTime")

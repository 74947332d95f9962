"""Keyed state over event time: events wait until the watermark passes them, and are then taken in order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RegularGaps(StatefulProcessor):
    """Mean and jitter of the gaps between a key's events.

    State: the waiting events by slot of time, and of those already taken the last time, their number, and mean and squared
    deviation of the gaps. A slot has a timer at its end. When the watermark passes it, the slot's events are sorted and taken, so that
    the order in which files arrive changes nothing, and only one slot of a key is in memory. An event ttl seconds or more
    after the last one starts anew; a last timer drops the state of a key that can only start anew.
    """

    def __init__(self, keys: list[str], slot: int, ttl: int, least: int, most_cv: float):
        self.keys, self.slot, self.ttl, self.least, self.most_cv = keys, slot, ttl, least, most_cv

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "at array<long>")
        self.taken = handle.getValueState("taken", "last long, n long, mean double, m2 double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark, new = timerValues.getCurrentWatermarkInMs(), {}
        for part in rows:
            for at in part["epoch"]:
                new.setdefault(int(at) // self.slot, []).append(int(at))
        for slot, times in new.items():
            end = 1000 * (slot + 1) * self.slot
            if end <= mark:
                continue  # later than the watermark allows: its slot has been taken
            before = self.waiting.getValue((slot,)) if self.waiting.containsKey((slot,)) else None
            self.waiting.updateValue((slot,), ((list(before[0]) if before else []) + times,))
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        slots = sorted(k[0] for k in self.waiting.keys())
        due = [k for k in slots if 1000 * (k + 1) * self.slot <= mark]
        last, n, mean, m2 = self.taken.get() if self.taken.exists() else (None, 0, 0.0, 0.0)
        if not due:
            if not slots and last is not None and 1000 * (last + self.ttl + self.slot) <= mark:
                self.taken.clear()
            return iter(())
        for slot in due:
            for at in sorted(self.waiting.getValue((slot,))[0]):
                if last is not None and at - last >= self.ttl:
                    last, n, mean, m2 = None, 0, 0.0, 0.0
                if last is not None:
                    off = at - last - mean
                    mean += off / n  # n events so far are n gaps with this one
                    m2 += off * (at - last - mean)
                last, n = at, n + 1
            self.waiting.removeKey((slot,))
        self.taken.update((last, n, mean, m2))
        self.handle.registerTimer(1000 * (last + self.ttl + self.slot))
        jitter = 1.0 if n < 3 or mean == 0 else (m2 / (n - 2)) ** 0.5 / mean
        if n > self.least and jitter < self.most_cv:
            return iter([pd.DataFrame([(*key, n, mean, jitter)], columns=[*self.keys, "n", "mean_gap", "jitter"])])
        return iter(())


def stream_jitter(stream: DataFrame, keys: list[str], least: int = 10, most_cv: float = 0.25, late: str = "1 hour", slot: int = 600, ttl: int = 7 * 86400) -> DataFrame:
    """(keys, n, mean_gap, jitter) of a key's events up to the watermark, for keys whose gaps are regular so far; output mode update.

    A row comes when the watermark passes events of its key, and replaces earlier rows of it. Events may come in any order within the time
    late; an event whose slot of time the watermark has passed is left out. An event ttl seconds or more after the one before starts its key anew.
    """
    session = stream.sparkSession
    if session.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"keyed state with timers needs spark.sql.streaming.stateStore.providerClass={STORE}")
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.withWatermark("timestamp", late).where("timestamp IS NOT NULL").select(*keys, "timestamp", F.unix_timestamp("timestamp").alias("epoch"))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", n long, mean_gap double, jitter double"
    return rows.groupBy(*keys).transformWithStateInPandas(RegularGaps(keys, slot, ttl, least, most_cv), schema, "update", "EventTime")

"""The request queue as a stream: eviction by priority and tag, with keyed state and timers.

A request is evicted if within the time after it its user makes another of the same tag, or one of higher priority. Over a
stream that is known either when such a request comes, or when the watermark has passed the end of its time. The state of
a user holds the requests of the last while - the time and the watermark's delay - since one that comes late may still be
evicted by them. A timer at the end of each one's time settles it and takes it out.

Requests may come in any order within the watermark. A user's state is one task's; its length is that user's requests in
the while, and a batch walks over it once, backwards in time."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from linkloom.streaming.events import micros_of

OUT = "event_id long, evicted boolean"


class Queue(StatefulProcessor):
    """Keyed by user. State: every request that may still evict or be evicted, by event_id."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "event_id long", "t long, tag string, value double, settled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: list(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        fresh = []
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.event_id not in held:  # a request that comes twice is one
                    held[int(r.event_id)] = [int(r.t), None if pd.isna(r.event_type) else str(r.event_type), None if pd.isna(r.value) else float(r.value), False]
                    fresh.append(int(r.event_id))
        gone = [e for e in self.evicted(held) if not held[e][3]]
        for e in gone:
            held[e][3] = True
        for e in {*fresh, *gone}:
            self.open.updateValue((e,), tuple(held[e]))
        for e in fresh:
            self.handle.registerTimer((held[e][0] + self.span) // 1000 + 1)
        yield pd.DataFrame({"event_id": pd.Series(gone, dtype="int64"), "evicted": pd.Series([True] * len(gone), dtype="bool")})

    def evicted(self, held: dict[int, list]) -> list[int]:
        """Requests that a later one evicts. Backwards in time, the next of each tag, and those of a rising staircase of
        values: the nearest later one of a higher value is the last step that is higher."""
        out, by_tag, stairs = [], {}, []
        items = sorted(held.items(), key=lambda x: -x[1][0])
        for _, same in itertools.groupby(items, key=lambda x: x[1][0]):  # only later ones evict, not those of the same time
            same = list(same)
            for e, (t, tag, value, _) in same:
                last = t + self.span
                if tag in by_tag and by_tag[tag] <= last:
                    out.append(e)
                elif value is not None:
                    k = self._step(stairs, value)
                    if k is not None and stairs[k][0] <= last:
                        out.append(e)
            for _, (t, tag, value, _) in same:
                by_tag[tag] = t
                if value is not None:
                    while stairs and stairs[-1][1] <= value:
                        stairs.pop()
                    stairs.append((t, value))
        return out

    @staticmethod
    def _step(stairs: list[tuple[int, float]], value: float) -> int | None:
        """The last step (values fall along the staircase) that is higher than value."""
        lo, hi = 0, len(stairs)
        while lo < hi:
            mid = (lo + hi) // 2
            if stairs[mid][1] > value:
                lo = mid + 1
            else:
                hi = mid
        return lo - 1 if lo else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for k, (t, _, _, settled) in list(self.open.iterator()):
            if (t + self.span) // 1000 + 1 <= now:
                if not settled:
                    out.append((k[0], False))
                self.open.removeKey(k)
        yield pd.DataFrame({"event_id": pd.Series([e for e, _ in out], dtype="int64"), "evicted": pd.Series([x for _, x in out], dtype="bool")})

    def close(self) -> None:
        pass


def streamed_evictions(requests: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """requests: a stream of (event_id, ts, user_id, event_type, value). (event_id, evicted), each once: when it is evicted,
    or when the watermark has passed its time; the rows of events.evictions. Requests later than the watermark are left
    out. Needs the RocksDB state store."""
    timed = requests.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("double").alias("value"))
    timed = timed.withColumn("t", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Queue(micros_of(within)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")

"""Spike screening on streams: the bursts that the batch rule finds, with a bounded window of each flight as state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayline.functions.geo import EARTH_KM
from wayline.operators.clean import ORDER, SPEED_KM_S, TOLERANCE_KM
from wayline.operators.spikes import MAX_BRIDGE_SEC, MAX_BURST, PASSES

ROW = [*ORDER, "lat", "lon"]
#: A flight's count of bursts is forgotten so long after its last point.
FORGET_SEC = 86_400.0


def _km(a: tuple, b: tuple) -> float:
    la, lb = math.radians(a[3]), math.radians(b[3])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def _beyond(a: tuple, b: tuple) -> bool:
    return _km(a, b) > SPEED_KM_S * (b[0] - a[0]) + TOLERANCE_KM


def first_burst(points: list[tuple], left: int) -> int:
    """Points of the shortest burst right after ``left``, or 0."""
    a = points[left]
    for size in range(1, min(MAX_BURST, len(points) - left - 2) + 1):
        if not _beyond(a, points[left + size]):
            return 0  # longer bursts would hold this point too
        right = points[left + size + 1]
        bridge = right[0] - a[0]
        if bridge > MAX_BRIDGE_SEC:
            return 0
        if bridge > 0 and not _beyond(a, right) and all(_beyond(x, right) for x in points[left + 1 : left + size + 1]):
            return size
    return 0


def settle(points: list[tuple], bursts: int, until: float) -> tuple[list[tuple], int]:
    """Takes the bursts out of a flight's sorted ``points``, all known up to ``until``: (points taken out, bursts so far).

    Left anchors are judged in order once all points within a bridge of them are known. A burst taken
    out changes what the ``MAX_BURST`` anchors before it see, so they are judged again.
    """
    gone, left = [], 0
    while bursts < PASSES and left < len(points) and points[left][0] + MAX_BRIDGE_SEC <= until:
        if size := first_burst(points, left):
            gone += points[left + 1 : left + 1 + size]
            del points[left + 1 : left + 1 + size]
            bursts += 1
            left = max(0, left - MAX_BURST)
        else:
            left += 1
    return gone, bursts


class SpikeProcessor(StatefulProcessor):
    """Holds a flight's points until no burst can contain them any more.

    A burst that shows up later has its anchors at most a bridge apart, and its left one is less than
    a bridge before the first anchor not yet judged; so points two bridges behind the watermark are final.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "lastposupdate double, state_time double, event_id long, lat double, lon double")
        self.seen = handle.getValueState("seen", "bursts int, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = math.inf
        for part in rows:
            self.points.appendList(list(part[ROW].itertuples(index=False, name=None)))
            first = min(first, float(part["lastposupdate"].min()))
        self._wake(first + 2 * MAX_BRIDGE_SEC)
        return iter([])

    def _wake(self, at: float) -> None:
        self.handle.registerTimer(math.ceil(at * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000
        held = sorted(tuple(r) for r in self.points.get())
        bursts, last = self.seen.get() if self.seen.exists() else (0, -math.inf)
        if not held:
            if until >= last + FORGET_SEC:
                self.seen.clear()
            return
        known = [p for p in held if p[0] <= until]
        later = held[len(known) :]
        last = max(last, held[-1][0])
        gone, bursts = settle(known, bursts, until)
        final = [p for p in known if p[0] + 2 * MAX_BRIDGE_SEC <= until]
        left = known[len(final) :] + later
        if left:
            self.points.put(left)
            self._wake(left[0][0] + 2 * MAX_BRIDGE_SEC)
        else:
            self.points.clear()
            if bursts:
                self._wake(last + FORGET_SEC)
        if bursts:
            self.seen.update((bursts, last))
        out = [(p[2], True) for p in gone] + [(p[2], False) for p in final]
        if out:
            frame = pd.DataFrame(out, columns=["event_id", "spike"])
            frame.insert(0, "flight_id", key[0])
            yield frame

    def close(self) -> None:
        pass


def mark_spikes(points: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """A stream (flight_id, event_id, spike): every valid position once it is certain whether a burst holds it.

    ``points`` is a stream of valid positions with flight_id, the columns of ``ORDER`` (numbers of
    seconds, an integer event_id), lat and lon, without nulls and in any order; rows later than
    ``delay`` are dropped by the watermark. The spikes are those of ``operators.spikes.find_spikes`` on all rows. The state is what came in
    the last two minutes before the watermark and after it, whatever the length of a flight, and a
    count for flights with bursts. Rows within two minutes of the end of the stream stay held.
    Repeated rows are points of their own. Needs the RocksDB state store.
    """
    timed = points.select("flight_id", *[F.col(c).cast("double").alias(c) if c != "event_id" else F.col(c).cast("long").alias(c) for c in ROW], F.timestamp_seconds("lastposupdate").alias("ts"))
    kind = points.schema["flight_id"].dataType.simpleString()
    return timed.withWatermark("ts", delay).groupBy("flight_id").transformWithStateInPandas(SpikeProcessor(), f"flight_id {kind}, event_id long, spike boolean", "Append", "EventTime")

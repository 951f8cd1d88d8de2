"""Sessions of a live stream of events: those of the batch, given out once they can't grow any more.

State is a series' events that the watermark has not reached yet, and its open session as five numbers. Both
are dropped when a session is given out, by timers, so a series that falls silent keeps no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "house_id long, phase string, start timestamp, end timestamp, n_events long, avg_magnitude double, max_magnitude double"
EVENT = "id long, start long, end long, magnitude double"
OPEN = "start long, end long, last long, n long, total double, most double"


class Sessions(StatefulProcessor):
    """Times are milliseconds. An event is taken up when the watermark has passed its start, in order of start and id; one
    that comes later than that is late and dropped. A session is closed by an event that starts over ``gap`` past
    the end of the one before, or by the watermark passing that point."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        found = [r for batch in rows for r in zip(batch.id.tolist(), batch.start.tolist(), batch.end.tolist(), batch.magnitude.tolist(), strict=True) if r[1] >= mark]
        if found:
            self.waiting.appendList(found)
        yield from self._drained(key, mark)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._drained(key, timerValues.getCurrentWatermarkInMs())

    def _drained(self, key: tuple, mark: int) -> Iterator[pd.DataFrame]:
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        now = tuple(self.open.get()) if self.open.exists() else None
        closed, due = [], [r for r in waiting if r[1] < mark]
        for _, start, end, magnitude in due:
            size = abs(magnitude)
            if now is not None and start - now[2] <= self.gap:
                now = (now[0], max(now[1], end), end, now[3] + 1, now[4] + size, max(now[5], size))
                continue
            if now is not None:
                closed.append(now)
            now = (start, end, end, 1, size, size)
        if now is not None and mark > now[2] + self.gap:  # what may still come starts at the watermark or later
            closed.append(now)
            now = None
        rest = waiting[len(due) :]
        if rest:
            self.waiting.put(rest)
        elif waiting:
            self.waiting.clear()
        if now is not None:
            self.open.update(now)
        elif self.open.exists():
            self.open.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        wanted = ([rest[0][1] + 1] if rest else []) + ([now[2] + self.gap + 1] if now is not None else [])
        if wanted:
            self.handle.registerTimer(max(min(wanted), mark + 1))
        if closed:
            ms = lambda i: pd.to_datetime([c[i] for c in closed], unit="ms")
            yield pd.DataFrame({"house_id": key[0], "phase": key[1], "start": ms(0), "end": ms(1), "n_events": [c[3] for c in closed], "avg_magnitude": [c[4] / c[3] for c in closed], "max_magnitude": [c[5] for c in closed]})

    def close(self) -> None:
        pass


def streaming_sessions(events: DataFrame, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Events (house_id, phase, id, start, end: timestamps, magnitude) -> OUT, one row per session, append mode. The state
    store must be RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    rows = events.withWatermark("start", late).select("house_id", "phase", "id", "start", "end", "magnitude")
    ms = lambda c: F.unix_millis(c).alias(c)
    keyed = rows.withColumns({"at": F.col("start")}).select("house_id", "phase", "at", "id", ms("start"), ms("end"), "magnitude").groupBy("house_id", "phase")
    return keyed.transformWithStateInPandas(Sessions(gap_seconds * 1000), OUT, "Append", "EventTime")

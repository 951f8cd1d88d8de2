"""Sharp edges of a live stream of readings: state is each series' last reading."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "house_id long, phase string, event string, ts timestamp, magnitude double"
STATE = "ts long, watts double"


def streaming_edges(readings: DataFrame, threshold: float, off_factor: float = 0.8, late: str = "10 minutes") -> DataFrame:
    """Readings (house_id, phase, ts, watts) -> one row per diff at or over the threshold. Readings
    of a batch are put in order; one older than the state's is dropped, as is one past the watermark."""
    off = -int(threshold * off_factor)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts")
        rows = rows[rows.watts.notna()]
        if state.exists:
            at, last = state.get
            rows = rows[rows.ts.astype("int64") > at]
        else:
            last = None
        if not len(rows):
            return
        diff = rows.watts.diff()
        if last is not None:
            diff.iloc[0] = rows.watts.iloc[0] - last
        state.update((int(rows.ts.astype("int64").iloc[-1]), float(rows.watts.iloc[-1])))
        event = pd.Series(None, index=rows.index, dtype=object).mask(diff >= threshold, "on").mask(diff <= off, "off")
        hit = event.notna()
        yield pd.DataFrame({"house_id": key[0], "phase": key[1], "event": event[hit], "ts": rows.ts[hit], "magnitude": diff[hit]})

    keyed = readings.withWatermark("ts", late).groupBy("house_id", "phase")
    return keyed.applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")

"""Matching and extraction stream many series through a Python call."""

import numpy as np
import pandas as pd

from gridloom.operators import matching

KEYS = ("house_id", "month", "phase")
EDGE = "house_id long, month string, phase string, event string, event_id string, start int, end int, magnitude double"


def rows_of(n: int):
    """Readings and edges of ``n`` series; some have no edges, one has no month."""
    rng = np.random.default_rng(5)
    grid, edges = [], []
    for house in range(n):
        key = (house // 2, None if house == 3 else "2024-01", f"w{house % 2 + 1}")
        watts = np.full(30, 100.0)
        for k, at in enumerate(sorted(rng.choice(20, 2, replace=False)) if house % 3 else ()):
            size, length = float(rng.integers(8, 30)) * 100, int(rng.integers(2, 8))
            watts[at : at + length] += size
            edges += [(*key, "on", f"on-{k}", int(at), int(at), size), (*key, "off", f"off-{k}", int(at) + length, int(at) + length, -size)]
        grid += [(*key, m, None if m == 29 else float(w)) for m, w in enumerate(watts)]
    return grid, edges


def test_series_that_span_batches_are_matched_and_taken_out_as_each_alone(spark):
    grid, edges = rows_of(40)
    readings, found = spark.createDataFrame(grid, "house_id long, month string, phase string, m int, watts double"), spark.createDataFrame(edges, EDGE)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        pairs = spark.createDataFrame(matching.match(readings, found, KEYS).collect(), matching.match(readings, found, KEYS).schema)
        got = matching.extract(readings, pairs, KEYS, profiles=True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want_pairs, want_minutes, want_held = [], [], []
    frame, of = pd.DataFrame(grid, columns=[*KEYS, "m", "watts"]), pd.DataFrame(edges, columns=[*KEYS, "event", "event_id", "start", "end", "magnitude"])
    names = [c.split()[0] for c in matching.MATCHED.split(", ")]
    for key, part in frame.groupby(list(KEYS), dropna=False):
        mine = of[(of.house_id == key[0]) & (of.phase == key[2])]
        signal = matching.Signal(part.m.to_numpy(), part.watts.to_numpy(float))
        rows = pd.DataFrame(matching.match_series(signal, matching.Edges(mine[mine.event == "on"]), matching.Edges(mine[mine.event == "off"])), columns=names)
        want_pairs += [(key[0], key[2], r.status, r.on_id, r.off_id) for r in rows.itertuples()]
        rows = rows[rows.status == "matched"].assign(minutes=lambda x: x.off_end - x.on_start)
        held = []
        left, taken, _ = matching.extract_series(signal, rows, held)
        want_minutes += [(key[0], key[2], int(m), float(x), float(t)) for m, x, t in zip(part.m, left, taken.sum(0), strict=True)]
        want_held += [(key[0], key[2], *h) for h in held]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.house_id, r.phase, r.status, r.on_id, r.off_id) for r in pairs.collect()) == order(want_pairs)
    assert order((r.house_id, r.phase, r.m, r.remaining, r.short_duration + r.medium_duration + r.long_duration) for r in got if r.m is not None) == order(want_minutes)
    assert order((r.house_id, r.phase, r.on_id, r.at, r.power) for r in got if r.on_id is not None) == order(want_held)
    assert any(r.status == "matched" for r in pairs.collect()) and want_held


def test_no_frame_is_made_for_each_series(spark, capsys):
    """A call for every house's phase takes hundredths of a second, minutes for some ten thousand of them."""
    grid, edges = rows_of(4)
    readings, found = spark.createDataFrame(grid, "house_id long, month string, phase string, m int, watts double"), spark.createDataFrame(edges, EDGE)
    pairs = matching.match(readings, found, KEYS)
    pairs.explain()
    matching.extract(readings, pairs, KEYS).explain()
    assert "FlatMapCoGroups" not in capsys.readouterr().out

"""Pairing ON with OFF edges, and taking the pairs out of the signal.

Both walk a series in order and read what earlier pairs have used up, so they are kernels over one (house,
month, phase): at most a month of minutes and its edges, whatever the size of the corpus. Series stream
past in order, many in a Python call.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.detection import MONTHLY
from gridloom.operators.sessions import match_tag
from gridloom.operators.stretches import over_series

# Limits of the matching (fixed values), in watts and minutes.
DIFFERENCE = 350.0
WINDOWS = (15, 30, 60, 120, 240, 360)
EASY_DIFFERENCE, EASY_MINUTES = 100.0, 2
NOISE = 200.0
PARTIAL_RATIO = 1.5
TOLERANCE = -10.0
MOST_SPREAD, LEAST_SHARE = 0.30, 0.50


class Signal:
    """A series' minutes, power and row differences, in order."""

    def __init__(self, m: np.ndarray, watts: np.ndarray):
        self.m, self.watts = m, watts
        self.diff = np.diff(watts, prepend=np.nan)

    def spans(self, on_start: int, on_end: int, off_start: int, off_end: int) -> tuple[slice, slice, slice]:
        """Rows of the rise, of what lies between, and of the fall without its last minute."""
        a, b, c, d = np.searchsorted(self.m, [on_start, on_end + 1, off_start, off_end])
        return slice(a, b), slice(b, max(b, c)), slice(max(b, c), max(b, c, d))

    def before(self, row: int, most: int = 10) -> float:
        """The last power read in the ``most`` rows before ``row``, 0 if none."""
        near = self.watts[max(0, row - most) : row]
        near = near[~np.isnan(near)]
        return float(near[-1]) if len(near) else 0.0


def correction_of(signal: Signal, pair: tuple[int, int, int, int], magnitude: float) -> float | None:
    """Trial subtraction of a device of ``magnitude`` over (on_start, on_end, off_start, off_end): how far
    the signal would fall under zero, or None if the pair is none: the device would be unsteady, the
    house would draw too little while it ran, or the signal would go under the tolerance.

    A missing reading makes the rest of its part unknown (sums carry it on)."""
    rise, run, fall = signal.spans(*pair)
    up = np.cumsum(signal.diff[rise])
    level = up[-1] if len(up) else magnitude
    middle = np.maximum(level + np.cumsum(signal.diff[run]), 0)
    level = middle[-1] if len(middle) else level
    down = np.maximum(level + np.cumsum(signal.diff[fall]), 0)
    known = middle[~np.isnan(middle)]
    if len(known) >= 3 and (known.std() / magnitude > MOST_SPREAD or known.min() / magnitude < LEAST_SHARE):
        return None
    drawn = signal.watts[run]
    drawn = drawn[~np.isnan(drawn)]
    if len(drawn) >= 3 and drawn.min() < signal.before(rise.start) + 0.5 * magnitude:
        return None
    device = np.concatenate([up, middle, down])
    values = np.concatenate([device, signal.watts[rise.start : rise.start + len(device)] - device])
    values = values[~np.isnan(values)]
    least = float(values.min()) if len(values) else 0.0
    return None if least < TOLERANCE else max(0.0, -least)


class Edges:
    """A series' ON or OFF edges in order of start; ``size`` is without sign."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["start", "end", "event_id"])
        self._set(rows.event_id.tolist(), rows.start.to_numpy(np.int64), rows.end.to_numpy(np.int64), rows.magnitude.to_numpy(float))

    def _set(self, ids: list[str], start: np.ndarray, end: np.ndarray, magnitude: np.ndarray) -> None:
        self.ids, self.start, self.end, self.size = ids, start, end, np.abs(magnitude)
        self.open = np.ones(len(ids), bool)

    @classmethod
    def ordered(cls, ids: list[str], start: np.ndarray, end: np.ndarray, magnitude: np.ndarray) -> Edges:
        """Of columns that are in order of start, end and id."""
        out = cls.__new__(cls)
        out._set(ids, start, end, magnitude)
        return out


def _between(signal: Signal, on_end: int, off_start: int) -> np.ndarray:
    lo, hi = np.searchsorted(signal.m, [on_end + 1, off_start])
    found = signal.watts[lo:hi]
    return found[~np.isnan(found)]


def _stage(signal: Signal, on: Edges, off: Edges, i: int, stage: int) -> tuple[int, float] | None:
    """The OFF that ON ``i`` takes at this stage, and the pair's correction."""
    wait = off.start - on.end[i]
    apart = np.abs(off.size - on.size[i])
    possible = off.open & (wait > 0) & (wait <= WINDOWS[-1]) & ((apart <= DIFFERENCE) if stage < 3 else (apart > DIFFERENCE))
    rows = np.flatnonzero(possible)
    if not len(rows):
        return None
    window = np.searchsorted(WINDOWS, wait[rows])
    order = np.lexsort((rows, wait[rows], apart[rows], window)) if stage < 3 else np.lexsort((rows, apart[rows], wait[rows]))
    for j in rows[order]:
        pair = (on.start[i], on.end[i], off.start[j], off.end[j])
        power = _between(signal, on.end[i], off.start[j])
        magnitude = on.size[i]
        if stage == 3:
            magnitude = min(on.size[i], off.size[j])
            steady = not len(power) or np.abs(power - power[0]).max() <= DIFFERENCE
            if not steady or max(on.size[i], off.size[j]) <= PARTIAL_RATIO * magnitude:
                continue
        elif stage == 2:
            if not len(power) or power.min() < power[0] - NOISE:
                continue
        elif off.end[j] - on.start[i] > EASY_MINUTES and apart[j] > EASY_DIFFERENCE and (not len(power) or np.abs(power - power[0]).max() > DIFFERENCE):
            continue
        correction = correction_of(signal, pair, magnitude)
        if correction is not None:
            return int(j), correction
    return None


MATCHED = "status string, stage int, on_id string, off_id string, on_start int, on_end int, off_start int, off_end int, on_magnitude double, off_magnitude double, correction double"


def match_series(signal: Signal, on: Edges, off: Edges) -> list[tuple]:
    """MATCHED rows of a series: pairs of the clean (1), noisy (2) and partial (3) stage, remainders of
    partial pairs, and edges left over. Each ON takes the first OFF that fits and is still free."""
    out = []
    for stage in (1, 2, 3):
        for i in np.flatnonzero(on.open):
            if (found := _stage(signal, on, off, i, stage)) is None:
                continue
            j, correction = found
            on.open[i] = off.open[j] = False
            least = min(on.size[i], off.size[j])
            sizes = (least - correction, least - correction) if stage == 3 else (on.size[i] - correction, -(off.size[j] - correction))
            ends = (int(on.start[i]), int(on.end[i]), int(off.start[j]), int(off.end[j]))
            out.append(("matched", stage, on.ids[i], off.ids[j], *ends, *sizes, correction))
            if stage == 3:
                rest = float(abs(on.size[i] - off.size[j]))
                if on.size[i] > off.size[j]:
                    out.append(("remainder_on", stage, f"{on.ids[i]}_remainder", None, *ends[:2], None, None, rest, None, 0.0))
                else:
                    out.append(("remainder_off", stage, None, f"{off.ids[j]}_remainder", None, None, *ends[2:], None, -rest, 0.0))
    out += [("unmatched_on", 0, on.ids[i], None, int(on.start[i]), int(on.end[i]), None, None, float(on.size[i]), None, 0.0) for i in np.flatnonzero(on.open)]
    out += [("unmatched_off", 0, None, off.ids[j], None, None, int(off.start[j]), int(off.end[j]), None, float(-off.size[j]), 0.0) for j in np.flatnonzero(off.open)]
    return out


def _kinds(df: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


#: Arrow's types of the schemas' columns.
TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def _batch(part: pa.Table, keys: tuple[str, ...], at: np.ndarray, schema: str, columns: dict) -> pa.RecordBatch:
    """The keys of the rows ``at`` and ``columns`` of ``schema``, null where one is not given; NaN is null."""
    n = len(at)
    arrays = [part[k].combine_chunks().take(pa.array(at)) for k in keys]
    names = list(keys)
    for name, kind in (c.split() for c in schema.split(", ")):
        given = columns.get(name)
        arrays.append(pa.nulls(n, TYPES[kind]) if given is None else pa.array(given, TYPES[kind], from_pandas=True))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def _numbers(part: pa.Table, column: str, kind: type) -> np.ndarray:
    """A column as an array; nulls of doubles are NaN."""
    return part[column].to_numpy().astype(kind, copy=False)


def match(grid: DataFrame, events: DataFrame, keys: tuple[str, ...] = MONTHLY) -> DataFrame:
    """(keys, MATCHED, minutes, tag): one row per pair, remainder and edge left over.

    ``grid`` (keys, m, watts); ``events`` (keys, event, event_id, start, end, magnitude). A series with
    edges but no readings matches nothing. ``status`` tells the kinds of rows apart."""

    def run(part: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, start, end, size = (_numbers(part, c, t) for c, t in (("kind", np.int64), ("start", np.int64), ("end", np.int64), ("magnitude", float)))
        series, out, at = np.append(starts, len(kind)), [], []
        for i in np.flatnonzero(np.maximum.reduceat(kind, starts)).tolist():
            lo, hi = int(series[i]), int(series[i + 1])
            on, off = (lo + np.searchsorted(kind[lo:hi], [1, 2])).tolist()
            edges = lambda a, b: Edges.ordered(part["event_id"].slice(a, b - a).to_pylist(), start[a:b], end[a:b], size[a:b])
            rows = match_series(Signal(start[lo:on], size[lo:on]), edges(on, off), edges(off, hi))
            out += rows
            at += [lo] * len(rows)
        if out:
            names = [c.split()[0] for c in MATCHED.split(", ")]
            yield _batch(part, keys, np.array(at), MATCHED, dict(zip(names, zip(*out, strict=True), strict=True)))

    kind = F.when(F.col("event") == "on", 1).when(F.col("event") == "off", 2).alias("kind")
    minutes = grid.select(*keys, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("event_id"), F.col("m").alias("start"), F.col("m").alias("end"), F.col("watts").alias("magnitude"))
    rows = minutes.unionByName(events.where("event in ('on', 'off')").select(*keys, kind, "event_id", "start", "end", "magnitude"))
    found = over_series(rows, list(keys), ["kind", "start", "end", "event_id"], run, f"{_kinds(events, keys)}, {MATCHED}")
    minutes = F.col("off_end") - F.col("on_start")
    corrected = F.col("correction") > 0
    tag = match_tag(F.col("on_magnitude") , F.col("off_magnitude"), minutes, F.col("stage") == 2, F.col("stage") == 3, corrected)
    return found.withColumn("minutes", minutes).withColumn("tag", F.when(F.col("status") == "matched", tag))


EXTRACTED = "m int, original double, remaining double, short_duration double, medium_duration double, long_duration double, skipped string"


def _bucket(minutes: int) -> int:
    """0: up to two minutes, 1: up to 24, 2: longer."""
    return 0 if minutes <= 2 else 1 if minutes <= 24 else 2


def _clipped(values: np.ndarray, level: float) -> np.ndarray:
    """Spikes of over a quarter above the level are cut to it."""
    return np.minimum(values, level) if len(values) and values.max() > 1.25 * level else values


def device_power(signal: Signal, remaining: np.ndarray, pair: tuple[int, int, int, int], magnitude: float, kind: str) -> tuple[slice, np.ndarray]:
    """Rows of a pair and the device's power there, given what remains of the signal. ``kind``: standard,
    noisy (others may run meanwhile: flat at its magnitude), or partial (flat, the lesser magnitude)."""
    rise, run, fall = signal.spans(*pair)
    up = np.cumsum(np.nan_to_num(signal.diff[rise]))
    if kind == "partial":
        up = np.minimum(up, magnitude)
    elif len(up) > 1:
        up = _clipped(up, max(up[0], up[-1]))
    level = up[-1] if len(up) else magnitude
    if kind == "noisy":
        middle = np.minimum(remaining[run], magnitude)
        last = remaining[fall.stop] if fall.stop < len(remaining) and signal.m[fall.stop] == pair[3] else (remaining[fall][-1] if fall.stop > fall.start else 0.0)
        down = np.maximum(remaining[fall] - last, 0)
    else:
        top = magnitude if kind == "partial" else level
        middle = np.clip(remaining[run], 0, max(top, 0))
        level = magnitude if kind == "partial" else (middle[-1] if len(middle) else level)
        down = np.maximum(level + np.cumsum(np.nan_to_num(signal.diff[fall])), 0)
        down = np.minimum(down if kind == "partial" else _clipped(down, level), remaining[fall])
    return slice(rise.start, fall.stop), np.concatenate([up, middle, down])


class Pair(NamedTuple):
    """What a pair's extraction reads."""

    stage: int
    on_id: str
    on_start: int
    on_end: int
    off_start: int
    off_end: int
    on_magnitude: float
    minutes: int


def extract_series(signal: Signal, pairs: pd.DataFrame, profiles: list[tuple] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """take_out() of pairs in any order."""
    return take_out(signal, pairs.sort_values(["minutes", "on_start", "on_id"]).itertuples(), profiles)


def take_out(signal: Signal, pairs: Iterable[Pair], profiles: list[tuple] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(remaining, power by duration bucket (3, n), on_ids of skipped pairs). ``pairs`` come short ones first, then
    by start; a pair that would leave a negative anywhere is skipped whole. Row differences are those of
    the signal that came in. ``profiles`` gathers (on_id, minutes, watts) of every pair that was taken out: what each of its
    minutes, the OFF's last included, gave to it."""
    remaining = np.nan_to_num(signal.watts)
    by_bucket, skipped = np.zeros((3, len(remaining))), []
    for p in pairs:
        kind = {2: "noisy", 3: "partial"}.get(p.stage, "standard")
        rows, device = device_power(signal, remaining, (p.on_start, p.on_end, p.off_start, p.off_end), abs(p.on_magnitude), kind)
        left = remaining[rows] - device
        if (device < 0).any() or (left < 0).any():
            skipped.append(p.on_id)
            continue
        remaining[rows] = left
        by_bucket[_bucket(p.minutes), rows] += device
        if profiles is not None:
            whole = slice(rows.start, max(rows.stop, int(np.searchsorted(signal.m, p.off_end, "right"))))
            watts = np.zeros(whole.stop - whole.start)
            watts[: len(device)] = device
            profiles.append((p.on_id, signal.m[whole].tolist(), watts.tolist()))
    return remaining, by_bucket, skipped


PROFILE = "on_id string, at array<int>, power array<double>"


def extract(grid: DataFrame, matches: DataFrame, keys: tuple[str, ...] = MONTHLY, profiles: bool = False) -> DataFrame:
    """(keys, EXTRACTED): a row per minute with the signal before and after, and the power taken out by the
    pairs' duration; besides, a row per skipped pair with its on_id in ``skipped`` and no minute.
    Months without pairs pass through. With ``profiles`` there are also the columns of PROFILE, and a row without a
    minute for every pair that was taken out: see minutes_of() and profiles_of()."""

    def run(part: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _numbers(part, "kind", np.int64) == 0
        series = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(own))))
        at, m, watts = np.flatnonzero(own), _numbers(part, "on_start", np.int64)[own], _numbers(part, "on_magnitude", float)[own]
        remaining, taken, skipped, held = np.nan_to_num(watts), np.zeros((3, len(m))), [], []
        asked = part.filter(pa.array(~own))
        columns = [asked[c].to_pylist() if c in ("on_start", "on_magnitude") else asked["pair"].combine_chunks().field(c).to_pylist() for c in Pair._fields]
        found, bounds = np.unique(series[~own], return_index=True)
        bounds = np.append(bounds, asked.num_rows).tolist()
        spans = np.searchsorted(series[own], [found, found + 1]).T.tolist()
        for i, span, lo, hi in zip(found.tolist(), spans, bounds[:-1], bounds[1:], strict=True):
            rows = slice(*span)
            profile: list[tuple] | None = [] if profiles else None
            pairs = map(Pair._make, zip(*[c[lo:hi] for c in columns], strict=True))
            remaining[rows], taken[:, rows], lost = take_out(Signal(m[rows], watts[rows]), pairs, profile)
            skipped += [(starts[i], on_id) for on_id in lost]
            held += [(starts[i], *p) for p in profile or ()]
        if len(at):
            yield _batch(part, keys, at, schema, {"m": m, "original": watts, "remaining": remaining, "short_duration": taken[0], "medium_duration": taken[1], "long_duration": taken[2]})
        for names, rows in (("skipped",), skipped), (("on_id", "at", "power"), held):
            if rows:
                first, *values = zip(*rows, strict=True)
                yield _batch(part, keys, np.array(first), schema, dict(zip(names, values, strict=True)))

    schema = EXTRACTED + (f", {PROFILE}" if profiles else "")
    pair = [c for c in Pair._fields if c not in ("on_start", "on_magnitude")]
    pairs = matches.where("status = 'matched'").select(*keys, F.lit(1).alias("kind"), "on_start", "on_magnitude", F.struct(*pair).alias("pair"))
    minutes = grid.select(*keys, F.lit(0).alias("kind"), F.col("m").alias("on_start"), F.col("watts").alias("on_magnitude"), F.lit(None).cast(dict(pairs.dtypes)["pair"]).alias("pair"))
    return over_series(minutes.unionByName(pairs), list(keys), ["kind", "pair.minutes", "on_start", "pair.on_id"], run, f"{_kinds(grid, keys)}, {schema}")


def minutes_of(extracted: DataFrame) -> DataFrame:
    """The minutes of extract()'s rows."""
    return extracted.where("m is not null").drop("skipped", "on_id", "at", "power")


def profiles_of(extracted: DataFrame, keys: tuple[str, ...] = MONTHLY) -> DataFrame:
    """(keys, on_id, at, power): of every pair taken out, its minutes and what each gave to it."""
    return extracted.where("on_id is not null").select(*keys, "on_id", "at", "power")


def restored(matches: DataFrame, extracted: DataFrame, keys: tuple[str, ...] = MONTHLY) -> tuple[DataFrame, DataFrame]:
    """(matches without the skipped pairs, the skipped pairs as unmatched edges): their corrections are
    undone, so that a later round sees the edges as they were found."""
    skipped = extracted.where("skipped is not null").select(*keys, F.col("skipped").alias("on_id"))
    kept = matches.join(skipped, [*keys, "on_id"], "left_anti").select(*matches.columns)
    lost = matches.where("status = 'matched'").join(skipped, [*keys, "on_id"], "left_semi")
    edge = lambda kind, size: lost.select(*keys, F.lit(kind).alias("event"), F.col(f"{kind}_id").alias("event_id"), F.col(f"{kind}_start").alias("start"), F.col(f"{kind}_end").alias("end"), size.alias("magnitude"))
    on = edge("on", F.abs("on_magnitude") + F.col("correction"))
    return kept, on.unionByName(edge("off", -(F.abs("off_magnitude") + F.col("correction"))))


def summary(extracted: DataFrame, keys: tuple[str, ...] = MONTHLY) -> DataFrame:
    """Per series: minutes, energy before and after, and taken out by duration, in watt hours."""
    hours = lambda c: (F.sum(c) / 60).alias(c)
    return extracted.where("skipped is null").groupBy(*keys).agg(F.count("*").alias("n_minutes"), *[hours(c) for c in ("original", "remaining", "short_duration", "medium_duration", "long_duration")])


def rounds_of(found: list[DataFrame], thresholds: tuple[int, ...]) -> DataFrame:
    """All rounds' matches as one table, tagged with iteration and threshold."""
    return reduce(DataFrame.unionByName, [f.withColumn("iteration", F.lit(n)).withColumn("threshold", F.lit(t)) for n, (f, t) in enumerate(zip(found, thresholds, strict=True))])

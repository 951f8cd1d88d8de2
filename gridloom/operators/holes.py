"""Holes that rectangles have torn into the remaining signal: undone in order, taken out again as decaying waves.

A device that starts strong and fades is taken out as a rectangle too tall for its later minutes; what remains is a
hole between two levels. Repair gives such a match's power back, takes a wave out instead, and replaces the
match by a record of the wave. Repairs of one series change what the next one sees, so they run in order;
those whose surroundings don't meet can't see one another, so islands of them are walked side by side and
only their minutes leave Spark's own operators.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.stretches import dealt, over_stretches
from gridloom.sources.work import staged

# Limits (fixed values): minutes on either side, watts, shares, watt minutes.
EDGE, LEAST_EDGE, DROP, LEAST_SHARE, LEAST_TAKEN = 5, 100.0, 0.5, 0.15, 100.0
#: A wave ends at this share of its height, or at the OFF's magnitude if that is less.
FADED = 0.1
LEAST_MINUTES = 3
FOUND = "kind int, m int, watts double, on_id string, iteration int, start int, peak int, end int, minutes int, height double, baseline double, taken double"
CANDIDATE = ("on_id", "iteration", "on_start", "on_end", "off_start", "off_end", "on_magnitude", "off_magnitude")


def suspects(matches: DataFrame) -> DataFrame:
    """Long matches whose ON and OFF differ or that were corrected; waves are none."""
    tag = F.coalesce(F.col("tag"), F.lit(""))
    unequal = tag.rlike("(APPROX|LOOSE).*EXTENDED") | (tag.contains("CORRECTED") & tag.contains("EXTENDED"))
    return matches.where(unequal & ~tag.startswith("WAVE-"))


def _middle(values: np.ndarray) -> float:
    values = values[~np.isnan(values)]
    return float(np.median(values)) if len(values) else np.nan


def mend(m: np.ndarray, watts: np.ndarray, on_start: int, on_end: int, off_start: int, off_end: int, on: float, off: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(rows of the match, their new power, baseline) if the match has torn a hole, else None. ``watts`` is what
    remains, by minute ``m`` in order.

    A hole: three minutes or more inside whose median is under DROP of the level on both sides (the larger of the
    two where one side has no minutes), that level LEAST_EDGE watts or more and LEAST_SHARE of the magnitude. The
    power given back is the ON's magnitude over the whole match; the wave falls in a line from it to FADED of
    it (or to the OFF's magnitude), and takes at most what lies over the mean of the minutes before."""
    inside = watts[(m > on_end) & (m < off_start)]
    before, after = watts[(m >= on_start - EDGE) & (m < on_start)], watts[(m > off_end) & (m <= off_end + EDGE)]
    if len(inside) < LEAST_MINUTES:
        return None
    left, right = _middle(before) if len(before) else 0.0, _middle(after) if len(after) else 0.0
    level = (left + right) / 2 if len(before) and len(after) else max(left, right)
    if not (level >= LEAST_EDGE and _middle(inside) < DROP * level and on > 0 and level / on >= LEAST_SHARE):
        return None
    rows = np.flatnonzero((m >= on_start) & (m <= off_end))
    if len(rows) < LEAST_MINUTES:
        return None
    known = before[~np.isnan(before)]
    baseline = float(known.mean()) if len(known) else 0.0
    whole = watts[rows] + on
    profile = np.linspace(on, min(off, FADED * on), len(rows))
    return rows, whole - np.minimum(profile, np.maximum(whole - baseline, 0.0)), baseline


def _walk(part: dict) -> list[tuple]:
    """FOUND rows of an island: minutes that changed (kind 0) and the waves that replace matches (kind 1)."""
    own = part["kind"] == 0
    m, watts = part["m"][own], part["watts"][own].astype(float).copy()
    start, out, changed = watts.copy(), [], np.zeros(len(watts), bool)
    for i in np.flatnonzero(~own):
        on_start, on_end, off_start, off_end = (int(part[c][i]) for c in ("on_start", "on_end", "off_start", "off_end"))
        on = abs(float(part["on_magnitude"][i]))
        found = mend(m, watts, on_start, on_end, off_start, off_end, on, abs(float(part["off_magnitude"][i])))
        if found is None:
            continue
        rows, left, baseline = found
        taken = float(np.nansum(watts[rows] + on - left))
        if taken < LEAST_TAKEN:
            continue
        watts[rows], changed[rows] = left, True
        peak = on_end if on_end > on_start else on_start + 1
        out.append((1, None, None, part["on_id"][i], int(part["iteration"][i]), on_start, peak, off_end, len(rows), on, baseline, taken))
    same = np.isclose(start, watts, rtol=0, atol=0, equal_nan=True)
    return out + [(0, int(m[i]), float(watts[i]), *[None] * 9) for i in np.flatnonzero(changed & ~same)]


def wave_tag(minutes: Column) -> Column:
    """SPIKE to 2 minutes, QUICK to 5, MEDIUM to 25, EXTENDED."""
    return F.when(minutes <= 2, "SPIKE").when(minutes <= 5, "QUICK").when(minutes <= 25, "MEDIUM").otherwise("EXTENDED")


def repair_holes(matches: DataFrame, grid: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining signal, records of waves, ids of replaced matches).

    ``matches`` (keys, iteration, on_id, on_start, ..., off_magnitude, tag) and what remains, ``grid`` (keys, m, watts).
    Suspects are looked at by iteration, then start, then id, each on what the ones before have left. Records have
    the form of matches; ids are (keys, iteration, on_id). Without suspects nothing changes. Matches without both edges, and
    readings of other series, stay as they are; missing readings stay missing."""
    keys = list(keys)
    lists = suspects(matches).select(*keys, *CANDIDATE).dropna(subset=["on_start", "on_end", "off_start", "off_end"])
    lo, hi = F.col("on_start") - EDGE, F.col("off_end") + EDGE
    w = W.partitionBy(*keys).orderBy(lo, hi, "on_id")
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    lists = lists.withColumn("fresh", F.when(lo <= reach, 0).otherwise(1))
    lists = staged(lists.withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("fresh"))
    spans = lists.groupBy(*keys, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    minutes = spans.select(*keys, "island", F.explode(F.sequence("lo", "hi")).alias("m")).join(grid.select(*keys, "m", "watts"), [*keys, "m"])
    zero = lambda c: F.lit(0 if c != "on_id" else "").cast(dict(lists.dtypes)[c]).alias(c)
    both = minutes.select(*keys, "island", F.lit(0).alias("kind"), "m", "watts", *[zero(c) for c in CANDIDATE])
    both = both.unionByName(lists.select(*keys, "island", F.lit(1).alias("kind"), F.lit(0).cast(dict(minutes.dtypes)["m"]).alias("m"), F.lit(0.0).alias("watts"), *CANDIDATE))
    found = staged(over_stretches(dealt(both, [*keys, "island"]), [*keys, "island"], ["kind", "m", "iteration", "on_start", "on_id"], _walk, FOUND))

    changed = found.where("kind = 0").select(*keys, "m", F.col("watts").alias("mended"))
    left = grid.join(changed, [*keys, "m"], "left").withColumn("watts", F.coalesce("mended", "watts")).select(*grid.columns)
    waves = found.where("kind = 1")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in (*keys, "iteration", "on_id")])
    records = waves.select(
        *keys, F.concat(F.lit("wave_"), F.substring(F.sha2(key, 256), 1, 8)).alias("on_id"), F.col("start").alias("on_start"), F.col("peak").alias("on_end"), (F.col("end") - 1).alias("off_start"), F.col("end").alias("off_end"),
        "minutes", F.col("height").alias("on_magnitude"), (-0.5 * F.col("height")).alias("off_magnitude"), F.concat(F.lit("WAVE-REPAIR-"), wave_tag(F.col("minutes"))).alias("tag"), "baseline", "taken",
    )
    return left, records, waves.select(*keys, "iteration", "on_id")

"""Waves (fast rises that decay) and cycles that pairs of edges have missed: found, taken out, checked.

What consumes a signal in order runs by series, (house_id, phase), over the waves' own minutes; the rest is
joins over minutes. Tables are (house_id, phase, m, watts).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators import kernels
from gridloom.operators.holes import repair_holes, wave_tag
from gridloom.operators.stretches import dealt, over_stretches
from gridloom.sources.versions import without
from gridloom.sources.work import staged

KEYS = ["house_id", "phase"]
RISE, REACH = 500.0, 5


def crossed_waves(found: DataFrame, grid: DataFrame, reach: int = REACH, rise: float = RISE / 2) -> DataFrame:
    """Waves of a house's other phases that begin within ``reach`` minutes of a known wave's start, at half
    the rise: a device on several phases rises less on some. Waves known already are left out.

    Only the minutes that such a wave can touch are looked at: ``reach`` around the start and the longest
    wave behind it; minutes that belong together are one island of a series."""
    starts = found.select("house_id", F.col("phase").alias("of"), F.explode(F.sequence(F.col("start") - reach - 3, F.col("start") + reach + 46)).alias("m")).distinct()
    near = grid.join(starts, ["house_id", "m"]).where("phase <> of").select(*KEYS, "m", "watts").distinct()
    weak = kernels.find_waves(near, rise)
    close = found.select("house_id", F.col("phase").alias("of"), F.col("start").alias("known"))
    weak = weak.join(close, "house_id").where((F.col("phase") != F.col("of")) & (F.abs(F.col("start") - F.col("known")) <= reach)).select(*weak.columns).distinct()
    return weak.join(found.select(*KEYS, "start"), [*KEYS, "start"], "left_anti")


def wave_power(waves: DataFrame, grid: DataFrame) -> DataFrame:
    """(KEYS, m, taken): what each minute gives to the waves of its series: at most the wave's profile, its
    power over the baseline, and at most what the signal holds over the baseline. Of waves that meet in a
    minute the later one gets what the earlier left."""
    minutes = waves.select(*KEYS, "start", "baseline", F.explode(F.sequence("start", "end")).alias("m"))
    rows = minutes.join(grid.select(*KEYS, "m", "watts"), [*KEYS, "m"])
    want = F.greatest(F.col("watts") - F.col("baseline"), F.lit(0.0))
    return rows.groupBy(*KEYS, "m").agg(F.max(want).alias("taken"))  # profiles of one signal: the sum is the largest


def remaining_after(grid: DataFrame, power: DataFrame) -> DataFrame:
    """The signal without ``power`` (KEYS, m, taken)."""
    rows = grid.join(power.select(*KEYS, "m", "taken"), [*KEYS, "m"], "left")
    return rows.select(*KEYS, "m", (F.col("watts") - F.coalesce("taken", F.lit(0.0))).alias("watts"))


def check_waves(waves: DataFrame, before: DataFrame, after: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Adds ``valid`` to waves: nothing left under -tolerance, what is gone is what was taken, at most 30 % of
    the minutes inside give nothing, and the wave gives something."""
    minutes = waves.select(*KEYS, "start", "end", "baseline", F.explode(F.sequence("start", "end")).alias("m"))
    rows = minutes.join(before.select(*KEYS, "m", F.col("watts").alias("b")), [*KEYS, "m"], "left").join(after.select(*KEYS, "m", F.col("watts").alias("a")), [*KEYS, "m"], "left")
    gone = F.coalesce(F.col("b") - F.col("a"), F.lit(0.0))
    inner = F.col("m").between(F.col("start") + 1, F.col("end") - 1)
    want = F.greatest(F.col("b") - F.col("baseline"), F.lit(0.0))
    checked = rows.groupBy(*KEYS, "start").agg(
        F.coalesce(F.min("a"), F.lit(0.0)).alias("least"), F.max(F.abs(gone - F.coalesce(want, F.lit(0.0)))).alias("off"), F.sum(gone).alias("taken"),
        (F.count_if(inner & (gone <= 0)) / F.greatest(F.count_if(inner), F.lit(1))).alias("empty"),
    )
    valid = (F.col("least") >= -tolerance) & (F.col("off") <= tolerance) & (F.col("empty") <= 0.3) & (F.col("taken") > 0)
    return waves.join(checked.select(*KEYS, "start", "taken", valid.alias("valid")), [*KEYS, "start"])


def wave_records(waves: DataFrame) -> DataFrame:
    """Waves in the form of matches: the OFF is half the ON and a minute long, the tag ends by length, the id is a
    hash of what tells the wave apart."""
    minutes = F.col("end") - F.col("start")
    length = wave_tag(minutes)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("house_id", "phase", "start")])
    return waves.select(
        *KEYS, F.concat(F.lit("wave_"), F.substring(F.sha2(key, 256), 1, 8)).alias("on_id"), F.col("start").alias("on_start"), F.col("peak").alias("on_end"), (F.col("end") - 1).alias("off_start"), F.col("end").alias("off_end"),
        minutes.alias("minutes"), (F.col("peak_watts") - F.col("baseline")).alias("on_magnitude"), (-0.5 * (F.col("peak_watts") - F.col("baseline"))).alias("off_magnitude"), F.concat(F.lit("WAVE-"), length).alias("tag"),
    )


class Recovered(NamedTuple):
    """``waves`` with ``crossed``; what remains; ``checks`` are waves with ``valid``; ``records`` of valid waves and of
    repairs in the form of matches; ``matches`` without the replaced ones."""

    waves: DataFrame
    remaining: DataFrame
    checks: DataFrame
    records: DataFrame
    matches: DataFrame | None


def recover(grid: DataFrame, matches: DataFrame | None = None) -> Recovered:
    """Waves found, on other phases too, taken out and checked; then the holes that ``matches`` have torn are
    repaired, waves or not. Without waves and holes nothing changes."""
    own = staged(kernels.find_waves(grid).withColumn("crossed", F.lit(False)))
    waves = staged(own.unionByName(crossed_waves(own.drop("crossed"), grid).withColumn("crossed", F.lit(True))))
    after = staged(remaining_after(grid, wave_power(waves, grid)))
    checks = staged(check_waves(waves, grid, after))
    records = wave_records(checks.where("valid"))
    if matches is not None:
        left, repairs, gone = repair_holes(matches, after, tuple(KEYS))
        after = staged(left)
        records = records.unionByName(repairs.select(*records.columns))
        matches = without(matches, gone, [*KEYS, "iteration", "on_id"])
    return Recovered(waves, after, checks, records, matches)


def leads(sessions: DataFrame, factor: float = 0.6) -> DataFrame:
    """Sessions (cycles, avg_magnitude, avg_duration, magnitude_cv) of three or more alike cycles of 500 to
    3000 W and 3 to 30 minutes, with the threshold at which more of the kind are looked for."""
    good = (F.col("cycles") >= 3) & F.col("avg_magnitude").between(500, 3000) & F.col("avg_duration").between(3, 30) & (F.coalesce("magnitude_cv", F.lit(0.0)) <= 0.5)
    return sessions.where(good).withColumn("threshold", factor * F.col("avg_magnitude"))


def cycles_over(m: np.ndarray, watts: np.ndarray, threshold: float, difference: float = 350, shortest: int = 2, longest: int = 45) -> list[tuple[int, int, float]]:
    """(on minute, off minute, magnitude): rises of the threshold with the closest fall of like size that is
    ``shortest`` to ``longest`` minutes later and not taken yet."""
    d = np.diff(watts, prepend=np.nan)
    falls, out = np.flatnonzero(d <= -threshold), []
    free = np.ones(len(falls), bool)
    for i in np.flatnonzero(d >= threshold):
        wait = m[falls] - m[i]
        fits = free & (wait >= shortest) & (wait <= longest) & (np.abs(-d[falls] - d[i]) <= difference)
        if fits.any():
            k = int(np.flatnonzero(fits)[np.argmin(np.abs(-d[falls][fits] - d[i]))])
            free[k] = False
            out.append((int(m[i]), int(m[falls[k]]), float(min(d[i], -d[falls[k]]))))
    return out


#: Minutes of a bucket in which sessions and readings meet.
BUCKET = 240


def guided(grid: DataFrame, leads: DataFrame, margin: int = 10, factor: float = 0.6) -> DataFrame:
    """(house_id, phase, on_start, off_start, magnitude): cycles over ``factor`` of a lead's mean magnitude in its session and ``margin`` minutes
    around. ``leads`` (KEYS, start, end, avg_magnitude) in minutes. Off in the pipeline of old, so a query of its own.

    A session meets the minutes of the buckets that it touches, so a minute meets the sessions around it and
    no other; sessions that overlap each get the minutes that they share. Cycles that two of them find count once."""
    asked = leads.select(*KEYS, (F.col("avg_magnitude") * factor).alias("threshold"), (F.col("start") - margin).alias("lo"), (F.col("end") + margin).alias("hi"))
    asked = staged(asked.distinct().withColumn("lead", F.xxhash64(*KEYS, "lo", "hi", "threshold")))
    dealt_out = asked.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor(F.col("hi") / BUCKET))))
    minutes = grid.where(F.col("watts").isNotNull() & ~F.isnan("watts")).select(*KEYS, "m", "watts", F.floor(F.col("m") / BUCKET).alias("bucket"))
    near = dealt_out.join(minutes, [*KEYS, "bucket"]).where("m between lo and hi").select(*KEYS, "lead", "threshold", "m", "watts")
    find = lambda part: cycles_over(part["m"].astype(np.int64), part["watts"].astype(float), float(part["threshold"][0]))
    found = over_stretches(dealt(near, [*KEYS, "lead"]), [*KEYS, "lead"], ["m"], find, "on_start int, off_start int, magnitude double").drop("lead")
    first = W.partitionBy(*KEYS, "on_start").orderBy("off_start")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")

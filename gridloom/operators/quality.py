"""How good a house's readings are for finding devices: measures per phase, points, penalties, label.

Everything is windows and aggregates by (house, phase); only the counting of compressor cycles pairs
rows greedily. Readings are long: (house_id, phase, ts, event_id, watts), missing ones null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.profile import piecewise
from gridloom.operators.stretches import dealt, over_stretches
from gridloom.sources.tables import SERIES, by, ordered_mean

# Knots of the points (fixed values): x -> points, linear between.
SHARP_KNOTS = [(0.0, 0.0), (0.15, 3.0), (0.25, 8.0), (0.35, 13.0), (0.5, 18.0)]
SUSTAINED_KNOTS = [(0.0, 0.0), (0.5, 1.0), (2.0, 3.0), (5.0, 6.0), (9.0, 8.0)]
COMPRESSOR_KNOTS = [(0.0, 0.0), (2.0, 1.0), (6.0, 3.0), (15.0, 5.0), (35.0, 7.0)]
VARIATION_KNOTS = [(0.0, 0.0), (0.8, 4.0), (1.1, 8.0), (1.4, 12.0), (2.0, 17.0), (3.0, 20.0)]
DAYS_KNOTS = [(0.0, 0.0), (30.0, 3.0), (180.0, 7.0), (365.0, 10.0)]
TOP_SHARP = 20.0  # from a rate of 0.5
NEAR = 1e-9  # a mean of rates may miss one half by its last bit
DEAD_SHARE, FAULTY_MISSING = 0.02, 0.10


def phase_measures(series: DataFrame, threshold: float = 1300, sustained: tuple[float, int] = (2000, 20), least: int = 100) -> DataFrame:
    """One row per (house, phase): readings, missing ones, power, negatives, jumps over 2000 W, share beyond
    three deviations, share of threshold crossings by one sharp jump, runs of high power for ``sustained``
    rows per 10,000 readings (null under ``least`` readings), and shares of low and middling power."""
    w = by(*SERIES)
    known = series.where("watts is not null").withColumn("prev", F.lag("watts").over(w))
    stats = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # in order, as sums end in other digits else
    spread = F.stddev_samp("watts").over(stats)
    rows = known.withColumn("outlier", F.when(spread > 0, F.abs(F.col("watts") - F.avg("watts").over(stats)) > 3 * spread).otherwise(False))
    before = F.coalesce("prev", F.lit(0.0))
    crossed = (before < threshold) & (F.col("watts") >= threshold)
    rows = rows.withColumns({"crossed": crossed, "sharp": crossed & (F.col("watts") - before >= threshold), "high": F.col("watts") >= sustained[0]})
    rows = rows.withColumn("run", F.count_if(~F.col("high")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.where("high").groupBy(*SERIES, "run").agg(F.count("*").alias("n")).where(F.col("n") >= sustained[1]).groupBy(*SERIES).agg(F.count("*").alias("runs"))
    share = lambda c: F.avg(c.cast("double"))
    found = rows.groupBy(*SERIES).agg(
        F.count("*").alias("n_known"), F.sum("watts").alias("power"), F.count_if(F.col("watts") < 0).alias("n_negative"), F.count_if(F.abs(F.col("watts") - F.col("prev")) > 2000).alias("n_jumps"),
        share(F.col("outlier")).alias("outlier_share"), F.when(F.count_if("crossed") > 0, F.count_if("sharp") / F.count_if("crossed")).alias("sharp_rate"),
        share((F.col("watts") >= 500) & (F.col("watts") < 1000)).alias("mid_share"), share(F.col("watts") < 100).alias("low_share"), share(F.col("watts") >= 800).alias("high_share"), F.count_if(F.col("watts") > 20_000).alias("n_extreme"),
    )
    sizes = series.groupBy(*SERIES).agg(F.count("*").alias("n"))
    found = sizes.join(found, list(SERIES), "left").join(runs, list(SERIES), "left")
    density = F.when(F.col("n_known") >= least, F.coalesce("runs", F.lit(0)) / (F.col("n_known") / 10_000))
    found = found.withColumns({"missing_share": 1 - F.coalesce("n_known", F.lit(0)) / F.col("n"), "sustained": density, "power": F.coalesce("power", F.lit(0.0))}).drop("runs")
    house = W.partitionBy("house_id").orderBy("phase").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sisters = (F.sum("power").over(house) - F.col("power")) / F.nullif(F.count("*").over(house) - 1, F.lit(0))
    dead = F.coalesce((sisters > 0) & (F.col("power") < DEAD_SHARE * sisters), F.lit(False))
    return found.withColumn("dead", dead).withColumn("faulty", ~F.col("dead") & (F.col("missing_share") >= FAULTY_MISSING))


def compressor_cycles(diff: np.ndarray, least: float = 1300, most: float = 3000, apart: float = 0.30, shortest: int = 3, longest: int = 30) -> int:
    """Rises in [least, most] followed ``shortest`` to ``longest`` rows later by a fall that is alike and
    not taken yet."""
    taken, n = set(), 0
    for i in np.flatnonzero((diff >= least) & (diff <= most)):
        for j in range(i + shortest, min(i + longest + 1, len(diff))):
            if j not in taken and -diff[j] >= least and abs(-diff[j] / diff[i] - 1) <= apart:
                taken.add(j)
                n += 1
                break
    return n


def compressors(series: DataFrame, least: int = 100) -> DataFrame:
    """(house_id, month, phase, cycles, n): compressor cycles of every month, in order of (ts, event_id)."""
    keys = ["house_id", "month", "phase"]

    def count(part: dict) -> list[tuple]:
        watts = part["watts"].astype(float)
        watts = watts[~np.isnan(watts)]
        return [(compressor_cycles(np.diff(watts)) if len(watts) >= least else None, len(watts))]

    rows = series.select(*keys, "ts", "event_id", "watts")
    return over_stretches(dealt(rows, keys), keys, ["ts", "event_id"], count, "cycles long, n long")


def month_measures(series: DataFrame) -> DataFrame:
    """One row per house: how evenly its months are covered, and months without power."""
    month = F.date_trunc("month", "ts")
    minutes = series.groupBy("house_id", month.alias("of"), "ts").agg(F.sum("watts").alias("total"))
    months = minutes.groupBy("house_id", "of").agg(F.count("*").alias("n"), F.avg("total").alias("mean"))
    covered = F.least(F.col("n") / (F.day(F.last_day("of")) * 1440), F.lit(1.0))
    return months.groupBy("house_id").agg(F.count("*").alias("n_months"), F.stddev_pop(covered).alias("unevenness"), F.count_if((F.col("mean") < 1) & (F.col("n") > 100)).alias("n_dark_months"))


def house_measures(series: DataFrame) -> DataFrame:
    """One row per house: span, share of its minutes read, share of long gaps, and variation of the total."""
    minutes = series.groupBy("house_id", "ts").agg(F.sum("watts").alias("total"))
    gap = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(W.partitionBy("house_id").orderBy("ts")))) / 60
    rows = minutes.withColumn("gap", gap)
    span = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return rows.groupBy("house_id").agg(
        F.date_diff(F.max("ts"), F.min("ts")).cast("double").alias("days"), F.least(F.count("*") / (span / 60 + 1), F.lit(1.0)).alias("coverage"), (F.avg((F.col("gap") > 2).cast("double")) * 100).alias("long_gaps"),
        F.when(F.avg("total") > 0, F.stddev_samp("total") / F.avg("total")).otherwise(0.0).alias("variation"),
    )


def _taken(value: Column, most: float) -> Column:
    return F.greatest(F.least(value, F.lit(most)), F.lit(0.0))


def scores(series: DataFrame, cycles: DataFrame | None = None, least: int = 100) -> DataFrame:
    """One row per house: six kinds of points, penalties, the score (at least 0), flags and the label of
    faulty phases. ``cycles``: compressors() of the series; without it that kind gives no points."""
    phases = phase_measures(series, least=least)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = lambda c: ordered_mean(F.col(c), "phase")
    found = phases.groupBy("house_id").agg(
        zero(mean("sharp_rate")).alias("sharp_rate"), zero(mean("sustained")).alias("sustained"), zero(mean("mid_share")).alias("mid_share"), zero(mean("low_share")).alias("low_share"),
        zero(mean("high_share")).alias("high_share"), F.sum(zero(F.col("n_negative"))).alias("n_negative"), F.sum(zero(F.col("n_extreme"))).alias("n_extreme"), F.count_if("dead").alias("n_dead"), F.count_if("faulty").alias("n_faulty"),
        mean("missing_share").alias("missing"), F.max("missing_share").alias("most_missing"), F.count("sharp_rate").alias("n_crossing"),
    )
    found = found.join(house_measures(series), "house_id").join(month_measures(series), "house_id")
    if cycles is None:
        found = found.withColumn("cycles", F.lit(0.0))
    else:
        dense = cycles.groupBy("house_id", "phase").agg((F.sum("cycles") / (F.sum("n") / 10_000)).alias("d")).groupBy("house_id").agg(mean("d").alias("cycles"))
        found = found.join(dense, "house_id", "left").withColumn("cycles", zero(F.col("cycles")))
    c = F.col
    balance = F.when(c("n_months") > 1, F.greatest(5 * (1 - 2 * c("unevenness")), F.lit(0.0))).otherwise(5.0)
    lost = (1 - c("coverage")) * 100 + c("most_missing") * 100 * c("coverage")
    missing = c("missing") * 100
    points = {
        "sharp_points": F.when(c("n_crossing") == 0, 0.0).when(c("sharp_rate") >= 0.5 - NEAR, TOP_SHARP).otherwise(piecewise(c("sharp_rate"), SHARP_KNOTS)),
        "device_points": piecewise(c("sustained"), SUSTAINED_KNOTS) + piecewise(c("cycles"), COMPRESSOR_KNOTS),
        "profile_points": 20 - _taken((c("mid_share") - 0.10) / 0.25 * 15, 15) - _taken((0.15 - c("low_share")) / 0.15 * 5, 5),
        "variation_points": piecewise(c("variation"), VARIATION_KNOTS),
        "volume_points": F.least(piecewise(c("days"), DAYS_KNOTS) + balance, F.lit(15.0)),
        "integrity_points": F.greatest(
            10 - _taken(missing - 1, 4) - _taken((zero(c("long_gaps")) - 5) / 10 * 3, 3) - _taken((c("n_negative") - 100) / 500 * 3, 3) - _taken(c("n_extreme") / 50 * 2, 2) - _taken(c("n_dark_months") / c("n_months") * 10, 3), F.lit(0.0)
        ),
    }
    penalty = F.least(15.0 * c("n_dead"), F.lit(30.0)) + F.least(10.0 * c("n_faulty"), F.lit(20.0)) + F.when(c("coverage") < 0.5, 15.0).when(c("coverage") < 0.7, 8.0).otherwise(0.0)
    penalty = penalty + F.when(c("n_extreme") > 0, 5.0).otherwise(0.0) + F.when(c("high_share") > 0.40, 8.0).when(c("high_share") > 0.25, 4.0).otherwise(0.0) + F.when(lost >= 40, 10.0).when(lost >= 15, 5.0).otherwise(0.0)
    found = found.withColumns(points).withColumn("penalty", penalty)
    base = sum((c(p) for p in points), F.lit(0.0))
    limits = {"low_sharp_entry": ("sharp_points", 8), "low_device_signature": ("device_points", 4), "low_power_profile": ("profile_points", 10), "low_variability": ("variation_points", 8), "low_data_volume": ("volume_points", 7), "low_data_integrity": ("integrity_points", 5)}
    flags = F.concat_ws(",", *[F.when(c(p) < limit, name) for name, (p, limit) in limits.items()])
    label = F.when((c("n_dead") > 0) & (c("n_faulty") > 0), "faulty_both").when(c("n_dead") > 0, "faulty_dead_phase").when(c("n_faulty") > 0, "faulty_high_nan")
    continuity = F.when(lost < 5, "continuous").when(lost < 15, "minor_gaps").when(lost < 40, "discontinuous").otherwise("fragmented")
    score = F.greatest(base - c("penalty"), F.lit(0.0))
    tier = F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 50, "fair").otherwise("poor")
    return found.select("house_id", *points, "penalty", score.alias("score"), tier.alias("tier"), flags.alias("flags"), label.alias("label"), continuity.alias("continuity"))

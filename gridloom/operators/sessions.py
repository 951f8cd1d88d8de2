"""Sessions of events, their statistics, and scores over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.profile import medians


def sessionise(events: DataFrame, keys: list[str], start: str, end: str, gap: float, tie: str) -> DataFrame:
    """Adds ``session``: a new one where the start lies over ``gap`` past the previous row's end (not
    past the largest end so far). start and end are numbers."""
    order = W.partitionBy(*keys).orderBy(start, tie)
    fresh = F.when(F.col(start) - F.lag(end).over(order) <= gap, 0).otherwise(1)
    return events.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_fresh")


def split_at_long(events: DataFrame, keys: list[str], order: list[str], ratio: float = 3.0, least: float = 10.0) -> DataFrame:
    """Adds ``part``: a session of three or more events is split at its first event of number 2 to 4 that
    lasts at least ``least`` and ``ratio`` times the median of those before it."""
    w = W.partitionBy(*keys, "session").orderBy(*order)
    rows = events.withColumn("_n", F.count("*").over(W.partitionBy(*keys, "session"))).withColumn("_i", F.row_number().over(w))
    before = F.percentile("duration", F.lit(0.5)).over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = (F.col("_n") >= 3) & F.col("_i").between(2, 4) & (F.col("duration") >= least) & (F.col("duration") >= ratio * before)
    rows = rows.withColumn("_cut", F.when(cut, F.col("_i")))
    first = F.min("_cut").over(W.partitionBy(*keys, "session"))
    return rows.withColumn("part", F.when(F.col("_i") >= first, 1).otherwise(0)).drop("_n", "_i", "_cut")


def session_stats(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, session): extent, count, magnitudes with population variation, durations."""
    size = F.abs("magnitude")
    return events.groupBy(*keys, "session").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_events"), F.avg(size).alias("avg_magnitude"), F.max(size).alias("max_magnitude"),
        F.when(F.avg(size) > 0, F.stddev_pop(size) / F.avg(size)).alias("magnitude_cv"), F.avg("duration").alias("avg_duration"), F.count_distinct("threshold").alias("n_thresholds"),
    )


def spike_statistics(events: DataFrame, shortest: float = 2.0, long: float = 15.0) -> DataFrame:
    """Counts and minutes of spikes and of what is kept: in total, by iteration and by phase."""
    spike = F.col("duration") < shortest
    sets = events.groupingSets([[], ["iteration"], ["phase"]], "iteration", "phase")
    return sets.agg(
        F.count("*").alias("n_events"), F.count_if(spike).alias("n_spikes"), F.coalesce(F.sum(F.when(spike, F.col("duration"))), F.lit(0.0)).alias("spike_minutes"),
        F.coalesce(F.sum(F.when(~spike, F.col("duration"))), F.lit(0.0)).alias("kept_minutes"), F.count_if(~spike & (F.col("duration") < long)).alias("n_short"), F.count_if(F.col("duration") >= long).alias("n_long"),
    )


def linear_score(value, low: float, high: float):
    """0.5 at ``low`` and below, 1 at ``high`` and above."""
    return F.when(value <= low, 0.5).when(value >= high, 1.0).otherwise(0.5 + 0.5 * (value - low) / (high - low))


def match_tag(on, off, minutes, noisy=None, partial=None, corrected=None, tail=None):
    """``[NOISY|PARTIAL]-quality-duration[-CORRECTED][-TAIL]``; flags are boolean columns or None."""
    apart = F.abs(F.abs(on) - F.abs(off))
    quality = F.when(apart < 50, "EXACT").when(apart < 100, "CLOSE").when(apart < 200, "APPROX").otherwise("LOOSE")
    length = F.when(minutes <= 2, "SPIKE").when(minutes < 5, "QUICK").when(minutes <= 30, "MEDIUM").otherwise("EXTENDED")
    flag = lambda c, name: F.when(c, name) if c is not None else F.lit(None).cast("string")
    return F.concat_ws("-", F.coalesce(flag(partial, "PARTIAL"), flag(noisy, "NOISY")), quality, length, flag(corrected, "CORRECTED"), flag(tail, "TAIL"))


def robust_z(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds median, mad (0 counts as 1) and z of ``value`` within keys."""
    middle = medians(values, keys, value, "median")
    rows = values.join(middle, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    spread = medians(rows, keys, "_d", "mad")
    rows = rows.join(spread.withColumn("mad", F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad"))), keys)
    return rows.withColumn("z", (F.col(value) - F.col("median")) / F.col("mad")).drop("_d")


def signature_pairs(signatures: DataFrame, magnitude: float = 0.15, duration: float = 0.20) -> DataFrame:
    """Pairs of signatures of different houses whose magnitudes and durations differ by at most the
    given share of the larger one. Both lie in geometric buckets just over a tolerance wide, so a pair is in equal or
    neighbouring buckets of each, one exactly a tolerance apart too; zeros only pair with zeros and have their own."""
    cell = lambda c, share: F.when(F.col(c) > 0, F.floor(F.log(c) / (-F.log(F.lit(1 - share)) * (1 + 1e-9)))).otherwise(-1_000_000)
    dealt = signatures.where("magnitude >= 0 and duration >= 0").withColumns({"_b": cell("magnitude", magnitude), "_c": cell("duration", duration)})
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
    names = ("house_id", "pattern_id", "magnitude", "duration")
    a = dealt.select(*[F.col(c).alias(f"{c}_a") for c in names], around("_b"), "_c")
    a = a.select(*[f"{c}_a" for c in names], "_b", around("_c"))
    b = dealt.select(*[F.col(c).alias(f"{c}_b") for c in names], "_b", "_c")
    near = lambda x, limit: F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")) <= limit * F.greatest(f"{x}_a", f"{x}_b")
    return a.join(b, ["_b", "_c"]).where("house_id_a < house_id_b").where(near("magnitude", magnitude) & near("duration", duration)).drop("_b", "_c")

"""Cleaning and normalising a series with window frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.profile import medians
from gridloom.sources.tables import SERIES, by


def forward_fill(series: DataFrame, limit: int = 5, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Fills runs of at most ``limit`` missing readings with the last reading before the run; longer
    and leading runs stay missing. Adds ``run_length`` (0 outside of runs) and ``filled``."""
    w = by(*keys)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = series.withColumn("run", F.count("watts").over(upto))  # readings seen so far: constant in a run
    length = F.count_if(F.col("watts").isNull()).over(W.partitionBy(*keys, "run"))
    rows = rows.withColumn("run_length", F.when(F.col("watts").isNull(), length).otherwise(0))
    last = F.last("watts", ignorenulls=True).over(upto)
    return rows.withColumn("filled", F.coalesce("watts", F.when(F.col("run_length") <= limit, last))).drop("run")


def detrend(series: DataFrame, rows: int = 120, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Reading minus centred mean (half the rows before, the rest from here on) plus mean, at least 0."""
    near = by(*keys).rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    value = F.col("watts") - F.avg("watts").over(near) + F.avg("watts").over(W.partitionBy(*keys))
    return series.withColumn("detrended", F.greatest(value, F.lit(0.0)))


def balance_phases(series: DataFrame, month: str = "month") -> DataFrame:
    """Reading minus its phase's median in the month plus the mean of the phases' medians, at least 0."""
    found = medians(series, [month, "phase"], "watts", "phase_median")  # three a month
    found = found.withColumn("common", F.avg("phase_median").over(W.partitionBy(month)))
    return series.join(F.broadcast(found), [month, "phase"]).withColumn("balanced", F.greatest(F.col("watts") - F.col("phase_median") + F.col("common"), F.lit(0.0)))


def hampel(series: DataFrame, rows: int = 240, k: float = 5.0, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Replaces a reading by the centred median where it lies over k median deviations away, or
    anywhere away if that deviation is 0."""
    near = by(*keys).rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    out = series.withColumn("near_median", F.percentile("watts", F.lit(0.5)).over(near))
    out = out.withColumn("deviation", F.abs(F.col("watts") - F.col("near_median")))
    out = out.withColumn("mad", F.percentile("deviation", F.lit(0.5)).over(near))
    outlier = ((F.col("mad") > 0) & (F.col("deviation") > k * F.col("mad"))) | ((F.col("mad") == 0) & (F.col("deviation") > 0))
    return out.withColumn("cleaned", F.when(outlier, F.col("near_median")).otherwise(F.col("watts")))


NORMALISE = {"none": lambda s: s.withColumn("normalised", F.col("watts")), "ma_detrend": lambda s: detrend(s).withColumnRenamed("detrended", "normalised"), "phase_balance": lambda s: balance_phases(s).withColumnRenamed("balanced", "normalised"), "mad_clean": lambda s: hampel(s).withColumnRenamed("cleaned", "normalised")}


def combined(series: DataFrame) -> DataFrame:
    """Detrend, balance, then Hampel."""
    for step in ("ma_detrend", "phase_balance"):
        series = NORMALISE[step](series).withColumn("watts", F.col("normalised")).drop("normalised", "phase_median", "common")
    return NORMALISE["mad_clean"](series)


def normalise(series: DataFrame, method: str) -> DataFrame:
    """Adds ``normalised`` by the named method; an unknown name is an error."""
    if method == "combined":
        return combined(series)
    if method not in NORMALISE:
        raise ValueError(f"unknown normalisation {method!r}; known: {sorted([*NORMALISE, 'combined'])}")
    return NORMALISE[method](series.where("watts is not null"))


def rolling_z(series: DataFrame, seconds: int = 86_400, limit: float = 3.0, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Score against mean and sample deviation of the readings in the right-closed time range."""
    epoch = series.withColumn("at", F.unix_timestamp("ts"))
    near = W.partitionBy(*keys).orderBy("at").rangeBetween(-(seconds - 1), 0)
    spread = F.stddev_samp("watts").over(near)
    z = F.when(spread > 0, (F.col("watts") - F.avg("watts").over(near)) / spread)
    return epoch.withColumn("z", z).withColumn("anomalous", F.coalesce(F.abs(F.col("z")) > limit, F.lit(False)))


def flat_runs(series: DataFrame, tolerance: float = 10, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Runs of rows that differ from the row before by at most the tolerance."""
    w = by(*keys)
    step = F.abs(F.col("watts") - F.lag("watts").over(w))
    rows = series.withColumn("fresh", F.when(step <= tolerance, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.count("*").alias("n_rows"), F.min("ts").alias("start"), F.max("ts").alias("end"))

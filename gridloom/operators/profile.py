"""Profiles of a series: coverage, power, imbalance, time patterns, decomposition, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.sources.tables import by


def coverage(series: DataFrame, keys: tuple[str, ...] = ("house_id",), limit: float = 20_000) -> DataFrame:
    """Readings, missing ones, span, gaps between readings in minutes, repeated times (every copy
    counts), longest missing run, and readings over ``limit``."""
    w = by(*keys)
    rows = series.withColumn("gap", (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))) / 60)
    rows = rows.withColumn("copies", F.count("*").over(W.partitionBy(*keys, "ts"))).withColumn("run", F.count("watts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("run_length", F.count_if(F.col("watts").isNull()).over(W.partitionBy(*keys, "run")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_readings"), F.count_if(F.col("watts").isNull()).alias("n_missing"), F.date_diff(F.max("ts"), F.min("ts")).cast("long").alias("span_days"),
        F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > 2).alias("n_gaps"), F.count_if(F.col("copies") > 1).alias("n_repeated_times"),
        F.max("run_length").alias("longest_missing"), F.count_if(F.col("watts") > limit).alias("n_anomalies"),
    )


def power_statistics(series: DataFrame, keys: tuple[str, ...] = ("house_id", "phase"), limits: tuple[int, ...] = (800, 1100, 1500, 2000)) -> DataFrame:
    """Mean, largest, and share of readings at or over each limit, with the phase's share of energy."""
    found = series.groupBy(*keys).agg(F.avg("watts").alias("avg_watts"), F.max("watts").alias("max_watts"), F.sum("watts").alias("sum_watts"), *[F.avg((F.col("watts") >= n).cast("double")).alias(f"share_{n}") for n in limits])
    return found.withColumn("energy_share", F.col("sum_watts") / F.sum("sum_watts").over(W.partitionBy(*keys[:-1])))


def imbalance(wide: DataFrame, phases: tuple[str, ...] = ("w1", "w2", "w3")) -> DataFrame:
    """Adds the population deviation of a row's phases over their mean (null at mean 0)."""
    values = F.array(*[F.coalesce(F.col(p), F.lit(0.0)) for p in phases])
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(phases)
    rows = wide.withColumn("_mean", mean)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    return rows.withColumn("imbalance", F.when(F.col("_mean") > 0, F.sqrt(squares / len(phases)) / F.col("_mean"))).drop("_mean")


def day_and_night(series: DataFrame, keys: tuple[str, ...] = ("house_id",)) -> DataFrame:
    """Means from 6 to 22 o'clock and outside."""
    day = F.hour("ts").between(6, 21)
    return series.groupBy(*keys).agg(F.avg(F.when(day, F.col("watts"))).alias("day_watts"), F.avg(F.when(~day, F.col("watts"))).alias("night_watts"))


def heatmap(series: DataFrame) -> DataFrame:
    """Mean by weekday (Monday 0) and hour, an hour per column, 0 where nothing was read."""
    return series.groupBy(F.weekday("ts").alias("weekday")).pivot("hour", list(range(24))).agg(F.avg("watts")).na.fill(0.0) if "hour" in series.columns else heatmap(series.withColumn("hour", F.hour("ts")))


def by_period(series: DataFrame) -> DataFrame:
    """Mean and energy by year, by month of a year, and in all; flags periods without power."""
    rows = series.select(F.year("ts").alias("year"), F.month("ts").alias("month_no"), "watts")
    return rows.rollup("year", "month_no").agg(F.avg("watts").alias("avg_watts"), F.sum("watts").alias("sum_watts"), F.count("*").alias("n"), (F.coalesce(F.max("watts"), F.lit(0.0)) <= 0).alias("no_power"))


def decomposition(signal: DataFrame, keys: tuple[str, ...], threshold: float) -> DataFrame:
    """Of (original, remaining): explained, background (5th percentile at all times), improvable, and the
    rest over and under the threshold; efficiency is explained over explained plus over-threshold."""
    both = signal.where("original is not null and remaining is not null").select(*keys, F.greatest("original", F.lit(0.0)).alias("o"), F.greatest("remaining", F.lit(0.0)).alias("r"))
    base = both.groupBy(*keys).agg(F.percentile("o", F.lit(0.05)).alias("p5"))
    rows = both.join(base, list(keys)).withColumn("above", F.greatest(F.col("r") - F.col("p5"), F.lit(0.0)))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("o").alias("original"), F.sum(F.greatest(F.col("o") - F.col("r"), F.lit(0.0))).alias("explained"), F.first("p5").alias("p5"), F.sum("r").alias("remaining"),
        F.coalesce(F.sum(F.when(F.col("above") > threshold, F.col("above"))), F.lit(0.0)).alias("over"), F.coalesce(F.sum(F.when(F.col("above") <= threshold, F.col("above"))), F.lit(0.0)).alias("under"),
    )
    found = found.withColumn("background", F.col("p5") * F.col("n")).withColumn("improvable", F.greatest(F.col("remaining") - F.col("background"), F.lit(0.0)))
    return found.withColumn("efficiency", F.when(F.col("explained") + F.col("over") > 0, F.col("explained") / (F.col("explained") + F.col("over")) * 100))


def piecewise(value: F.Column, knots: list[tuple[float, float]]) -> F.Column:
    """Linear between the knots (x, points), constant outside."""
    out = F.when(value <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(value <= x1, y0 + (value - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(knots[-1][1])


def _at_ranks(values: DataFrame, keys: list[str], value: str, ranks: list[str]) -> DataFrame:
    """(keys, k, v): the values at the ranks (SQL over ``n``, from 0) among the key's known values.

    In two levels: values are counted by bucket of their range, the buckets that hold the ranks are found from
    the counts (at most 1024 a key), and only their values are ranked, by distinct value. So no task
    holds all values of a key."""
    w = W.partitionBy(*keys)
    known = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    ends = known.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    bucket = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * 1023)).otherwise(0)
    dealt = known.join(ends, keys).withColumn("bucket", bucket)
    sizes = dealt.groupBy(*keys, "bucket").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    before = F.coalesce(F.sum("size").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(r).cast("long").alias("rank")) for k, r in enumerate(ranks)]))
    chosen = sizes.withColumn("before", before).select(*keys, "bucket", "before", "size", asked.alias("a")).where("before <= a.rank and a.rank < before + size")
    chosen = chosen.select(*keys, "bucket", "a.k", (F.col("a.rank") - F.col("before")).alias("rank"))
    inside = dealt.join(chosen, [*keys, "bucket"]).groupBy(*keys, "k", "rank", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys, "k").orderBy("v"))
    return inside.withColumn("upto", upto).where("rank < upto").groupBy(*keys, "k").agg(F.min("v").alias("v"))


def middle_of(values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the element in the middle of the sorted values, the upper one of an even number."""
    return _at_ranks(values, keys, value, ["n div 2"]).select(*keys, F.col("v").alias(name))


def medians(values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the exact median, the mean of both middle values of an even number."""
    return _at_ranks(values, keys, value, ["(n - 1) div 2", "n div 2"]).groupBy(*keys).agg(F.avg("v").alias(name))

"""Aggregates under the reports: shares, runs, windows, evaluation, months, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.cleaning import flat_runs, rolling_z
from gridloom.operators.joins import overlaps
from gridloom.sources.tables import SERIES, by


def flat_share(series: DataFrame, tolerance: float = 10, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Share of readings in runs of two or more that differ by at most the tolerance from the one before."""
    runs = flat_runs(series, tolerance, keys)
    return runs.groupBy(*keys).agg(F.sum("n_rows").alias("n"), (F.sum(F.when(F.col("n_rows") > 1, F.col("n_rows")).otherwise(0)) / F.sum("n_rows") * 100).alias("flat_share"))


def anomalous_runs(series: DataFrame, seconds: int = 86_400, limit: float = 3.0, least: int = 5, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Runs of ``least`` or more successive readings over ``limit`` deviations from the last day's mean."""
    w = by(*keys)
    rows = rolling_z(series, seconds, limit, keys)
    rows = rows.withColumn("run", F.count_if(~F.col("anomalous")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("anomalous")
    found = rows.groupBy(*keys, "run").agg(F.count("*").alias("n_rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.max(F.abs("z")).alias("max_z"))
    return found.where(F.col("n_rows") >= least).drop("run")


def in_window(rows: DataFrame, ts: str, day: str, kind: str) -> DataFrame:
    """Rows of a closed range: ``day`` from 6 to 18 o'clock of the date, ``night`` from 18 to 6 the next."""
    start = F.to_timestamp(F.lit(day)) + F.expr(f"interval {6 if kind == 'day' else 18} hours")
    return rows.where(F.col(ts).between(start, start + F.expr("interval 12 hours")))


def around(sessions: DataFrame, readings: DataFrame, margin: int = 3600) -> DataFrame:
    """(id, points): the readings of a session's series from ``margin`` seconds before its start to as many
    after its end, each with whole watts and whether it lies in the session, in order of time."""
    asked = sessions.select("house_id", "phase", "id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    points = readings.select("house_id", "phase", F.col("at").alias("r_start"), F.col("at").alias("r_end"), "watts")
    near = overlaps(asked, points, ["house_id", "phase"], margin, 86_400)
    inside = F.col("r_start").between(F.col("l_start"), F.col("l_end"))
    point = F.struct(F.col("r_start").alias("at"), F.round("watts").cast("long").alias("watts"), F.when(inside, "ses").otherwise("oth").alias("kind"))
    return near.groupBy("id").agg(F.sort_array(F.collect_list(point)).alias("points"))  # a session and two margins


def segments_of(sessions: DataFrame, anchor: int = 6 * 3600, length: int = 12 * 3600) -> DataFrame:
    """(id, segment): the half-day segments, from 6 and 18 o'clock, that a session lies in."""
    number = lambda c: F.floor((F.col(c) - anchor) / length)
    return sessions.withColumn("segment", F.explode(F.sequence(number("start"), number("end")))).withColumn("segment", F.col("segment") * length + anchor)


def evaluation(baseline: DataFrame, current: DataFrame, previous: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """By phase: power over the threshold that this run and all runs so far explain, minutes, negatives and
    missing minutes. Tables are (keys, phase, watts); of repeated keys the first ``id`` counts."""
    first = lambda df, name: df.groupBy(*keys, "phase").agg(F.min_by("watts", "id").alias(name))
    rows = first(baseline, "base").join(first(current, "now"), [*keys, "phase"], "left").join(first(previous, "before"), [*keys, "phase"], "left")
    over = lambda c: F.coalesce(F.sum(F.when(F.col("base") > threshold, c)), F.lit(0.0))
    return rows.groupBy("phase").agg(
        F.count("*").alias("minutes"), F.count_if(F.col("base") > threshold).alias("minutes_over"), over(F.col("base") - F.col("now")).alias("explained"), over(F.col("before") - F.col("now")).alias("explained_now"),
        F.count_if(F.col("now") < 0).alias("n_negative"), F.count_if(F.col("now").isNull()).alias("n_missing"),
    )


def month_rates(rows: DataFrame) -> DataFrame:
    """(house_id, month, matched) -> one row per month: mean, extremes and deviation of the houses' match
    rates, how many are problematic (under 0.4) and good (0.6 or more), and the problematic houses."""
    rates = rows.groupBy("house_id", "month").agg(F.avg(F.col("matched").cast("double")).alias("rate"))
    bad = F.when(F.col("rate") < 0.4, F.col("house_id"))
    return rates.groupBy("month").agg(
        F.count("*").alias("n_houses"), F.avg("rate").alias("mean"), F.min("rate").alias("least"), F.max("rate").alias("most"), F.stddev_pop("rate").alias("spread"),
        F.count(bad).alias("n_problem"), F.count_if(F.col("rate") >= 0.6).alias("n_good"), F.array_join(F.array_sort(F.collect_list(bad)), ",").alias("problem_houses"),
    )


def grades(seg: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per house. ``seg`` (house_id, phase, power, share): a phase under 1 % of the largest is
    damaged and counts as 0; ``rates`` (house_id, first_rate, change, n_negative). Scores 0.7 matching and
    0.3 segmentation, a category, and its place in the report's order."""
    damaged = F.col("power") < 0.01 * F.max("power").over(W.partitionBy("house_id"))
    phases = seg.withColumn("damaged", damaged).groupBy("house_id").agg(F.count_if("damaged").alias("n_damaged"), (F.sum(F.when(~F.col("damaged"), F.col("share")).otherwise(0.0)) / 3).alias("share"))
    rows = phases.join(rates, "house_id")
    matching = F.when(F.col("change") > 0, F.least(F.lit(100.0), F.col("first_rate") * 100 + F.col("change") * 50)).otherwise(F.col("first_rate") * 100)
    segmentation = F.greatest(F.col("share") * 100 - F.least(F.lit(20.0), F.col("n_negative") * 0.5), F.lit(0.0))
    rows = rows.withColumns({"matching": matching, "segmentation": segmentation}).withColumn("score", 0.7 * F.col("matching") + 0.3 * F.col("segmentation"))
    category = F.when(F.col("n_damaged") >= 2, "DAMAGED").when(F.col("score") >= 80, "EXCELLENT").when(F.col("score") >= 60, "GOOD").when(F.col("score") >= 40, "FAIR").otherwise("POOR")
    rows = rows.withColumn("category", category)
    place = F.array_position(F.array(*[F.lit(x) for x in ("EXCELLENT", "GOOD", "FAIR", "POOR", "DAMAGED")]), F.col("category"))
    return rows.withColumn("place", place).select("house_id", "n_damaged", "matching", "segmentation", "score", "category", "place")


def wave_windows(series: DataFrame, least: float = 800, most: float = 4000, shortest: int = 30, longest: int = 180, lags: range = range(3, 31)) -> DataFrame:
    """Runs of ``shortest`` to ``longest`` rows between two powers, with the lag at which their differences
    correlate best with themselves, and how well: (SERIES, start, n, lag, peak)."""
    w = by(*SERIES)
    inside = F.coalesce(F.col("watts").between(least, most), F.lit(False))
    rows = series.withColumn("inside", inside).withColumn("run", F.count_if(~F.col("inside")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("inside")
    run = W.partitionBy(*SERIES, "run")
    order = run.orderBy("ts", "event_id")
    rows = rows.withColumn("n", F.count("*").over(run)).where(F.col("n").between(shortest, longest)).withColumn("start", F.min("ts").over(run))
    rows = rows.withColumn("d", F.col("watts") - F.lag("watts").over(order))
    shifted = rows.select(*SERIES, "run", "start", "n", "d", F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("d", k).over(order).alias("past")) for k in lags]).alias("all"))
    found = shifted.select(*SERIES, "run", "start", "n", "d", F.explode("all").alias("x")).groupBy(*SERIES, "run", "start", "n", "x.lag").agg(F.corr("d", "x.past").alias("peak"), F.count("x.past").alias("pairs"))
    best = found.where("pairs >= 3 and peak is not null and not isnan(peak)").groupBy(*SERIES, "run", "start", "n").agg(F.max(F.struct("peak", (-F.col("lag")).alias("lag"))).alias("best"))
    return best.select(*SERIES, "start", "n", (-F.col("best.lag")).alias("lag"), F.col("best.peak").alias("peak"))


def wave_score(windows: DataFrame) -> DataFrame:
    """By series: windows, the peaks' mean weighted by length, and the season with most of the minutes."""
    warm = F.month("start").between(5, 10)
    found = windows.groupBy(*SERIES).agg(F.count("*").alias("n_windows"), (F.sum(F.greatest("peak", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("score"), F.sum(F.when(warm, F.col("n")).otherwise(0)).alias("warm"), F.sum("n").alias("all"))
    return found.select(*SERIES, "n_windows", "score", F.when(F.col("warm") * 2 >= F.col("all"), "warm").otherwise("cool").alias("season"))


def duration_bucket(minutes: Column) -> Column:
    return F.when(minutes <= 2, "short").when(minutes < 25, "medium").otherwise("long")


def month_of_name(name: Column) -> dict[str, Column]:
    """House, month and year of a file name ``{house}_{MM}_{YYYY}``; nulls if it is none."""
    part = lambda n: F.regexp_extract(name, r"^(.+)_([0-9]{2})_([0-9]{4})\.[a-z]+$", n)
    return {"house": F.nullif(part(1), F.lit("")), "month": F.nullif(part(2), F.lit("")).cast("int"), "year": F.nullif(part(3), F.lit("")).cast("int")}


def updated(stored: DataFrame, fresh: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``stored`` with ``value`` taken from ``fresh`` where it has the key, else as it was."""
    new = fresh.select(*keys, F.col(value).alias("_new"))
    return stored.join(new, keys, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs, however deep, as columns of their own, named by their path."""
    while nested := [n for n, t in df.dtypes if t.startswith("struct<")]:
        inner = lambda c: [F.col(f"`{c}`.`{f.name}`").alias(f"{c}{sep}{f.name}") for f in df.schema[c].dataType.fields]  # noqa: E731, B023
        df = df.select(*[x for c in df.columns for x in (inner(c) if c in nested else [F.col(f"`{c}`")])])
    return df

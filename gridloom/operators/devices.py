"""What is left over, device classes and how far to trust them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.edges import at_minute, differences, near_edges, was_read
from gridloom.operators.joins import band_join, overlaps

KEYS = ["house_id", "phase"]


def remaining_events(grid: DataFrame, threshold: float = 300, shortest: int = 3, longest: int = 1440) -> DataFrame:
    """Stretches of minutes that stay ``threshold`` over the series' 5th percentile, with their shape:
    a spike is under 5 minutes; cycling crosses its median 6 times or more; flat varies by under 15 %."""
    base = grid.groupBy(*KEYS).agg(F.percentile("watts", F.lit(0.05)).alias("base"))
    over = grid.join(base, KEYS).withColumn("above", F.col("watts") - F.col("base")).where(F.col("above") >= threshold)
    w = W.partitionBy(*KEYS).orderBy("m")
    over = over.withColumn("region", F.col("m") - F.row_number().over(w))
    inside = W.partitionBy(*KEYS, "region")
    over = over.withColumn("side", F.signum(F.col("above") - F.percentile("above", F.lit(0.5)).over(inside)))
    over = over.withColumn("crossed", (F.col("side") != F.lag("side").over(inside.orderBy("m"))).cast("long"))
    found = over.groupBy(*KEYS, "region").agg(
        F.min("m").alias("start"), F.max("m").alias("end"), F.count("*").alias("minutes"), F.avg("above").alias("avg_above"), F.max("above").alias("max_above"),
        (F.sum("above") / 60).alias("watt_hours"), F.coalesce(F.sum("crossed"), F.lit(0)).alias("crossings"), (F.stddev_pop("above") / F.avg("above")).alias("cv"),
    )
    shape = F.when(F.col("minutes") < 5, "spike").when(F.col("crossings") >= 6, "cycling").when(F.col("cv") < 0.15, "flat").otherwise("gradual")
    return found.where(F.col("minutes").between(shortest, longest)).withColumn("shape", shape).drop("region", "cv")


def extend_tails(edges: DataFrame, grid: DataFrame, minutes: int = 10, noise: float = 30, least_gain: float = 100, residual: float = 100, share: float = 0.05, keys: tuple[str, ...] = ("house_id", "phase")) -> DataFrame:
    """Moves the end of OFF edges (keys, start, end, magnitude) along falling minutes: each may exceed the
    one before by ``noise``; the walk ends at a gap or under ``residual`` watts. Kept if it gains
    ``least_gain``, starting from a residual of at least ``residual`` and ``share`` of the magnitude.
    A fold over the next minutes of every edge."""
    end = F.col("end")
    rows = near_edges(edges, differences(grid, keys), keys, F.sequence(end, end + minutes))
    rows = rows.withColumns({"at_end": at_minute(end), "next": F.when(was_read(end), F.filter("near", lambda x: x["m"] > end))})
    walk = F.expr(
        f"""aggregate(next, named_struct('m', `end`, 'watts', at_end, 'live', true),
        (s, x) -> CASE WHEN s.live AND x.m = s.m + 1 AND x.watts <= s.watts + {float(noise)}D
          THEN named_struct('m', x.m, 'watts', x.watts, 'live', x.watts >= {float(residual)}D) ELSE named_struct('m', s.m, 'watts', s.watts, 'live', false) END)"""
    )
    rows = rows.withColumn("walk", walk)
    gain = F.col("at_end") - F.col("walk.watts")
    taken = F.coalesce((F.col("at_end") >= residual) & (F.col("at_end") >= share * F.abs("magnitude")) & (gain >= least_gain), F.lit(False))
    return rows.select(
        *keys, "start", F.when(taken, F.col("walk.m")).otherwise(F.col("end")).alias("end"),
        F.when(taken, F.col("magnitude") - gain).otherwise(F.col("magnitude")).alias("magnitude"), taken.alias("tail_extended"), F.when(taken, F.col("end")).alias("original_end"),
    )


def boiler_candidates(events: DataFrame, minutes: float = 15, watts: float = 1500, apart: int = 1800) -> DataFrame:
    """Long, strong runs (id, start, duration, magnitude) with no run of 3 to 30 minutes starting within
    ``apart`` seconds in the series, other long strong ones aside."""
    large = (F.col("duration") >= minutes) & (F.abs("magnitude") >= watts)
    candidates = events.where(large)
    others = events.where(~large & F.col("duration").between(3, 30)).select(*KEYS, F.col("start").alias("other_start"))
    near = band_join(candidates.select(*KEYS, "id", "start"), others, KEYS, "start", "other_start", apart, apart)
    return candidates.join(near.select("id").distinct(), "id", "left_anti")


def simultaneous(events: DataFrame, minutes: float = 15, ratio: float = 2.0, share: float = 0.5) -> DataFrame:
    """Pairs of long runs in one house on different phases, durations at most ``ratio`` apart, that
    overlap by at least ``share`` of the shorter: (l_id, r_id, overlap seconds)."""
    long = events.where(F.col("duration") >= minutes)
    side = lambda p: long.select("house_id", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "phase", "start", "end", "duration")])
    pairs = overlaps(side("l"), side("r"), ["house_id"], 0, 86_400).where("l_phase < r_phase")
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    shorter, longer = F.least("l_duration", "r_duration"), F.greatest("l_duration", "r_duration")
    return pairs.withColumn("overlap", shared).where((longer <= ratio * shorter) & (F.col("overlap") >= share * shorter * 60)).select("l_id", "r_id", "overlap")


def device_quality(events: DataFrame) -> DataFrame:
    """Per device type: share of all days it is seen on, magnitude variation, share of its main phase,
    duration quartiles, and runs that start before the one before ends."""
    w = W.partitionBy("house_id", "device_type").orderBy("start", "id")
    rows = events.withColumn("overlaps", (F.lead("start").over(w) < F.col("end")).cast("long")).withColumn("day", F.floor(F.col("start") / 86_400))
    days = rows.agg(F.count_distinct("day")).first()[0]
    phases = rows.groupBy("device_type", "phase").agg(F.count("*").alias("n")).groupBy("device_type").agg((F.max("n") / F.sum("n")).alias("main_phase_share"))
    found = rows.groupBy("device_type").agg(
        F.count("*").alias("n_events"), F.count_distinct("day").alias("days"), (F.stddev_pop("magnitude") / F.avg("magnitude")).alias("magnitude_cv"),
        F.percentile("duration", F.lit(0.25)).alias("q1"), F.percentile("duration", F.lit(0.75)).alias("q3"), F.coalesce(F.sum("overlaps"), F.lit(0)).alias("n_overlaps"),
    )
    return found.join(phases, "device_type").withColumn("temporal", F.col("days") / F.lit(float(max(days, 1)))).drop("days")


def autocorrelation(grid: DataFrame, lags: range) -> DataFrame:
    """Correlation of a series' diffs with themselves ``lag`` rows before."""
    w = W.partitionBy(*KEYS).orderBy("m")
    rows = grid.withColumn("d", F.col("watts") - F.lag("watts").over(w))
    shifted = rows.select(*KEYS, "d", F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("d", k).over(w).alias("past")) for k in lags]).alias("all"))
    found = shifted.select(*KEYS, "d", F.explode("all").alias("x"))
    return found.groupBy(*KEYS, F.col("x.lag").alias("lag")).agg(F.corr("d", "x.past").alias("correlation"))


def _plain(df: DataFrame, c: str) -> F.Column:
    """Doubles to two places, NaN and infinities as null."""
    kind = dict(df.dtypes)[c]
    ends = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (F.abs(c) < ends), F.round(c, 2)).alias(c) if kind == "double" else F.col(c)


def session_documents(stats: DataFrame) -> DataFrame:
    """A JSON document per house and month: its sessions in order of start."""
    month = F.date_format(F.timestamp_seconds("start"), "yyyy-MM").alias("month")
    body = F.struct("start", *[_plain(stats, n) for n in stats.columns if n not in ("house_id", "start")])
    return stats.groupBy("house_id", month).agg(F.to_json(F.struct(F.sort_array(F.collect_list(body)).alias("sessions"))).alias("document"))


def breakdown(events: DataFrame) -> DataFrame:
    """A JSON document per house: counts, minutes and mean magnitude by device type."""
    by_type = events.groupBy("house_id", "device_type").agg(F.count("*").alias("count"), F.sum("duration").alias("minutes"), (F.floor(F.avg(F.abs("magnitude")) * 100 + 0.50001) / 100).alias("avg_magnitude"))
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct("device_type", F.struct("count", "minutes", "avg_magnitude")))))  # an entry per type
    return by_type.groupBy("house_id").agg(F.to_json(entry).alias("summary"), F.sum("count").alias("n_events"))

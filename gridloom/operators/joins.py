"""Band, nearest and overlap joins on intervals, always over a time-bucket equi key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, before: float, after: float) -> DataFrame:
    """Pairs of rows of equal keys with right_at in [left_at - before, left_at + after] (numbers).

    Rows of the right side lie in buckets as wide as the band; a left row looks into the two or three
    buckets that its band touches, so the join is an equi-join on (keys, bucket)."""
    width = max(before + after, 1)
    low, high = F.floor((F.col(left_at) - before) / width), F.floor((F.col(left_at) + after) / width)
    dealt = left.withColumn("_bucket", F.explode(F.sequence(low, high)))
    found = right.withColumn("_bucket", F.floor(F.col(right_at) / width))
    near = (F.col(right_at) >= F.col(left_at) - before) & (F.col(right_at) <= F.col(left_at) + after)
    return dealt.join(found, [*keys, "_bucket"]).where(near).drop("_bucket")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tolerance: float, left_id: str, right_id: str) -> DataFrame:
    """As-of join: every left row with its nearest right row within the tolerance, if any (else nulls);
    ties go to the earlier right row, then the smaller id."""
    pairs = band_join(left.select(*keys, left_id, left_at), right.select(*keys, right_id, right_at), keys, left_at, right_at, tolerance, tolerance)
    order = F.struct(F.abs(F.col(right_at) - F.col(left_at)).alias("distance"), F.col(right_at), F.col(right_id))
    best = pairs.groupBy(left_id).agg(F.min(order).alias("_best")).select(left_id, f"_best.{right_id}", f"_best.{right_at}", "_best.distance")
    return left.join(best, left_id, "left")


def without_near(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tolerance: float, left_id: str) -> DataFrame:
    """Left rows with no right row within the tolerance."""
    near = band_join(left.select(*keys, left_id, left_at), right.select(*keys, right_at), keys, left_at, right_at, tolerance, tolerance)
    return left.join(near.select(left_id).distinct(), left_id, "left_anti")


def match_candidates(on: DataFrame, off: DataFrame, keys: list[str], max_minutes: float = 360, max_difference: float = 350) -> DataFrame:
    """ON and OFF edges that could belong together: the OFF starts after the ON ends, within the time
    limit, and magnitudes differ by at most ``max_difference``. Adds minutes, difference and the
    first of the progressive windows that holds the pair. Times are minutes."""
    pairs = band_join(on, off, keys, "on_end", "off_start", 0, max_minutes).where("off_start > on_end")
    pairs = pairs.withColumn("minutes", F.col("off_start") - F.col("on_end")).withColumn("difference", F.abs(F.abs("on_magnitude") - F.abs("off_magnitude")))
    stage = F.when(F.col("minutes") <= 15, 15).when(F.col("minutes") <= 30, 30).when(F.col("minutes") <= 60, 60).when(F.col("minutes") <= 120, 120).when(F.col("minutes") <= 240, 240).otherwise(360)
    return pairs.where(F.col("difference") <= max_difference).withColumn("window", stage)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """For every ON the candidate of the smallest window, then difference, then time, then id."""
    order = W.partitionBy("on_id").orderBy("window", "difference", "minutes", "off_id")
    return candidates.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], slack: float = 0, span: float = 1440) -> DataFrame:
    """Pairs of intervals (l_start, l_end), (r_start, r_end) of equal keys that overlap when widened by
    ``slack``. An interval is dealt into all buckets of ``span`` that it touches; a pair counts in
    the first bucket that both touch."""
    deal = lambda df, s, e: df.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(s) - slack) / span), F.floor((F.col(e) + slack) / span))))
    pairs = deal(left, "l_start", "l_end").join(deal(right, "r_start", "r_end"), [*keys, "_bucket"])
    first = F.floor(F.greatest(F.col("l_start") - slack, F.col("r_start") - slack) / span)
    return pairs.where((F.col("l_start") <= F.col("r_end") + slack) & (F.col("r_start") <= F.col("l_end") + slack) & (F.col("_bucket") == first)).drop("_bucket")


def near_counts(events: DataFrame, keys: list[str], at: str, width: float) -> DataFrame:
    """Adds the number of other rows of the key within ``width`` on either side."""
    near = W.partitionBy(*keys).orderBy(at).rangeBetween(-width, width)
    return events.withColumn("n_near", F.count("*").over(near) - 1)

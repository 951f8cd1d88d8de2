"""Edges of a power series and the algebra of the intervals they open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.sources.tables import SERIES, by
from gridloom.sources.work import merged


def with_diff(series: DataFrame, keys: tuple[str, ...] = SERIES, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds prev (the reading before, by row) and diff."""
    w = by(*keys, order=order)
    return series.withColumn("prev", F.lag("watts").over(w)).withColumn("diff", F.col("watts") - F.col("prev"))


def sharp_edges(series: DataFrame, threshold: float, off_factor: float = 0.8, keys: tuple[str, ...] = SERIES, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Runs of consecutive rows whose diff is at least the threshold (on) or at most minus its integer
    share (off): (keys, event, start, end, n_rows, magnitude); magnitude is the sum of the diffs."""
    off = -int(threshold * off_factor)
    event = F.when(F.col("diff") >= threshold, "on").when(F.col("diff") <= off, "off")
    w = by(*keys, order=order)
    rows = with_diff(series, keys, order).withColumn("event", event)
    rows = rows.withColumn("fresh", F.when(F.col("event").eqNullSafe(F.lag("event").over(w)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    at = order[0]
    return rows.where("event is not null").groupBy(*keys, "run", "event").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_rows"), F.sum("diff").alias("magnitude")).drop("run")


def near_edges(edges: DataFrame, grid: DataFrame, keys: tuple[str, ...], minutes: F.Column) -> DataFrame:
    """Adds ``near`` to edges: (m, watts, diff) of those of its ``minutes`` (an array by start and end) that were read, in order.

    ``grid`` has m, watts and diff. An edge's minutes are asked for by hash, so the grid's many rows move once and are
    neither sorted nor gathered around every minute; whatever a step reads around an edge is one such join."""
    spans = edges.select(*keys, "start", "end").distinct()
    asked = spans.select(*keys, "start", "end", F.explode(F.array_distinct(minutes)).alias("m")).hint("shuffle_hash")
    found = asked.join(grid.select(*keys, "m", "watts", "diff"), [*keys, "m"])
    lists = found.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_list(F.struct("m", "watts", "diff"))).alias("near"))
    return edges.join(merged(lists), [*keys, "start", "end"], "left")


def at_minute(minute: F.Column, value: str = "watts") -> F.Column:
    """``value`` at a minute of ``near``, null where none was read."""
    return F.get(F.filter("near", lambda x: x["m"] == minute), 0)[value]


def was_read(minute: F.Column) -> F.Column:
    return F.coalesce(F.exists("near", lambda x: x["m"] == minute), F.lit(False))


def differences(grid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The grid with its row differences; one that has them stays as it is."""
    return grid if "diff" in grid.columns else with_diff(grid, keys, ("m",))


def expand(edges: DataFrame, series: DataFrame, share: float = 0.05, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Moves start or end by a minute where the neighbouring diff has the edge's sign and exceeds the
    share of its magnitude; magnitude becomes power at the end minus power before the start.
    Both tables by whole minutes ``m`` (start, end are minutes)."""
    start, end = F.col("start"), F.col("end")
    found = near_edges(edges, differences(series, keys), keys, F.array(start - 2, start - 1, start, end, end + 1))
    first = lambda k, value="watts": F.when(was_read(start), at_minute(start - k, value))
    last = lambda k, value="watts": F.when(was_read(end), at_minute(end + k, value))
    found = found.withColumns({"p_pre": first(1), "p_pre2": first(2), "d_pre": first(1, "diff"), "p_end": last(0), "p_post": last(1), "d_post": last(1, "diff")})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    size = zero("p_end") - zero("p_pre")
    sign = F.when(F.col("event") == "on", 1).otherwise(-1)
    early, late = sign * zero("d_pre") > share * F.abs(size), sign * zero("d_post") > share * F.abs(size)
    end = F.when(late, F.col("p_post")).otherwise(F.col("p_end"))
    pre = F.when(early, F.col("p_pre2")).otherwise(F.col("p_pre"))
    return found.select(
        *keys, "event",
        F.when(early, F.col("start") - 1).otherwise(F.col("start")).alias("start"),
        F.when(late, F.col("end") + 1).otherwise(F.col("end")).alias("end"),
        (F.coalesce(end, F.lit(0.0)) - F.coalesce(pre, F.lit(0.0))).alias("magnitude"),
    )


def coalesce_intervals(intervals: DataFrame, keys: tuple[str, ...], gap: float = 0) -> DataFrame:
    """Merges intervals (start, end, magnitude; numbers) whose start is at most ``gap`` past the largest
    end before; magnitudes add up."""
    order = W.partitionBy(*keys).orderBy("start", "end", "id")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0)
    rows = intervals.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("magnitude").alias("magnitude"), F.count("*").alias("n_merged"))


def merge_pairs(events: DataFrame, keys: tuple[str, ...], gap: float = 1) -> DataFrame:
    """Merges two successive instantaneous events of one kind at most ``gap`` apart with no opposite
    event between; a merged event merges with no third, so a chain merges two by two.
    ``events``: (keys, kind, at, id, magnitude)."""
    order = W.partitionBy(*keys).orderBy("at", "id")
    linked = (F.col("at") - F.lag("at").over(order) <= gap) & (F.col("kind") == F.lag("kind").over(order))
    rows = events.withColumn("fresh", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("chain", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy(*keys, "chain").orderBy("at", "id")) - 1
    rows = rows.withColumn("pair", F.floor(place / 2))
    return rows.groupBy(*keys, "kind", "chain", "pair").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.sum("magnitude").alias("magnitude"), F.count("*").alias("n_merged")).drop("chain", "pair")


def near_threshold(grid: DataFrame, edges: DataFrame, threshold: float, share: float = 0.85, reach: int = 3, keys: tuple[str, ...] = SERIES, event: str = "on") -> DataFrame:
    """Rises (falls for ``off``) of ``share`` to 1 times the threshold outside of every such edge that reach
    the threshold when up to ``reach`` minutes before or after are added: the smallest extension, the
    earlier of two. (keys, start, end, magnitude) by minute."""
    w, sign = by(*keys, order=("m",)), 1 if event == "on" else -1
    rows = with_diff(grid, keys, ("m",))
    net = F.array(*[
        F.struct(F.lit(b + a).alias("size"), F.lit(a).alias("after"), F.lit(b).alias("before"), (F.lead("watts", a).over(w) - F.lag("watts", b + 1).over(w)).alias("magnitude"))
        for b in range(reach + 1) for a in range(reach + 1)
    ])
    size = F.col("diff") * sign
    rows = rows.withColumn("net", net).where((size >= share * threshold) & (size < threshold))
    best = F.array_min(F.filter("net", lambda x: x["magnitude"] * sign >= threshold))
    own = edges.where(F.col("event") == event).select(*keys, F.explode(F.sequence("start", "end")).alias("m")).distinct()
    found = rows.join(own, [*keys, "m"], "left_anti").withColumn("best", best).where("best is not null")
    return found.select(*keys, (F.col("m") - F.col("best.before")).alias("start"), (F.col("m") + F.col("best.after")).alias("end"), F.col("best.magnitude").alias("magnitude"))

"""Detection of edges as a composition of steps, and the numbering of what they find.

All tables are by whole minutes ``m`` within the keys of a series; a series ends with its month, so no
edge spans two. Steps are windows, joins over minutes, and folds over frames of a few minutes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators import devices, edges, kernels
from gridloom.operators.cleaning import forward_fill
from gridloom.sources.tables import ordered_mean
from gridloom.sources.work import merged, staged, stored

MONTHLY = ("house_id", "month", "phase")


def merge_split_offs(off: DataFrame, on: DataFrame, grid: DataFrame, keys: tuple[str, ...] = MONTHLY, gap: int = 2) -> DataFrame:
    """Joins OFF edges at most ``gap`` minutes apart, if no ON starts between them and power between stays
    at half the later one's magnitude or more (nothing read there: also). -> (keys, start, end,
    magnitude, n_merged); a merged magnitude is read from the power around it, else the sum."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    rows = off.withColumn("last", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    close = rows.where((F.col("start") - F.col("last")).between(0, gap)).select(*keys, "start", "end", "last", "magnitude", F.explode(F.sequence("last", "start")).alias("m"))
    starts = on.select(*keys, F.col("start").alias("m"), F.lit(1).alias("starts")).distinct()
    seen = close.hint("shuffle_hash").join(grid.select(*keys, "m", "watts"), [*keys, "m"], "left").join(starts, [*keys, "m"], "left")
    between = (F.col("m") > F.col("last")) & (F.col("m") < F.col("start"))
    joined = seen.groupBy(*keys, "start", "end").agg(ordered_mean(F.col("watts"), "m").alias("power"), F.first("magnitude").alias("size"), F.coalesce(F.max(F.when(between, F.col("starts"))), F.lit(0)).alias("blocked"))
    joined = joined.where("blocked = 0 and (power is null or power >= 0.5 * abs(size))").select(*keys, "start", "end", F.lit(0).alias("fresh"))
    rows = rows.join(joined, [*keys, "start", "end"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(1)))
    rows = rows.withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("magnitude").alias("total"), F.count("*").alias("n_merged"))
    found = edges.near_edges(found, edges.differences(grid, keys), keys, F.array(F.col("end"), F.col("start") - 1))
    found = found.withColumns({"at_end": edges.at_minute(F.col("end")), "before": edges.at_minute(F.col("start") - 1)})
    size = F.when(F.col("n_merged") > 1, F.coalesce(F.col("at_end") - F.col("before"), F.col("total"))).otherwise(F.col("total"))
    return found.select(*keys, "start", "end", size.alias("magnitude"), "n_merged")


def _walk(kind: str, minutes: str, share: float) -> F.Column:
    """Fold over the next (on) or earlier (off) minutes: {last, steady, live}; ``last`` is the furthest
    minute of the overshoot, null if it never began. Falls follow an ON, rises come before an OFF."""
    d = "x.d" if kind == "on" else "-x.d"
    step = "1" if kind == "on" else "-1"
    return F.expr(f"""aggregate({minutes}, named_struct('at', edge, 'last', CAST(NULL AS INT), 'steady', 0, 'live', true),
      (s, x) -> CASE
        WHEN NOT s.live OR x.m <> s.at + {step} OR x.busy OR x.d IS NULL OR {d} > 0.1D * abs(magnitude)
          THEN named_struct('at', s.at, 'last', s.last, 'steady', s.steady, 'live', false)
        WHEN {d} < 0 THEN named_struct('at', x.m, 'last', x.m, 'steady', 0, 'live', true)
        ELSE named_struct('at', x.m, 'last', s.last, 'steady', s.steady + 1, 'live', s.last IS NOT NULL AND s.steady < 1) END)""")


def settle(edges_: DataFrame, grid: DataFrame, kind: str, keys: tuple[str, ...] = MONTHLY, share: float = 0.75, most: int = 5) -> DataFrame:
    """Moves the end of ON edges behind their overshoot, or the start of OFF edges before the spike.

    An ON's end follows up to ``most`` falling minutes; an OFF's start goes back through rising ones.
    The walk stops at a minute that belongs to an edge, at a gap, at a move of over a tenth of the
    magnitude the other way, and at a steady minute before any move or the second one after. It counts
    if it moves by at least 1 - share of the magnitude and leaves the magnitude its sign. Adds
    original_start, original_end and original_magnitude where an edge moved. Edges of the other kind
    return as they are."""
    start, end, last = F.col("start"), F.col("end"), F.col("last")
    busy = edges_.select(*keys, F.explode(F.sequence("start", "end")).alias("m")).distinct()
    edge, asked = (end, F.array_append(F.sequence(end, end + most), start - 1)) if kind == "on" else (start, F.array_append(F.array_append(F.sequence(start - most - 1, start), end), end + 1))
    own = edges_.where(F.col("event") == kind)
    spans = own.select(*keys, "start", "end").distinct().select(*keys, "start", "end", F.explode(asked).alias("m"))
    taken = spans.join(merged(busy), [*keys, "m"]).groupBy(*keys, "start", "end").agg(F.collect_set("m").alias("taken"))
    own = edges.near_edges(own, edges.differences(grid, keys), keys, asked).join(merged(taken), [*keys, "start", "end"], "left")
    beside = (lambda x: x["m"].between(end + 1, end + most)) if kind == "on" else (lambda x: x["m"].between(start - most, start - 1))
    steps = F.transform(F.filter("near", beside), lambda x: F.struct(x["m"].alias("m"), x["diff"].alias("d"), F.coalesce(F.array_contains("taken", x["m"]), F.lit(False)).alias("busy")))
    own = own.withColumns({"edge": edge, "steps": F.when(edges.was_read(edge), steps if kind == "on" else F.reverse(steps))})
    own = own.withColumn("last", _walk(kind, "steps", share)["last"])
    at = edges.at_minute
    if kind == "on":  # the fall after the end, and the level before the start
        own = own.withColumns({"from_": at(end), "to_": at(last), "base": at(start - 1)})
        size, moved = F.col("to_") - F.coalesce("base", F.lit(0.0)), F.col("from_") - F.col("to_")
        good = (size > 0) & (moved >= (1 - share) * F.abs("magnitude"))
    else:  # the rise before the start, and the level after the end
        own = own.withColumns({"from_": at(start - 1), "to_": at(last - 1), "after": at(end + 1), "at_end": at(end)})
        size, moved = F.coalesce("after", "at_end", F.lit(0.0)) - F.col("to_"), F.col("from_") - F.col("to_")
        good = (size < 0) & (moved >= (1 - share) * F.abs("magnitude"))
    good = F.coalesce(good, F.lit(False))
    rest = [c for c in edges_.columns if c not in (*keys, "event", "start", "end", "magnitude", "original_start", "original_end", "original_magnitude")]
    kept = lambda c: F.coalesce(F.col(f"original_{c}"), F.when(good, F.col(c))) if f"original_{c}" in edges_.columns else F.when(good, F.col(c))
    first = F.when(good, F.col("last")).otherwise(F.col("start")) if kind == "off" else F.col("start")
    end = F.when(good, F.col("last")).otherwise(F.col("end")) if kind == "on" else F.col("end")
    own = own.select(*keys, "event", first.alias("start"), end.alias("end"), F.when(good, size).otherwise(F.col("magnitude")).alias("magnitude"), *[kept(c).alias(f"original_{c}") for c in ("start", "end", "magnitude")], *rest)
    return own.unionByName(edges_.where(F.col("event") != kind), allowMissingColumns=True)


@dataclass(frozen=True)
class Features:
    """Optional steps of the detection; ``imputation`` fills short gaps before each round."""

    gradual: bool = True
    near_threshold: bool = False
    tails: bool = True
    split_offs: bool = True
    settling: bool = True
    imputation: bool = False


def detect(grid: DataFrame, threshold: float, features: Features = Features(), off_factor: float = 0.8, keys: tuple[str, ...] = MONTHLY) -> DataFrame:
    """(keys, event, start, end, magnitude and original_start, -_end, -_magnitude where settled): sharp edges, expanded and merged two by
    two; ramps; overlapping ones as one; near-threshold rises; tails; split OFFs; settling. What stays is
    at least the threshold in size, before or after settling. OFF edges need ``off_factor`` of it to be
    found, the final rule is the same for both."""
    grid = stored(edges.with_diff(grid, keys, ("m",)).select(*keys, "m", "watts", "diff"))
    found = staged(edges.expand(edges.sharp_edges(grid, threshold, off_factor, keys, ("m",)), grid, keys=keys))
    instant = found.where("start = end").select(*keys, F.col("event").alias("kind"), F.col("start").alias("at"), F.concat_ws("-", "event", F.col("start").cast("string")).alias("id"), "magnitude")
    pairs = edges.merge_pairs(instant, keys).select(*keys, F.col("kind").alias("event"), "start", "end", "magnitude")
    found = pairs.unionByName(found.where("start < end"))
    if features.gradual:
        found = found.unionByName(kernels.gradual(grid, threshold, keys))
    ids = F.concat_ws("-", F.col("start").cast("string"), F.col("magnitude").cast("string"))
    found = staged(edges.coalesce_intervals(found.distinct().withColumn("id", ids), (*keys, "event"), 0).drop("island", "n_merged"))
    if features.near_threshold:
        on, off = (edges.near_threshold(grid, found, size, keys=keys, event=kind).withColumn("event", F.lit(kind)) for kind, size in (("on", threshold), ("off", int(threshold * off_factor))))
        found = staged(found.unionByName(on).unionByName(off))
    if features.tails:
        tails = devices.extend_tails(found.where("event = 'off'").drop("event"), grid, keys=keys).withColumn("event", F.lit("off"))
        found = found.where("event = 'on'").unionByName(tails.select(*found.columns))
    if features.split_offs:
        found = staged(found)
        off = merge_split_offs(found.where("event = 'off'").drop("event"), found.where("event = 'on'"), grid, keys)
        found = found.where("event = 'on'").unionByName(off.withColumn("event", F.lit("off")).select(*found.columns))
    none = lambda of: F.lit(None).cast(dict(found.dtypes)[of])
    found = found.withColumns({f"original_{c}": none(c) for c in ("start", "end", "magnitude")})
    if features.settling:
        for kind in ("on", "off"):
            found = settle(staged(found), grid, kind, keys)
    return found.where((F.abs("magnitude") >= threshold) | (F.abs("original_magnitude") >= threshold))


def numbered(found: DataFrame, grid: DataFrame, run: int, keys: tuple[str, ...] = MONTHLY) -> DataFrame:
    """Adds event_id ``{event}_it{run}_{phase}_{n}``, numbered over all months of a house's phase, and
    nearby_value: power a minute before an ON and a minute after an OFF."""
    order = W.partitionBy("house_id", "phase", "event").orderBy("month", "start", "end")
    ids = F.format_string(f"%s_it{run}_%s_%d", F.col("event"), F.col("phase"), F.row_number().over(order))
    beside = F.when(F.col("event") == "on", F.col("start") - 1).otherwise(F.col("end") + 1)
    power = grid.select(*keys, F.col("m").alias("beside"), F.col("watts").alias("nearby_value"))
    return found.withColumn("event_id", ids).withColumn("beside", beside).hint("shuffle_hash").join(power, [*keys, "beside"], "left").drop("beside")


def filled(readings: DataFrame, limit: int = 5, keys: tuple[str, ...] = MONTHLY) -> DataFrame:
    """Readings whose gaps of up to ``limit`` minutes are filled from before. Longer gaps stay missing as a whole after
    ``limit`` minutes, so that no edge spans them."""
    rows = readings.withColumns({"ts": F.col("m"), "event_id": F.col("m")})
    return forward_fill(rows, limit, keys).select(*keys, "m", F.col("filled").alias("watts"))

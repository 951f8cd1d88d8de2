"""Finding devices in pairs of edges: chained nearest joins, neighbours, cycling, boilers, patterns across
houses, and how far to trust each.

Events are (house_id, phase, id, start, end, magnitude, duration, ...); start and end are seconds, duration
minutes, magnitude watts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.joins import band_join, overlaps
from gridloom.operators.stretches import dealt, over_stretches
from gridloom.sources.tables import ordered_sum
from gridloom.sources.work import staged

def _size() -> Column:
    return F.abs("magnitude")


def _fields(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + more


# ---------------------------------------------------------------- joins


def chained_nearest(events: DataFrame, phases: list[str], tolerance: int = 600) -> DataFrame:
    """(house_id, id_<phase>...): runs of the first phase with the nearest run of each further phase within
    the tolerance of the first one's start. Only chains with every phase count; they are taken by start, then
    id, and one that holds a run which an earlier one has taken is not.

    Chains that share a run start within twice the tolerance, so a house is cut where none starts for longer, and
    each island is walked in order."""
    side = lambda p: events.where(F.col("phase") == p).select("house_id", F.col("id").alias(f"id_{p}"), F.col("start").alias(f"start_{p}"))
    head, at = f"id_{phases[0]}", f"start_{phases[0]}"
    found = side(phases[0])
    for p in phases[1:]:
        near = band_join(found.select("house_id", head, at), side(p), ["house_id"], at, f"start_{p}", tolerance, tolerance)
        order = F.struct(F.abs(F.col(f"start_{p}") - F.col(at)).alias("d"), F.col(f"start_{p}"), F.col(f"id_{p}"))
        best = near.groupBy(head).agg(F.min(order).alias("b")).select(head, F.col(f"b.id_{p}").alias(f"id_{p}"))
        found = found.join(best, head)
    ids = [f"id_{p}" for p in phases]
    w = W.partitionBy("house_id").orderBy(at, head)
    rows = dealt(found.select("house_id", at, *ids), ["house_id"]).withColumn("fresh", F.when(F.col(at) - F.lag(at).over(w) <= 2 * tolerance, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("fresh")

    def walk(part: dict) -> list[tuple]:
        taken, out = set(), []
        for chain in zip(*[part[i] for i in ids], strict=True):
            if not taken.intersection(chain):
                taken.update(chain)
                out.append(chain)
        return out

    kind = dict(events.dtypes)["id"]
    return over_stretches(rows, ["house_id", "island"], [at, head], walk, ", ".join(f"{i} {kind}" for i in ids)).select("house_id", *ids)


def nearby_cycles(candidates: DataFrame, events: DataFrame, apart: int = 3600, shortest: float = 3, longest: float = 24, least: float = 800) -> DataFrame:
    """Adds n_cycles to ``candidates``: other short strong runs of its series that start within ``apart``
    seconds. With two or more a boiler is likelier an AC."""
    cycles = events.where(F.col("duration").between(shortest, longest) & (_size() >= least)).select("house_id", "phase", F.col("id").alias("cycle"), F.col("start").alias("at"))
    near = band_join(candidates.select("house_id", "phase", "id", "start"), cycles, ["house_id", "phase"], "start", "at", apart, apart).where("id <> cycle")
    return candidates.join(near.groupBy("id").agg(F.count("*").alias("n_cycles")), "id", "left").na.fill(0, ["n_cycles"])


def compressor_near(candidates: DataFrame, events: DataFrame, apart: int = 3600, least: float = 800, share: float = 0.5, slack: int = 300, cycles: int = 2) -> DataFrame:
    """Candidates with fewer than ``cycles`` compressor runs around: runs of 3 to 30 minutes of its series,
    strong and at least ``share`` of it, near its start, not over ``slack`` seconds before it, and not
    inside of it."""
    short = events.where(F.col("duration").between(3, 30) & (_size() >= least)).select("house_id", "phase", F.col("id").alias("o_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), _size().alias("o_size"))
    near = band_join(candidates, short, ["house_id", "phase"], "start", "o_start", apart, apart).where("id <> o_id")
    inside = (F.col("o_start") >= F.col("start")) & (F.col("o_end") <= F.col("end"))
    near = near.where((F.col("o_size") >= share * _size()) & (F.col("o_end") >= F.col("start") - slack) & ~inside)
    busy = near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= cycles).select("id")
    return candidates.join(busy, "id", "left_anti")


def _taken(ids: np.ndarray, phase: np.ndarray, start: np.ndarray, end: np.ndarray, slack: float) -> list[tuple]:
    """(reference, phase, session) rows of one island, sessions in order of start and id."""
    phases = np.unique(phase)
    own = {p: np.flatnonzero(phase == p) for p in phases}
    free, out = np.ones(len(ids), bool), []
    for k, p in enumerate(phases):
        for ref in own[p]:
            if not free[ref]:
                continue
            found = []
            for other in phases[k + 1 :]:
                upto = np.searchsorted(start[own[other]], end[ref] + slack, "right")
                near = own[other][:upto]
                near = near[free[near] & (end[near] >= start[ref] - slack)]
                if len(near):
                    found.append((other, near[0]))
            if found:
                free[[ref, *(r for _, r in found)]] = False
                out += [(ids[ref], other, ids[r]) for other, r in found]
    return out


def synced(sessions: DataFrame, slack: int = 600) -> DataFrame:
    """(house_id, l_id, phase, r_id): sessions of several phases that run together, each in one group at most.

    References go by phase, then start, then id. One that is free takes from every later phase the first free session
    that overlaps it within ``slack`` seconds; with any, it and they are used up, else it stays as it is. Sessions that
    no overlap connects can't take from one another, so a house is cut where nothing has run for
    over ``slack``, and each island is walked in order."""
    w = W.partitionBy("house_id").orderBy("start", "id")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = dealt(sessions.select("house_id", "id", "phase", "start", "end"), ["house_id"])
    rows = rows.withColumn("fresh", F.when(F.col("start") - slack <= reach, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("fresh")
    kind = dict(sessions.dtypes)["id"]
    walk = lambda part: _taken(part["id"], part["phase"], part["start"], part["end"], slack)
    return over_stretches(rows, ["house_id", "island"], ["start", "id"], walk, f"l_id {kind}, phase string, r_id {kind}").drop("island")


def long_partners(candidates: DataFrame, events: DataFrame, minutes: float = 15, ratio: float = 2.0, share: float = 0.5) -> DataFrame:
    """(l_id, phase, r_id): for every candidate and other phase of its house the first run, by start and id, of any power that is
    ``minutes`` long, at most ``ratio`` times as long or short, and overlaps it by ``share`` of the shorter."""
    side = lambda df, p: df.select("house_id", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "phase", "start", "end", "duration")])
    pairs = overlaps(side(candidates, "l"), side(events.where(F.col("duration") >= minutes), "r"), ["house_id"], 0, 86_400).where("l_phase <> r_phase")
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    shorter, longer = F.least("l_duration", "r_duration"), F.greatest("l_duration", "r_duration")
    pairs = pairs.where((longer <= ratio * shorter) & (shared >= share * shorter * 60))
    return pairs.groupBy("l_id", F.col("r_phase").alias("phase")).agg(F.min(F.struct("r_start", "r_id"))["r_id"].alias("r_id"))


def three_phase_groups(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """(l_id, r_id): isolated long strong runs (``candidates``) with the long runs of other phases beside them. Candidates are
    asked by start and id; one that an earlier one has taken is not asked.

    Only candidates that took one another decide for each other, so a house is cut where neither a candidate nor what
    it takes reaches over, and each island is walked in order."""
    picks = staged(long_partners(candidates, events))
    at = events.select(F.col("id").alias("r_id"), F.col("end").alias("r_end"))
    rows = candidates.select("house_id", F.col("id").alias("l_id"), "start", "end").join(picks, "l_id").join(at, "r_id")
    reach = F.greatest("end", "r_end")
    w = W.partitionBy("house_id").orderBy("start", "l_id", "phase")
    before = F.max(reach).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = dealt(rows, ["house_id"]).withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))

    def walk(part: dict) -> list[tuple]:
        taken, out = set(), []
        asked = None
        for l_id, r_id in zip(part["l_id"], part["r_id"], strict=True):
            if l_id != asked and l_id in taken:
                continue
            asked = l_id
            taken.add(r_id)
            out.append((l_id, r_id))
        return out

    kind = dict(events.dtypes)["id"]
    kept = rows.select("house_id", "island", "start", "l_id", "phase", "r_id")
    return over_stretches(kept, ["house_id", "island"], ["start", "l_id", "phase"], walk, f"l_id {kind}, r_id {kind}").select("l_id", "r_id")


def last_in_first_out(at: np.ndarray, kind: np.ndarray, size: np.ndarray, most: float, difference: float = 500.0) -> list[tuple[int, int]]:
    """Rows in order: an ON is laid on a stack; an OFF takes the topmost ON that fits. -> (on, off) rows."""
    stack, out = [], []
    for i in range(len(at)):
        if kind[i] == "on":
            stack.append(i)
            continue
        for k in range(len(stack) - 1, -1, -1):
            if at[i] - at[stack[k]] > most:
                break
            if abs(size[i] - size[stack[k]]) <= difference:
                out.append((stack.pop(k), i))
                break
    return out


def stack_pairs(edges: DataFrame, keys: list[str], most: float = 360, difference: float = 500.0) -> DataFrame:
    """(keys, on_id, off_id) by last_in_first_out over every month of a series (keys, event, id, at, magnitude)."""
    kinds = dict(edges.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "event", "id"]).reset_index(drop=True)
        pairs = last_in_first_out(group["at"].to_numpy(float), group.event.to_numpy(), group.magnitude.abs().to_numpy(float), most, difference)
        out = group.loc[[i for i, _ in pairs], keys].reset_index(drop=True)
        ids = lambda rows: group.id.reindex(rows).to_numpy()  # noqa: E731 (of the ids' type, also where there are none)
        return out.assign(on_id=ids([i for i, _ in pairs]), off_id=ids([j for _, j in pairs]))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", on_id {kinds['id']}, off_id {kinds['id']}"
    return edges.select(*keys, "event", "id", "at", "magnitude").groupBy(*keys).applyInPandas(run, schema)


# ---------------------------------------------------------------- scores


def rising(value: Column, low: float, high: float) -> Column:
    """0.5 at ``low`` and below, 1 at ``high`` and above."""
    return F.when(value <= low, 0.5).when(value >= high, 1.0).otherwise(0.5 + 0.5 * (value - low) / (high - low))


def falling(value: Column, low: float, high: float) -> Column:
    """1 at ``low`` and below, 0.5 at ``high`` and above."""
    return F.when(value <= low, 1.0).when(value >= high, 0.5).otherwise(1.0 - 0.5 * (value - low) / (high - low))


# Limits of the classes (fixed values): minutes, watts, runs, variation.
BOILER_MINUTES, BOILER_WATTS, ALONE_MINUTES = 15, 1500, 30
AC_FIRST_MINUTES, AC_RUNS, AC_WATTS, AC_CV = 10, 4, 800, 0.20
CYCLE_MINUTES = (3, 30)
LIKE_CV, LIKE_LENGTH_CV, LIKE_GAP_CV = 0.30, 0.40, 0.50


def cycling_measures(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, anchor, ...) of sessions. anchor: the length of the first run of ten minutes or more, else of
    the longest; in_range: share of runs of cycle length; one_way: share of magnitude changes in the commoner
    direction or none (under three runs 1); variation of the magnitudes, of the lengths but the first, and
    of the positive gaps (0 where there are under two of them, or under three runs)."""
    w = W.partitionBy(*keys).orderBy("start", "id")
    rows = events.withColumns({"_i": F.row_number().over(w), "_step": _size() - F.lag(_size()).over(w), "_gap": F.col("start") - F.lag("end").over(w)})
    cv = lambda c: F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(0.0)
    several = lambda c: F.when((F.count("*") >= 3) & (F.count(c) >= 2), cv(c)).otherwise(0.0)
    later, gap, step = F.when((F.col("_i") > 1) & (F.col("duration") > 0), F.col("duration")), F.when(F.col("_gap") > 0, F.col("_gap")), F.col("_step")
    long = F.when(F.col("duration") >= AC_FIRST_MINUTES, F.col("_i"))
    one_way = (F.greatest(F.count_if(step > 0), F.count_if(step < 0)) + F.count_if(step == 0)) / F.nullif(F.count(step), F.lit(0))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.min_by("duration", long), F.max("duration")).alias("anchor"), F.avg(_size()).alias("mean_size"), F.avg("duration").alias("mean_length"), cv(_size()).alias("size_cv"),
        several(later).alias("length_cv"), several(gap).alias("gap_cv"), F.avg(F.col("duration").between(*CYCLE_MINUTES).cast("double")).alias("in_range"), F.when(F.count("*") >= 3, one_way).otherwise(1.0).alias("one_way"),
    )


def _mean(*parts: Column) -> Column:
    return sum(parts, F.lit(0.0)) / len(parts)


def ac_scores(measures: DataFrame) -> DataFrame:
    """Adds confidence that a session is a regular AC, and ac_like, how much it is like a part of a central one."""
    c = F.col
    confidence = _mean(rising(c("n"), AC_RUNS, 10), falling(c("size_cv"), 0.05, AC_CV), rising(c("anchor"), AC_FIRST_MINUTES, 2 * AC_FIRST_MINUTES), rising(c("mean_size"), AC_WATTS, 2 * AC_WATTS))
    like = _mean(
        rising(c("n"), AC_RUNS, 10), rising(c("mean_size"), AC_WATTS, 1500), falling(c("size_cv"), 0, LIKE_CV), F.greatest(c("in_range"), F.lit(0.5)),
        rising(c("one_way"), 0.5, 0.85), falling(c("length_cv"), 0, LIKE_LENGTH_CV), falling(c("gap_cv"), 0, LIKE_GAP_CV),
    )
    return measures.withColumns({"confidence": confidence, "ac_like": like})


def distances(events: DataFrame, keys: list[str], session: str) -> DataFrame:
    """(keys, session, distance): minutes from a session's runs to the nearest run of cycle length that is in
    another session of the series, by start; null if there is none. Sessions follow each other in time."""
    medium = F.when(F.col("duration").between(*CYCLE_MINUTES), F.col("start"))
    rows = events.groupBy(*keys, session).agg(F.min("start").alias("first"), F.max("start").alias("last"), F.min(medium).alias("m_first"), F.max(medium).alias("m_last"))
    w = W.partitionBy(*keys).orderBy("first", session)
    before = F.last("m_last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("m_first", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return rows.select(*keys, session, (F.least(F.col("first") - before, after - F.col("last")) / 60).alias("distance"))


def boiler_scores(sessions: DataFrame) -> DataFrame:
    """Adds confidence that a session (n, mean_length, mean_size, distance) is a boiler."""
    c = F.col
    alone = F.when(c("distance").isNull(), 1.0).otherwise(rising(c("distance"), 0, ALONE_MINUTES))
    once = F.when(c("n") == 1, 1.0).otherwise(0.6)
    return sessions.withColumn("confidence", _mean(rising(c("mean_length"), BOILER_MINUTES, 2 * BOILER_MINUTES), rising(c("mean_size"), BOILER_WATTS, 2 * BOILER_WATTS), once, alone))


def dominant_rounds(events: DataFrame, keys: list[str], least: int = 4, most_cv: float = 0.20, watts: float = 800) -> DataFrame:
    """Sessions (keys) with a round (iteration) of ``least`` or more alike and strong runs."""
    rounds = events.groupBy(*keys, "iteration").agg(F.count("*").alias("n"), F.avg(_size()).alias("mean"), F.stddev_pop(_size()).alias("spread"))
    return rounds.where((F.col("n") >= least) & (F.col("mean") >= watts) & (F.col("spread") <= most_cv * F.col("mean"))).select(*keys).distinct()


def multi_phase(sessions: DataFrame, slack: int = 600) -> DataFrame:
    """Sessions of a house with those of other phases that overlap them: (l_id, n_phases, sync, balance,
    three_phase). sync and balance are parts of a central AC's confidence; three_phase is the confidence in
    one device on several phases, 1 where three phases draw alike."""
    return multi_phase_of(synced(sessions, slack), sessions)


def multi_phase_of(links: DataFrame, sessions: DataFrame) -> DataFrame:
    """multi_phase() of the given groups (l_id, r_id)."""
    of = lambda c: sessions.select(F.col("id").alias(c), F.abs("magnitude").alias("size"), "start", "duration")
    own = links.select("l_id").distinct().join(of("l_id"), "l_id")
    rows = links.join(of("r_id"), "r_id").select("l_id", "size", "start", "duration").unionByName(own)
    cv = lambda c: F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c))
    found = rows.groupBy("l_id").agg(F.count("*").alias("n_phases"), ((F.max("start") - F.min("start")) / 60).alias("late"), cv("size").alias("s_cv"), cv("duration").alias("d_cv"))
    c = F.col
    either = lambda score, x: F.when(x.isNull(), 0.5).otherwise(score)
    count = F.when(c("n_phases") >= 3, 1.0).otherwise(0.7)
    same = _mean(either(falling(c("s_cv"), 0, 0.3), c("s_cv")), count, falling(c("late"), 0, 15), either(falling(c("d_cv"), 0, 0.5), c("d_cv")))
    three = F.when((c("n_phases") >= 3) & (c("s_cv") <= 0.10), 1.0).otherwise(same)
    return found.select("l_id", "n_phases", falling(c("late"), 0, 10).alias("sync"), either(falling(c("s_cv"), 0, 0.5), c("s_cv")).alias("balance"), three.alias("three_phase"))


def central_scores(phases: DataFrame, likeness: DataFrame) -> DataFrame:
    """``phases`` of multi_phase() with the mean likeness (l_id, ac_like) of their sessions -> confidence."""
    count = F.when(F.col("n_phases") >= 3, 1.0).otherwise(0.7)
    return phases.join(likeness, "l_id").withColumn("confidence", _mean(count, F.col("sync"), F.col("balance"), F.col("ac_like")))


def cluster_scores(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, confidence, reason): a cluster of recurring sessions is valid with three or more alike in
    magnitude and length (variation at most 0.20); its confidence is the mean of four scores: number, both
    variations, and regularity of the gaps between starts (0.5 where there are under two)."""
    w = W.partitionBy(*keys).orderBy("start", "id")
    rows = sessions.withColumn("_gap", F.col("start") - F.lag("start").over(w)).withColumn("_gap", F.when(F.col("_gap") > 0, F.col("_gap")))
    cv = lambda c: F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(0.0)
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), cv(_size()).alias("size_cv"), cv(F.col("duration")).alias("length_cv"), F.when(F.count("_gap") >= 2, cv(F.col("_gap"))).alias("gap_cv"), F.avg(_size()).alias("mean_size"), F.avg("duration").alias("mean_length"))
    found = found.where("n >= 3 and size_cv <= 0.20 and length_cv <= 0.20")
    low = lambda x: F.greatest(x, F.lit(0.0))
    regular = F.coalesce(F.least(low(1 - 0.5 * F.col("gap_cv")), F.lit(1.0)), F.lit(0.5))
    mean = _mean(F.least(0.5 + 0.05 * (F.col("n") - 3), F.lit(1.0)), low(1 - 2 * F.col("size_cv")), low(1 - 2 * F.col("length_cv")), regular)
    reason = F.format_string("%d sessions of about %.0f W and %.0f min", "n", "mean_size", "mean_length")
    return found.withColumns({"confidence": mean, "reason": reason}).select(*keys, "n", "confidence", "reason")


def unknown_scores(sessions: DataFrame) -> DataFrame:
    """Adds not_boiler and not_ac, how far a session (n, mean_length, mean_size, anchor, size_cv, distance) is from
    either, and confidence, the lesser of both; the nearer one is the reason."""
    c = F.col
    runs = F.when(c("n") <= 2, 1.0).when(c("n") <= 4, 0.5).otherwise(F.greatest(1 - 0.1 * c("n"), F.lit(0.0)))
    alone = F.when(c("distance").isNull(), 1.0).otherwise(rising(c("distance"), 0, ALONE_MINUTES))
    boiler = _mean(rising(c("mean_length"), 0, BOILER_MINUTES), rising(c("mean_size"), 0, BOILER_WATTS), runs, alone)
    ac = _mean(rising(c("n"), 1, AC_RUNS), rising(c("mean_size"), 0, AC_WATTS), rising(c("anchor"), 0, AC_FIRST_MINUTES), falling(c("size_cv"), 0, 2 * AC_CV))
    found = sessions.withColumns({"not_boiler": 1 - boiler, "not_ac": 1 - ac})
    nearer = F.when(F.col("not_boiler") <= F.col("not_ac"), "closest to a boiler").otherwise("closest to an AC")
    return found.withColumns({"confidence": F.least("not_boiler", "not_ac"), "reason": nearer})


def activation_scores(activations: DataFrame) -> DataFrame:
    """Adds confidence (0 to 1) and tier to activations (device_type, phase, magnitude, duration, tag, iteration,
    month): 0.25 tag, 0.15 round, 0.20 magnitude, 0.15 duration, 0.10 season, 0.15 phase, plus 0.05."""
    known = activations.where("device_type <> 'unknown'")
    rows = activations
    for c, value in (("size", _size()), ("length", F.col("duration"))):
        middle = known.groupBy("device_type").agg(F.median(value).alias(f"{c}_median"))
        away = known.join(middle, "device_type").groupBy("device_type").agg(F.median(F.abs(value - F.col(f"{c}_median"))).alias(f"{c}_mad"))
        rows = rows.join(F.broadcast(middle), "device_type", "left").join(F.broadcast(away), "device_type", "left")  # a row per device type
    counts = known.groupBy("device_type", "phase").agg(F.count("*").alias("c"))
    main = counts.groupBy("device_type").agg(F.max_by("phase", F.struct("c", "phase")).alias("main_phase"))
    rows = rows.join(F.broadcast(main), "device_type", "left")

    def fit(value: Column, c: str) -> Column:
        median, mad = F.col(f"{c}_median"), F.col(f"{c}_mad")
        return F.when(median.isNull(), 0.5).when(mad == 0, F.when(value == median, 1.0).otherwise(0.5)).otherwise(F.greatest(1 - F.least(F.abs(value - median) / mad / 3, F.lit(1.0)), F.lit(0.0)))

    has = lambda word: F.coalesce(F.upper("tag").contains(word), F.lit(False))
    quality = F.when(has("EXACT"), 1.0).when(has("CLOSE"), 0.8).when(has("APPROX"), 0.6).when(has("LOOSE"), 0.4).otherwise(0.5)
    quality = quality * F.when(has("PARTIAL"), 0.5).when(has("NOISY"), 0.7).otherwise(1.0) * F.when(has("CORRECTED"), 0.9).otherwise(1.0)
    quality = F.when(F.coalesce("tag", F.lit("")) == "", 0.3).otherwise(quality)
    turn = F.when(F.col("iteration") == 0, 1.0).when(F.col("iteration") == 1, 0.8).when(F.col("iteration") == 2, 0.6).when(F.col("iteration") == 3, 0.4).otherwise(0.3)
    season = F.when(F.col("device_type").isin("regular_ac", "central_ac"), F.when(F.col("month").between(5, 10), 1.0).when(F.col("month").isin(4, 11), 0.7).otherwise(0.3)).when(F.col("device_type").isin("boiler", "three_phase_device"), 0.8).otherwise(0.5)
    same = F.when(F.col("device_type").isin("central_ac", "three_phase_device"), 1.0).when(F.col("phase") == F.col("main_phase"), 1.0).otherwise(0.5)
    score = F.least(0.25 * quality + 0.15 * turn + 0.20 * fit(_size(), "size") + 0.15 * fit(F.col("duration"), "length") + 0.10 * season + 0.15 * same + 0.05, F.lit(1.0))
    rows = rows.withColumn("confidence", score)
    return rows.withColumn("tier", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low"))


# Device types that are classified, warm months, and limits of each flag (fixed values).
CLASSIFIED = ("boiler", "three_phase_device", "central_ac", "regular_ac", "recurring_pattern")
WARM = (5, 10)
CRITICAL = "ANOMALY|SWITCHING|INVERTED"
QUALITY_WEIGHTS = {"temporal": 0.25, "magnitude": 0.30, "duration": 0.20, "seasonal": 0.15, "energy": 0.10}


def type_quality(sessions: DataFrame) -> DataFrame:
    """(house_id, device_type, n, measures, a flag or null for each of four kinds) of sessions (house_id, device_type,
    phase, start, end, year_month yyyymm, magnitude, duration).

    temporal: share of the house's months with a session of the type; cv and switching: spread of magnitudes and share of
    sessions off the main phase, for two known magnitudes or more; median: of positive durations; ratio: warm
    sessions over cool ones (one at least), for houses with data in both. Months are those with any session."""
    c = F.col
    warm = (c("year_month") % 100).between(*WARM)
    houses = sessions.groupBy("house_id").agg(F.count_distinct("year_month").alias("months_total"), (F.bool_or(warm) & F.bool_or(~warm)).alias("both_seasons"))
    own = sessions.where(c("device_type").isin(*CLASSIFIED))
    size = F.when(_size() > 0, _size())
    main = own.groupBy("house_id", "device_type", "phase").agg(F.count("*").alias("k")).groupBy("house_id", "device_type").agg((1 - F.max("k") / F.sum("k")).alias("switching"))
    found = own.groupBy("house_id", "device_type").agg(
        F.count("*").alias("n"), F.count_distinct("year_month").alias("months_with"), F.count(size).alias("n_sizes"), F.avg(size).alias("mean"), F.stddev_pop(size).alias("spread"),
        F.percentile(F.when(c("duration") > 0, c("duration")), F.lit(0.5)).alias("median"), F.count_if(warm).alias("warm"), F.count_if(~warm).alias("cool"),
    )
    found = found.join(main, ["house_id", "device_type"]).join(houses, "house_id")
    several = c("n_sizes") >= 2
    found = found.withColumns({
        "temporal": c("months_with") / c("months_total"), "cv": F.when(several, c("spread") / c("mean")).otherwise(0.0),
        "switching": F.when(several, c("switching")).otherwise(0.0), "ratio": F.when(c("both_seasons"), c("warm") / F.greatest(c("cool"), F.lit(1))),
    })
    boiler, ac = c("device_type") == "boiler", c("device_type").isin("regular_ac", "central_ac")
    flags = {
        "temporal_flag": F.when((boiler & (c("temporal") < 0.50)) | (ac & (c("temporal") > 0.90)), "TEMPORAL_ANOMALY").when((c("temporal") < 0.20) & (c("n") > 5), "TEMPORAL_SPARSE"),
        "magnitude_flag": F.when(several, F.when(boiler & (c("cv") > 0.30), "MAGNITUDE_UNSTABLE").when(boiler & (c("switching") > 0.10), "PHASE_SWITCHING").when(boiler & ~c("mean").between(1500, 5000), "MAGNITUDE_SUSPICIOUS").when((c("device_type") == "regular_ac") & (c("cv") > 0.40), "MAGNITUDE_UNSTABLE")),
        "duration_flag": F.when(boiler & (c("median") > 240), "DURATION_ANOMALY").when(boiler & (c("median") < 15) | ac & (c("median") < 5), "DURATION_TOO_SHORT"),
        "seasonal_flag": F.when(ac & (c("ratio") < 1.0) | boiler & (c("ratio") > 3.0), "SEASONAL_INVERTED").when(ac & c("ratio").between(0.8, 1.2) & (c("months_total") >= 6), "SEASONAL_FLAT"),
    }
    return found.withColumns(flags).select("house_id", "device_type", "n", "months_total", "both_seasons", "temporal", "cv", "switching", "median", "ratio", *flags)


def class_quality(sessions: DataFrame) -> DataFrame:
    """(house_id, n_sessions, data_months, n_overlaps, score, tier, flags): a weighted score of five kinds. A kind is
    worth 1 without flags, 0.5 with some or without data, 0 with a critical one; energy 0.5 where sessions of a phase
    overlap. ``flags`` are type:FLAG, in order of the alphabet."""
    types = type_quality(sessions)
    w = W.partitionBy("house_id", "phase").orderBy("start", "end", "id")
    lap = sessions.withColumn("over", F.col("end") > F.lead("start").over(w))
    houses = lap.groupBy("house_id").agg(F.count("*").alias("n_sessions"), F.count_distinct("year_month").alias("data_months"), F.count_if("over").alias("n_overlaps"))
    names = [f"{k}_flag" for k in ("temporal", "magnitude", "duration", "seasonal")]
    has = {"temporal_flag": F.lit(True), "magnitude_flag": F.lit(True), "duration_flag": F.col("median").isNotNull(), "seasonal_flag": F.col("both_seasons")}

    def worth(name: str) -> Column:
        flag = F.col(name)
        return F.when(F.coalesce(F.bool_or(flag.rlike(CRITICAL)), F.lit(False)), 0.0).when(F.count(flag) > 0, 0.5).when(F.coalesce(F.bool_or(has[name]), F.lit(False)), 1.0).otherwise(0.5).alias(name)

    listed = F.array_sort(F.flatten(F.collect_list(F.filter(F.array(*[F.concat("device_type", F.lit(":"), n) for n in names]), lambda x: x.isNotNull()))))  # four a type at most
    scored = types.groupBy("house_id").agg(*[worth(n) for n in names], F.concat_ws(",", listed).alias("flags"))
    found = houses.join(scored, "house_id", "left").na.fill(0.5, names).na.fill("", ["flags"])
    energy = F.when(F.col("n_overlaps") > 0, 0.5).otherwise(1.0)
    score = sum((QUALITY_WEIGHTS[n.removesuffix("_flag")] * F.col(n) for n in names), QUALITY_WEIGHTS["energy"] * energy)
    tier = F.when(score >= 0.85 - 1e-9, "excellent").when(score >= 0.65 - 1e-9, "good").when(score >= 0.45 - 1e-9, "fair").otherwise("poor")
    return found.select("house_id", "n_sessions", "data_months", "n_overlaps", score.alias("score"), tier.alias("tier"), "flags")


def outliers(scores: DataFrame) -> DataFrame:
    """Houses (house_id, metric, z): an outlier has a score of over 3, or three or more of over 2."""
    size = F.abs("z")
    found = scores.groupBy("house_id").agg(F.max(size).alias("max_z"), F.count_if(size > 2).alias("n_over_2"))
    return found.withColumn("outlier", (F.col("max_z") > 3) | (F.col("n_over_2") >= 3))


# ---------------------------------------------------------------- recurring times


def recurring_times(minute: np.ndarray, length: np.ndarray, tolerance: float = 60, share: float = 0.10, least: int = 3) -> np.ndarray:
    """Cluster number by row (-1: none), rows in order of minute of the day: a row joins the last cluster if
    it lies within the tolerance of its running mean and its length within ``share`` of its mean length."""
    label, at, n, mean, long = np.full(len(minute), -1), -1, 0, 0.0, 0.0
    for i in range(len(minute)):
        if n and abs(minute[i] - mean) <= tolerance and abs(length[i] - long) <= share * long:
            n += 1
            mean, long = mean + (minute[i] - mean) / n, long + (length[i] - long) / n
        else:
            at, n, mean, long = at + 1, 1, float(minute[i]), float(length[i])
        label[i] = at
    sizes = np.bincount(label) if len(label) else np.array([], int)
    return np.where(sizes[label] >= least, label, -1) if len(label) else label


WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def recurrences(events: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, cluster, n, minute, days, period, weekday): runs that recur at a time of day with a like length, how
    often (the mean gap between their days), and the weekday of most of them (ties: the earliest in the day's order).

    ``keys`` hold the house, phase and power bucket, so a group is the runs of one device at most."""

    def mark(part: dict) -> list[tuple]:
        found = recurring_times(part["minute"].astype(float), part["duration"].astype(float), least=least)
        return list(zip(part["id"], part["minute"], part["day"], range(len(found)), found, strict=True))

    kind = dict(events.dtypes)["id"]
    rows = events.withColumns({"minute": F.floor(F.col("start") / 60) % 1440, "day": F.floor(F.col("start") / 86_400)}).select(*keys, "id", "start", "minute", "day", "duration")
    marked = over_stretches(dealt(rows, keys), keys, ["minute", "start", "id"], mark, f"id {kind}, minute long, day long, nth long, cluster long").where("cluster >= 0")
    w = W.partitionBy(*keys, "cluster")
    marked = marked.withColumn("weekday", (F.col("day") + 3) % 7)
    named = marked.groupBy(*keys, "cluster", "weekday").agg(F.count("*").alias("c"), F.min("nth").alias("nth")).withColumn("k", F.row_number().over(w.orderBy(F.desc("c"), "nth"))).where("k = 1")
    found = marked.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.avg("minute").alias("minute"), F.count_distinct("day").alias("days"), (F.max("day") - F.min("day")).alias("span"))
    gap = F.when(F.col("days") > 1, F.col("span") / (F.col("days") - 1))
    period = F.when(gap.isNull(), "unknown").when(gap.between(0.8, 1.2), "daily").when(gap.between(6, 8), "weekly").when(gap.between(13, 15), "bi-weekly").when(gap.between(28, 32), "monthly").otherwise(F.format_string("every ~%.0f days", gap))
    weekday = F.array(*[F.lit(d) for d in WEEKDAYS])[F.col("weekday").cast("int")]
    return found.join(named.select(*keys, "cluster", weekday.alias("weekday")), [*keys, "cluster"]).withColumn("period", period).drop("span")


# Limits of an AC's sessions (fixed values): watts, minutes.
AC_GAP_MINUTES, AC_INITIAL_MINUTES = 60, 15
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}


def central_runs(events: DataFrame, chains: DataFrame, phases: list[str]) -> DataFrame:
    """Chains of chained_nearest() as runs (house_id, id, start, end, magnitude, duration): from the first phase's start to the
    last end, with the sum of magnitudes and the mean of lengths."""
    members = chains.select("house_id", F.col(f"id_{phases[0]}").alias("chain"), F.explode(F.array(*[f"id_{p}" for p in phases])).alias("id"))
    rows = members.join(events.drop("house_id"), "id")
    first = F.max(F.when(F.col("id") == F.col("chain"), F.col("start"))).alias("start")
    return rows.groupBy("house_id", F.col("chain").alias("id")).agg(first, F.max("end").alias("end"), ordered_sum(_size(), "id").alias("magnitude"), F.avg("duration").alias("duration"))


def ac_patterns(events: DataFrame, phases: list[str], tolerance: int = 600) -> DataFrame:
    """(house_id, kind, phase, session, ...) of ac_sessions(): central ACs are sessions of runs on every phase at once (phase
    null); regular ones those of a phase's other runs that look like an AC's."""
    chains = staged(chained_nearest(events, phases, tolerance))
    central = ac_sessions(central_runs(events, chains, phases), ["house_id"], valid=False, strong=False)
    used = chains.select(F.explode(F.array(*[f"id_{p}" for p in phases])).alias("id"))
    regular = ac_sessions(events.join(used, "id", "left_anti"), ["house_id", "phase"])
    both = central.withColumns({"kind": F.lit("central_ac"), "phase": F.lit(None).cast("string")}).unionByName(regular.withColumn("kind", F.lit("regular_ac")))
    return both.select("house_id", "kind", "phase", "session", "start", "end", "cycles", "magnitude", "most")


def ac_sessions(runs: DataFrame, keys: list[str], valid: bool = True, strong: bool = True) -> DataFrame:
    """(keys, session, start, end, cycles, magnitude, ...): compressor runs (start, end, magnitude, duration, id) at most an hour
    apart as sessions. With ``valid`` only those of a first run of 15 minutes or more and three more, alike (20 %).
    Without ``strong`` all runs count.

    Runs are strong and of cycle length, or long enough to be the first. Ends are times of the day of the start, to the
    minute, as they are stored: a run past midnight ends, for the next one's gap, on the day it began."""
    kept = runs.where((_size() >= AC_WATTS) & (F.col("duration").between(*CYCLE_MINUTES) | (F.col("duration") >= AC_INITIAL_MINUTES))) if strong else runs
    day = F.floor(F.col("start") / 86_400) * 86_400
    minute = lambda c: F.floor(F.col(c) / 60) * 60
    rows = kept.withColumns({"_at": minute("start"), "_till": day + F.floor((F.col("end") % 86_400) / 60) * 60})
    w = W.partitionBy(*keys).orderBy("_at", "start", "id")
    fresh = F.when(F.col("_at") - F.lag("_till").over(w) <= AC_GAP_MINUTES * 60, 0).otherwise(1)
    rows = rows.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    whole = F.floor(_size())
    found = rows.groupBy(*keys, "session").agg(
        F.min("_at").alias("start"), F.max_by("_till", F.struct("_at", "start", "id")).alias("end"), F.count("*").alias("cycles"), F.avg(whole).alias("magnitude"), F.max(whole).alias("most"),
        F.min_by("duration", F.struct("_at", "start", "id")).alias("first_minutes"), F.when(F.avg(whole) > 0, F.stddev_pop(whole) / F.avg(whole)).otherwise(0.0).alias("cv"),
    )
    good = (F.col("cycles") >= AC_RUNS) & (F.round("first_minutes") >= AC_INITIAL_MINUTES) & (F.col("cv") <= AC_CV)
    return found.where(good) if valid else found


def usage(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_sessions, a count of each season, day, night) of sessions by their start; day is from 6 to 18."""
    at = F.timestamp_seconds("start")
    day = (F.floor(F.col("start") / 3600) % 24).between(6, 17)
    seasons = [F.count_if(F.month(at).isin(*months)).alias(name) for name, months in SEASONS.items()]
    return sessions.groupBy(*keys).agg(F.count("*").alias("n_sessions"), *seasons, F.count_if(day).alias("day"), F.count_if(~day).alias("night"))


def time_distribution(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, a count of each six hours, peak_hour, quiet_hour): of hours with any event the fullest and the emptiest,
    the earlier of equals. ``events`` (keys, start)."""
    hours = events.groupBy(*keys, (F.floor(F.col("start") / 3600) % 24).alias("hour")).agg(F.count("*").alias("c"))
    parts = [F.coalesce(F.sum(F.when(F.floor(F.col("hour") / 6) == k, F.col("c"))), F.lit(0)).alias(name) for k, name in enumerate(("night", "morning", "afternoon", "evening"))]
    peak = F.min(F.struct((-F.col("c")).alias("c"), "hour"))["hour"].alias("peak_hour")
    return hours.groupBy(*keys).agg(F.sum("c").alias("n"), *parts, peak, F.min(F.struct("c", "hour"))["hour"].alias("quiet_hour"))


# ---------------------------------------------------------------- across houses


class Linkage:
    """Groups of signatures in which every two are alike and no house occurs twice, by first fit.

    Merging the pair of groups that covers most houses first, and the earliest of equals, always feeds one group until nothing
    fits it, in order of the signatures, before another begins. So a signature belongs to the first group, by
    its first member, that has room for it. "Every two are alike" asks a group's extremes only: value v joins
    if it is alike to the least and to the largest. Groups are found by cells of both values' logarithms, as
    wide as the tolerance: v fits only groups whose first member lies in the cell of v or one next to it."""

    def __init__(self, like_size: float, like_length: float):
        self.like = (like_size, like_length)
        self.step = tuple(-np.log1p(-x) * (1 + 1e-9) for x in self.like)
        self.cells: dict[tuple[int, int], list[int]] = {}
        self.least: list[list[float]] = []
        self.most: list[list[float]] = []
        self.houses: list[set] = []

    def _fits(self, k: int, house, values: tuple[float, float]) -> bool:
        if house in self.houses[k]:
            return False
        return all(abs(v - edge) <= like * max(v, edge) for v, like, lo, hi in zip(values, self.like, self.least[k], self.most[k], strict=True) for edge in (lo, hi))

    def add(self, house, size: float, length: float) -> int:
        values = (size, length)
        cell = [int(np.floor(np.log(v) / w)) for v, w in zip(values, self.step, strict=True)]
        near = [k for a in (-1, 0, 1) for b in (-1, 0, 1) for k in self.cells.get((cell[0] + a, cell[1] + b), ())]
        for k in sorted(near):
            if self._fits(k, house, values):
                self.houses[k].add(house)
                self.least[k] = list(map(min, self.least[k], values))
                self.most[k] = list(map(max, self.most[k], values))
                return k
        k = len(self.houses)
        self.houses.append({house})
        self.least.append(list(values))
        self.most.append(list(values))
        self.cells.setdefault((cell[0], cell[1]), []).append(k)
        return k


def linked_signatures(signatures: DataFrame, like_size: float = 0.15, like_length: float = 0.20) -> DataFrame:
    """``signatures`` (house_id, pattern_id, magnitude, duration) with ``band`` and ``group`` (unique in a band).

    Signatures whose magnitudes, or whose durations, no chain of likeness joins can't be in one group: occupied
    cells of the magnitude's and then of the duration's logarithm, a tenth of the tolerance wide, are cut where
    a gap of over the tolerance lies between them (some thousand cells at most). A band streams through
    one task in order; its memory is a group's extremes and houses. Where houses are so many that
    no gap is left, a band holds every signature: a few numbers per device of a house."""
    steps = {c: -np.log(1 - like) / 10 for c, like in (("magnitude", like_size), ("duration", like_length))}
    rows = signatures.where("magnitude > 0 and duration > 0").withColumns({f"_{c}": F.floor(F.log(c) / step) for c, step in steps.items()})
    keys = []
    for c in steps:
        cells = rows.select(*keys, f"_{c}").distinct()
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(f"_{c}")  # cells, not rows
        cells = cells.withColumn("fresh", F.when(F.col(f"_{c}") - F.lag(f"_{c}").over(w) <= 11, 0).otherwise(1)).withColumn(f"_band_{c}", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
        rows = rows.join(F.broadcast(cells.drop("fresh")), [*keys, f"_{c}"])
        keys.append(f"_band_{c}")
    rows = rows.withColumn("band", F.format_string("%d-%d", *keys)).select("band", *signatures.columns)
    kinds = dict(signatures.dtypes)
    columns = signatures.columns
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", group long"

    def mark(part: dict) -> list[tuple]:
        linkage = Linkage(like_size, like_length)
        group = [linkage.add(h, float(m), float(d)) for h, m, d in zip(part["house_id"], part["magnitude"], part["duration"], strict=True)]
        return list(zip(*[part[c] for c in columns], group, strict=True))

    return over_stretches(dealt(rows, ["band"]), ["band"], ["house_id", "pattern_id"], mark, schema)


def named_groups(linked: DataFrame, least: int = 2) -> DataFrame:
    """One row per group of ``least`` or more houses: name by descending magnitude, then duration (Device A to
    Z, then #27 and on), ranges, and how good the match is."""
    cv = lambda c: F.stddev_pop(c) / F.avg(c)
    found = linked.groupBy("band", "group").agg(
        F.count_distinct("house_id").alias("n_houses"), F.avg("magnitude").alias("magnitude"), F.avg("duration").alias("duration"), F.min("magnitude").alias("least_watts"), F.max("magnitude").alias("most_watts"),
        F.min("duration").alias("least_minutes"), F.max("duration").alias("most_minutes"), cv("magnitude").alias("m_cv"), cv("duration").alias("d_cv"),
    )
    found = found.where(F.col("n_houses") >= least)
    nth = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("magnitude"), F.desc("duration")))  # groups, not signatures
    good = (F.least(0.3 + 0.14 * F.col("n_houses"), F.lit(1.0)) + F.greatest(1 - 5 * F.col("m_cv"), F.lit(0.0)) + F.greatest(1 - 3.33 * F.col("d_cv"), F.lit(0.0))) / 3
    found = found.withColumns({"nth": nth, "quality": good})
    name = F.concat(F.lit("Device "), F.when(F.col("nth") <= 26, F.chr(64 + F.col("nth"))).otherwise(F.concat(F.lit("#"), F.col("nth").cast("string"))))
    return found.withColumn("name", name).drop("nth", "m_cv", "d_cv")


# ---------------------------------------------------------------- the cascade


def cascade(events: DataFrame, steps: list[tuple[str, callable]]) -> DataFrame:
    """(id, device_type): each step, a function of the events that are left, gives a table of ids that it
    takes; what no step takes is unknown."""
    left, taken = events, []
    for name, step in steps:
        ids = staged(step(left).select("id").distinct())
        taken.append(ids.withColumn("device_type", F.lit(name)))
        left = staged(left.join(ids, "id", "left_anti"))
    return reduce(DataFrame.unionByName, [*taken, left.select("id", F.lit("unknown").alias("device_type"))])


def main_phase_only(boilers: DataFrame) -> DataFrame:
    """Boilers of the phase with most of a house's boilers (ties: the first phase); the others go back."""
    counts = boilers.groupBy("house_id", "phase").agg(F.count("*").alias("c"))
    main = counts.groupBy("house_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "phase")).alias("m")).select("house_id", F.col("m.phase").alias("phase"))
    return boilers.join(main, ["house_id", "phase"], "left_semi")

"""Iterative disaggregation: detect, match, take out, with falling thresholds.

Every step's result is a table in the folder that the cluster names, so a lost executor costs a reread.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.detection import MONTHLY, Features, detect, filled, numbered
from gridloom.operators.edges import sharp_edges
from gridloom.operators.joins import match_candidates
from gridloom.operators.matching import extract, match, minutes_of, profiles_of, restored, rounds_of
from gridloom.sources.work import staged

THRESHOLDS = (2000, 1500, 1100, 800)


def edge_pairs(grid: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of the grid's sharp edges."""
    edges = sharp_edges(grid, threshold, order=("m",))
    ids = F.concat_ws("-", "event", F.col("start").cast("string"))
    side = lambda kind: edges.where(F.col("event") == kind).select("house_id", "phase", ids.alias(f"{kind}_id"), F.col("start").alias(f"{kind}_start"), F.col("end").alias(f"{kind}_end"), F.col("magnitude").alias(f"{kind}_magnitude"))
    return match_candidates(side("on"), side("off"), ["house_id", "phase"])


class Result(NamedTuple):
    """``matches`` of all rounds with iteration and threshold, statuses included; the ``remaining`` grid;
    each round's minutes with the power taken out; and ``profiles`` (keys, iteration, on_id, at, power) by the minute of
    every pair, where they were asked for."""

    matches: DataFrame
    remaining: DataFrame
    rounds: list[DataFrame]
    profiles: DataFrame | None = None


def disaggregate(grid: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS, features: Features = Features(), keys: tuple[str, ...] = MONTHLY, profiles: bool = False) -> Result:
    """Rounds of detection, matching and extraction over ``grid`` (keys, m, watts), each on what the round
    before left. Pairs that cannot be taken out are edges again, as unmatched rows."""
    left, found, rounds, held = staged(grid.select(*keys, "m", "watts")), [], [], []
    for turn, threshold in enumerate(thresholds):
        if features.imputation:
            left = staged(filled(left, keys=keys))
        events = staged(numbered(detect(left, threshold, features, keys=keys), left, turn, keys))
        pairs = staged(match(left, events, keys))
        taken = staged(extract(left, pairs, keys, profiles))
        if profiles:
            held.append(profiles_of(taken, keys).withColumn("iteration", F.lit(turn)))
        kept, lost = restored(pairs, taken, keys)
        edge = lambda kind: lost.where(F.col("event") == kind).select(*keys, F.lit(f"unmatched_{kind}").alias("status"), F.lit(0).alias("stage"), F.col("event_id").alias(f"{kind}_id"), F.col("start").alias(f"{kind}_start"), F.col("end").alias(f"{kind}_end"), F.col("magnitude").alias(f"{kind}_magnitude"), F.lit(0.0).alias("correction"))  # noqa: E731, B023
        found.append(kept.unionByName(edge("on"), allowMissingColumns=True).unionByName(edge("off"), allowMissingColumns=True))
        rounds.append(taken)
        left = minutes_of(taken).select(*keys, "m", F.col("remaining").alias("watts"))
    return Result(rounds_of(found, thresholds), left, rounds, reduce(DataFrame.unionByName, held) if held else None)


def find_previous(runs: DataFrame, run: int) -> DataFrame:
    """Rows (run, house_id, month, phase, m, remaining, ...) of the run before ``run``, projected to raw
    readings (keys, m, watts); an error if that run left none."""
    before = runs.where(F.col("run") == run - 1)
    if before.isEmpty():
        raise LookupError(f"no result of run {run - 1}, on which run {run} builds")
    return before.select(*MONTHLY, "m", F.col("remaining").alias("watts"))

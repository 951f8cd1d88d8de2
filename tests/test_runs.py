"""Greedy groups, linkage, hole repair, versions, profiles, guided recovery, real sources, samples and live sessions."""

import datetime as dt
import json
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import detection, devices, holes, kernels, matching, patterns, recovery, sessions
from gridloom.plans import catalogue, disaggregate, run_queries
from gridloom.sources import files, ingest, responses, versions
from gridloom.sources.tables import ordered_sum
from gridloom.sources.work import staged
from gridloom.streaming.sessions import streaming_sessions

SF = "/root/testdata/sf0.001"
RUN = "house_id long, id long, phase string, start long, end long"


# ---------------------------------------------------------------- greedy groups


def plain_groups(rows, slack):
    """The rule read from the specification: phase by phase, a free reference takes the first free overlap of each later phase."""
    used, out = set(), []
    for house in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == house), key=lambda r: (r[2], r[3], r[1]))
        for h, i, phase, start, end in own:
            if i in used:
                continue
            picks = {}
            for _, j, p, s, e in own:
                if p > phase and p not in picks and j not in used and start - slack <= e and s - slack <= end:
                    picks[p] = j
            if picks:
                used |= {i, *picks.values()}
                out += [(h, i, p, j) for p, j in picks.items()]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_synced_groups_are_those_of_the_greedy_walk(spark, seed):
    rng = np.random.default_rng(seed)
    n = 240
    start = rng.integers(0, (3_000, 60_000, 400_000)[seed % 3], n)
    rows = [(int(rng.integers(0, 4)), i, f"w{rng.integers(1, 4)}", int(s), int(s + rng.integers(0, 3000))) for i, s in enumerate(start)]
    got = patterns.synced(spark.createDataFrame(rows, RUN), 600)
    assert sorted(map(tuple, got.collect())) == plain_groups(rows, 600)


def test_a_taken_overlap_is_passed_over_for_the_next(spark):
    rows = [(1, 1, "w1", 0, 1000), (1, 2, "w1", 10, 1000), (1, 3, "w2", 0, 1000), (1, 4, "w2", 20, 1000)]
    assert sorted(map(tuple, patterns.synced(spark.createDataFrame(rows, RUN)).collect())) == [(1, 1, "w2", 3), (1, 2, "w2", 4)]
    assert patterns.synced(spark.createDataFrame(rows[:2], RUN)).count() == 0
    assert patterns.synced(spark.createDataFrame([], RUN)).count() == 0


def test_a_chain_that_is_passed_over_frees_its_runs(spark):
    rows = [(1, 1, "w1", 0, 60), (1, 2, "w1", 100, 160), (1, 3, "w1", 230, 300), (1, 11, "w2", 10, 60), (1, 12, "w2", 160, 200), (1, 21, "w3", 45, 60), (1, 22, "w3", 300, 360)]
    found = patterns.chained_nearest(spark.createDataFrame(rows, RUN), ["w1", "w2", "w3"], 600)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 11, 21), (1, 3, 12, 22)]  # (2, 12, 21) is not taken, so 12 is free for 3


# ---------------------------------------------------------------- linkage


def merged_in_pairs(rows, like=(0.15, 0.20)):
    """Agglomeration as it is defined: of all pairs of groups that may merge, the one that covers most houses, the first of equals."""
    near = lambda a, b: all(abs(x - y) <= t * max(x, y) for x, y, t in zip(a[2:], b[2:], like))
    groups = [[r] for r in rows]
    while True:
        options = [(-len(a) - len(b), i, j) for (i, a), (j, b) in combinations(enumerate(groups), 2) if not {r[0] for r in a} & {r[0] for r in b} and all(near(x, y) for x in a for y in b)]
        if not options:
            return {frozenset((r[0], r[1]) for r in g) for g in groups}
        _, i, j = min(options)
        groups[i] += groups.pop(j)


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_is_the_agglomeration(spark, seed):
    rng = np.random.default_rng(seed)
    n, houses = 70, (12, 70)[seed % 2]
    house = rng.integers(0, houses, n)
    rows = sorted({(int(h), int(p)): (int(h), int(p), float(m), float(d)) for h, p, m, d in zip(house, rng.integers(0, 40, n), np.round(1000 * np.exp(rng.random(n)), 0), np.round(20 * np.exp(rng.random(n)), 0))}.values())
    linked = patterns.linked_signatures(spark.createDataFrame(rows, "house_id long, pattern_id int, magnitude double, duration double")).collect()
    assert len(linked) == len(rows)
    got = {}
    for r in linked:
        got.setdefault((r.band, r.group), set()).add((r.house_id, r.pattern_id))
    assert set(map(frozenset, got.values())) == merged_in_pairs(rows)


def test_linkage_of_many_signatures_ends():
    rng = np.random.default_rng(1)
    linkage = patterns.Linkage(0.15, 0.20)
    group = [linkage.add(i // 4, m, d) for i, (m, d) in enumerate(np.exp(rng.uniform((6, 2), (9, 5), (40_000, 2))))]
    assert max(Counter(group).values()) > 20


# ---------------------------------------------------------------- holes

KEYS = ("house_id", "phase")
MATCH = "house_id long, phase string, iteration int, on_id string, on_start int, on_end int, off_start int, off_end int, on_magnitude double, off_magnitude double, tag string"


def grid_of(spark, *series):
    rows = [(h, p, m, None if w is None else float(w)) for h, p, watts in series for m, w in enumerate(watts)]
    return spark.createDataFrame(rows, "house_id long, phase string, m int, watts double")


def test_a_hole_becomes_a_wave():
    watts = np.array([300.0] * 10 + [20.0] * 40 + [300.0] * 10)
    rows, left, baseline = holes.mend(np.arange(60), watts, 10, 11, 48, 49, 1500.0, 1200.0)
    assert baseline == 300 and rows.tolist() == list(range(10, 50))
    assert left[0] == 300.0  # 1520 given back, at most what lies over the baseline taken
    profile = np.linspace(1500, 150, 40)
    assert left[-1] == pytest.approx(1520 - 150) and np.allclose(left, 1520 - np.minimum(profile, 1220))


@pytest.mark.parametrize(
    ("watts", "magnitude"),
    [
        ([300.0] * 60, 1500.0),  # as high inside as around
        ([90.0] * 10 + [5.0] * 40 + [90.0] * 10, 500.0),  # under 100 W around
        ([300.0] * 10 + [20.0] * 40 + [300.0] * 10, 2100.0),  # under 15 % of the magnitude
    ],
)
def test_no_hole(watts, magnitude):
    assert holes.mend(np.arange(60), np.array(watts), 10, 11, 48, 49, magnitude, 10.0) is None


def test_the_larger_side_counts_where_the_other_is_missing():
    watts = np.array([20.0] * 40 + [300.0] * 10)
    assert holes.mend(np.arange(50), watts, 0, 1, 38, 39, 1500.0, 1500.0) is not None
    assert holes.mend(np.arange(40), watts[:40], 0, 1, 38, 39, 1500.0, 1500.0) is None


def test_repairs_replace_matches_and_touch_nothing_else(spark):
    hole = [300.0] * 10 + [20.0] * 40 + [300.0] * 10
    grid = grid_of(spark, (1, "w1", hole), (1, "w2", hole), (2, "w1", hole))
    row = lambda house, phase, on_id, tag, at=0: (house, phase, at, on_id, 10, 11, 48, 49, 1500.0, -1200.0, tag)
    rows = [row(1, "w1", "a", "LOOSE-EXTENDED"), row(1, "w1", "a", "EXACT-MEDIUM", 1), row(1, "w2", "b", "EXACT-EXTENDED-CORRECTED"), row(2, "w1", "c", "WAVE-EXTENDED"), row(2, "w1", "d", None)]
    matches = spark.createDataFrame(rows, MATCH)
    left, records, gone = holes.repair_holes(matches, grid, KEYS)
    assert {tuple(r) for r in gone.collect()} == {(1, "w1", 0, "a"), (1, "w2", 0, "b")}
    assert {(r.house_id, r.phase, r.tag, r.on_start, r.on_end, r.off_start, r.off_end, r.minutes, r.off_magnitude) for r in records.collect()} == {(1, p, "WAVE-REPAIR-EXTENDED", 10, 11, 48, 49, 40, -750.0) for p in ("w1", "w2")}
    got = {(r.house_id, r.phase, r.m): r.watts for r in left.collect()}
    assert len(got) == 180 and all(got[2, "w1", m] == hole[m] for m in range(60)) and all(got[1, "w1", m] == hole[m] for m in [*range(10), *range(50, 60)])
    assert sum(got[1, "w1", m] for m in range(60)) == pytest.approx(sum(hole) + 40 * 1500 - sum(r.taken for r in records.collect()) / 2)
    kept = versions.without(matches, gone, [*KEYS, "iteration", "on_id"])
    assert {(r.on_id, r.tag) for r in kept.collect()} == {("a", "EXACT-MEDIUM"), ("c", "WAVE-EXTENDED"), ("d", None)}
    nothing = holes.repair_holes(matches.where("false"), grid, KEYS)
    assert nothing[0].exceptAll(grid).count() == 0 and nothing[1].count() == 0


def plain_repair(rows, series):
    """One match after the other over the whole series."""
    gone, series = [], {k: np.array(v, float) for k, v in series.items()}
    for r in sorted(rows, key=lambda r: (r[2], r[4], r[3])):
        watts = series[r[0], r[1]]
        found = holes.mend(np.arange(len(watts)), watts, *r[4:8], abs(r[8]), abs(r[9]))
        if found is not None and (watts[found[0]] + abs(r[8]) - found[1]).sum() >= 100:
            watts[found[0]] = found[1]
            gone.append((r[0], r[1], r[2], r[3]))
    return gone, series


@pytest.mark.parametrize("seed", range(3))
def test_islands_repair_as_the_whole_series_does(spark, seed):
    rng = np.random.default_rng(seed)
    series = {(h, p): np.where(rng.random(1500).cumsum() % 40 < 20, 400.0, 10.0) for h in (1, 2) for p in ("w1", "w2")}
    rows = []
    for n in range(160):
        at, length = int(rng.integers(0, 1450)), int(rng.integers(4, 45))
        rows.append((int(rng.integers(1, 3)), f"w{rng.integers(1, 3)}", int(rng.integers(0, 3)), f"on{n}", at, at + 1, at + length - 1, at + length, float(rng.integers(100, 2500)), -float(rng.integers(50, 900)), "LOOSE-EXTENDED"))
    gone, want = plain_repair(rows, series)
    left, _, ids = holes.repair_holes(spark.createDataFrame(rows, MATCH), grid_of(spark, *[(*k, v) for k, v in series.items()]), KEYS)
    assert gone and sorted(map(tuple, ids.collect())) == sorted(gone)
    got = {(r.house_id, r.phase, r.m): r.watts for r in left.collect()}
    assert all(got[(*k, m)] == pytest.approx(w) for k, v in want.items() for m, w in enumerate(v))


def test_holes_are_repaired_without_waves_too(spark):
    grid = grid_of(spark, (1, "w1", [300.0] * 10 + [20.0] * 40 + [300.0] * 10))
    matches = spark.createDataFrame([(1, "w1", 0, "a", 10, 11, 48, 49, 1500.0, -1200.0, "LOOSE-EXTENDED")], MATCH)
    out = recovery.recover(grid, matches)
    assert out.waves.count() == 0 and out.matches.count() == 0 and [r.tag for r in out.records.collect()] == ["WAVE-REPAIR-EXTENDED"]


# ---------------------------------------------------------------- versions


def summary(spark, *units):
    rows = [(house, month, m, float(run)) for run, house, month in units for m in range(3)]
    frame = spark.createDataFrame(rows, "house_id long, month string, m int, original_w1 double").withColumn("remaining_w1", F.col("original_w1"))
    return frame.withColumn("run", F.col("original_w1").cast("int"))


def origins(df):
    return {(r.month, r.origin) for r in df.select("month", "origin").distinct().collect()}


def test_missing_months_come_from_the_latest_run_before(spark):
    earlier = summary(spark, (0, 1, "01"), (0, 1, "02"), (0, 1, "03"), (1, 1, "01"), (2, 1, "01"), (5, 1, "02"))
    nothing, raw = earlier.where("false").drop("run"), spark.createDataFrame([], "house_id long, month string, m int, w1 double")
    found = versions.completed(nothing, raw, earlier, 3, ["house_id", "month"], ("w1",))
    assert origins(found) == {("01", "2"), ("02", "0"), ("03", "0")} and found.count() == 9
    assert found.where("remaining_w1 is null or original_w1 is null").count() == 0


def test_months_with_readings_pass_through_first(spark):
    raw = spark.createDataFrame([(1, "01", 0, 5.0), (1, "01", 1, None), (1, "02", 0, 7.0)], "house_id long, month string, m int, w1 double")
    own = summary(spark, (3, 1, "02")).drop("run")
    found = versions.completed(own, raw, summary(spark, (0, 1, "01"), (0, 1, "04")), 3, ["house_id", "month"], ("w1",))
    assert origins(found) == {("01", "passthrough"), ("02", "run"), ("04", "0")}
    assert [(r.m, r.original_w1, r.remaining_w1, r.short_duration_w1) for r in found.where("month = '01'").collect()] == [(0, 5.0, 5.0, 0.0)]
    assert origins(versions.completed(own, raw, None, 0, ["house_id", "month"], ("w1",))) == {("01", "passthrough"), ("02", "run")}


def test_versions_are_written_once_and_read_as_of(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert versions.versions(spark, folder) is None
    for v, rows in ((0, [(1, "a"), (2, "a")]), (2, [(1, "b")])):
        versions.write_version(spark.createDataFrame(rows, "k long, x string"), folder, v)
    with pytest.raises(Exception, match="version=2"):
        versions.write_version(spark.createDataFrame([(9, "z")], "k long, x string"), folder, 2)
    read = lambda v: {(r.k, r.x, r.from_version) for r in versions.as_of(versions.versions(spark, folder), v, ["k"]).collect()}
    assert read(1) == {(1, "a", 0), (2, "a", 0)} and read(2) == {(1, "b", 2), (2, "a", 0)} and read(-1) == set()


# ---------------------------------------------------------------- profiles


def test_profiles_sum_to_the_energy_taken_out(spark):
    watts = [500] * 10 + [2600] * 20 + [500] * 30 + [1700] * 10 + [500] * 10 + [2500, 2500, 2500, 500, 500]
    grid = spark.createDataFrame([(1, "2024-01", "w1", m, float(w)) for m, w in enumerate(watts)], "house_id long, month string, phase string, m int, watts double")
    out = disaggregate.disaggregate(grid, profiles=True)
    held = {(r.iteration, r.on_id): r for r in out.profiles.collect()}
    pairs = out.matches.where("status = 'matched'").collect()
    assert len(pairs) == len(held) == 3
    for p in pairs:
        own = held[p.iteration, p.on_id]
        assert own.at == list(range(p.on_start, p.off_end + 1)) and own.power[-1] == 0 and min(own.power) >= 0
    assert sum(map(sum, (r.power for r in held.values()))) == sum(watts) - sum(r.watts for r in out.remaining.collect())
    assert disaggregate.disaggregate(grid).profiles is None


def test_profiles_of_the_stored_run(spark):
    found = run_queries.device_profiles(spark, SF).collect()
    assert found and all(r.profile_wh == pytest.approx(r.taken_wh, abs=1e-3) for r in found)
    documents = run_queries.profile_documents(spark, SF).collect()
    for r in documents:
        for s in json.loads(r.document)["sessions"]:
            assert s["cycle_count"] == len(s["constituent_events"]) and all(len(e["power_profile"]["minutes"]) == len(e["power_profile"]["values"]) for e in s["constituent_events"])


def test_imputation_fills_short_gaps_only(spark):
    watts = [500.0] * 5 + [None] * 3 + [500.0] * 5 + [None] * 9 + [2500.0] * 5
    grid = spark.createDataFrame([(1, "2024-01", "w1", m, w) for m, w in enumerate(watts)], "house_id long, month string, phase string, m int, watts double")
    got = {r.m: r.watts for r in disaggregate.filled(grid).collect()}
    assert len(got) == len(watts) and [got[m] for m in (5, 6, 7)] == [500.0] * 3 and got[21] is None
    out = disaggregate.disaggregate(grid, (1500,), disaggregate.Features(imputation=True))
    assert out.matches.count() == 0 and out.rounds[0].where("m = 6").first().original == 500.0


# ---------------------------------------------------------------- dominant rounds, guided recovery


def test_one_round_of_alike_runs_makes_a_sequence():
    start = np.array([0, 20, 35, 50, 65, 80.0])
    end = start + np.array([15, 10, 10, 10, 10, 10.0])
    size, rounds = np.array([1500, 1500, 4000, 1500, 1500, 4000.0]), np.array([0, 0, 1, 0, 0, 1])
    assert (kernels.cycles(start, end, size) == -1).all()
    assert (kernels.cycles(start, end, size, rounds) == 0).all()
    assert (kernels.cycles(start, end, size, np.array([0, 0, 1, 0, 2, 1])) == -1).all()
    assert (kernels.cycles(start, end, size, np.full(6, -1)) == -1).all()


def test_guided_sessions_share_minutes_and_find_a_cycle_once(spark):
    watts = [200.0] * 300 + [1100.0] * 8 + [200.0] * 400 + [900.0] * 9 + [200.0] * 20
    grid = grid_of(spark, (1, "w1", watts), (2, "w1", watts))
    leads = spark.createDataFrame([(1, "w1", 280, 320, 1200.0), (1, "w1", 290, 330, 1200.0), (1, "w1", 700, 720, 2000.0), (1, "w2", 0, 800, 1000.0)], "house_id long, phase string, start int, end int, avg_magnitude double")
    assert [tuple(r) for r in recovery.guided(grid, leads).collect()] == [(1, "w1", 300, 308, 900.0)]


# ---------------------------------------------------------------- sources


def test_months_are_discovered_pruned_and_read_in_order(spark, tmp_path):
    for house, month in (("h1", "02_2024"), ("h1", "11_2023"), ("h2", "02_2024")):
        (tmp_path / house).mkdir(exist_ok=True)
        y = int(month[3:])
        pd.DataFrame({"ts": pd.to_datetime([f"{y}-{month[:2]}-02", f"{y}-{month[:2]}-01"]), "w1": [1.0, 2.0]} | ({"w2": [3.0, 4.0]} if y == 2024 else {})).to_parquet(tmp_path / house / f"{house}_{month}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    (tmp_path / "h1" / "notes.txt").write_text("x")
    pd.DataFrame({"ts": pd.to_datetime(["2024-01-01"]), "w1": [9.0]}).to_parquet(tmp_path / "h3.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    root = f"file://{tmp_path}"
    assert [(r.house, r.month, r.place) for r in files.month_files(spark, root).orderBy("house", "place").collect()] == [("h1", "2023-11", 1), ("h1", "2024-02", 2), ("h2", "2024-02", 1)]
    some = files.read_months(spark, root, months=["2024-02"])
    assert {(r.house, r.month) for r in some.select("house", "month").distinct().collect()} == {("h1", "2024-02"), ("h2", "2024-02")} and len(some.inputFiles()) == 2
    assert files.read_months(spark, root, houses=["h2"]).count() == 2
    whole = [(r.ts.month, r.ts.day, r.w2) for r in files.read_house(spark, root, "h1").collect()]
    assert whole == [(11, 1, None), (11, 2, None), (2, 1, 4.0), (2, 2, 3.0)]
    assert [r.w1 for r in files.read_house(spark, root, "h3").collect()] == [9.0]


def test_stored_responses_are_a_source(spark, tmp_path):
    for house, days in (("h1", "20240101_20240108"), ("h1", "20240108_20240115"), ("h2", "20240101_20240108")):
        (tmp_path / house).mkdir(exist_ok=True)
        (tmp_path / house / f"{days}.json").write_text(json.dumps({"sums": {"1": {"60000": "5.5"}, "2": {"60000": "undef"}, "3": {}}}))
    pages = responses.read_responses(spark, str(tmp_path))
    assert {(r.house_id, r.from_day, r.to_day) for r in pages.collect()} == {("h1", "20240101", "20240108"), ("h1", "20240108", "20240115"), ("h2", "20240101", "20240108")}
    one = pages.where("house_id = 'h2'")
    assert one.count() == 1 and one.rdd.getNumPartitions() == 1
    assert pages.where("house_id in ('h1', 'h9') and from_day > '20240105'").count() == 1
    assert {(r.w1, r.w2) for r in ingest.parse_responses(one).collect()} == {(5.5, None)}
    assert responses.read_responses(spark, str(tmp_path / "none")).count() == 0


def test_a_sample_is_whole_under_its_bound_and_uniform_over_it(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") < 50_000, "hot").when(F.col("id") < 59_999, "cold").alias("reason"), F.col("id").alias("number"))
    got = ingest.bottom_sample(rows, ["reason"], 12_000).groupBy("reason").agg(F.count("*").alias("n"), F.avg("number").alias("mean"), F.count_distinct("number").alias("d")).collect()
    found = {r.reason: r for r in got}
    assert {k: (r.n, r.d) for k, r in found.items()} == {"hot": (12_000, 12_000), "cold": (9_999, 9_999), None: (1, 1)}
    assert abs(found["hot"].mean - 25_000) < 6 * 50_000 / (12 * 12_000) ** 0.5
    lines = spark.createDataFrame([("07:00 REJECTED: low value=2 x=3",), ("REJECTED: low value=4",), ("Matched: on_1 d=7",), ("nothing",)], "value string")
    assert {(r.reason, r.n_sampled, r.avg_value, r.p50) for r in ingest.sampled_log(lines).collect()} == {("low", 2, 3.0, 3.0), ("Matched", 1, 7.0, 7.0)}


# ---------------------------------------------------------------- live sessions


@pytest.mark.parametrize("n_files", [1, 4])
def test_live_sessions_are_those_of_the_batch(spark, tmp_path, n_files):
    rng = np.random.default_rng(7)
    at = np.sort(rng.integers(0, 40_000, 120))
    base = 1_704_067_200
    rows = [(int(i % 2), f"w{i % 3}", i, int(s), int(s + rng.integers(1, 900)), float(rng.integers(-2000, 2000))) for i, s in enumerate(at)]
    frame = spark.createDataFrame(rows, "house_id long, phase string, id long, start long, end long, magnitude double").withColumn("duration", F.col("end") - F.col("start")).withColumn("threshold", F.lit(1))
    want = sessions.session_stats(sessions.sessionise(frame, ["house_id", "phase"], "start", "end", 1800, "id"), ["house_id", "phase"])
    live_rows = frame.select("house_id", "phase", "id", *[F.timestamp_seconds(F.col(c) + base).alias(c) for c in ("start", "end")], "magnitude")
    step = -(-len(rows) // n_files)
    for k in range(n_files):  # files overlap in time by less than the watermark's delay
        live_rows.where(F.col("id").between(k * step, (k + 1) * step - 1)).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([(9, "end", -1, 200_000, 200_000, 0.0)], "house_id long, phase string, id long, start long, end long, magnitude double")
    last.select("house_id", "phase", "id", *[F.timestamp_seconds(F.col(c) + base).alias(c) for c in ("start", "end")], "magnitude").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = spark.readStream.schema(live_rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"live{n_files}"
    q = streaming_sessions(live, 1800, "2 hours").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        left = q.lastProgress.stateOperators[0].numRowsTotal
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    key = lambda r: (r.house_id, r.phase, r.n_events, round(r.avg_magnitude, 6), r.max_magnitude)
    assert sorted(map(key, spark.table(name).where("phase <> 'end'").collect())) == sorted(map(key, want.collect()))
    assert left <= 4  # the last event's own state


def test_new_queries_run(spark):
    for name in ("repaired_holes", "recovered_waves", "guided_cycles", "central_acs"):
        assert catalogue.QUERIES[name](spark, SF).columns


def test_large_stored_tables_are_not_broadcast(spark, capsys):
    """Ids in order take few bytes in a file, so that the files' size lets the planner broadcast them."""
    def plan(rows):
        table = staged(spark.range(rows).withColumn("x", F.lit(1.0)))
        table.join(spark.range(3_000_000), "id").explain()
        return capsys.readouterr().out

    assert "Broadcast" in plan(100)
    assert "Broadcast" not in plan(400_000)


def test_every_value_of_a_log_counts_without_a_bound(spark):
    lines = spark.range(100_500).select(F.concat(F.lit("07:00 REJECTED: low value="), F.col("id").cast("string")).alias("value"))
    got = ingest.sampled_log(lines, most=None).collect()
    assert [tuple(r) for r in got] == [("low", 100_500, 50_249.5, 0.0, 100_499.0, 50_249.5)]
    assert ingest.sampled_log(lines).collect()[0].n_sampled == 100_000


def test_sums_in_order_do_not_hang_on_the_deal(spark):
    values = [0.1, 0.2, 0.3, 1e16, 0.7, -1e16, 0.11]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate([*values, None])], "n int, x double")
    for parts in (1, 3, 7):
        got = rows.repartition(parts).agg(ordered_sum(F.col("x"), "n").alias("s")).collect()[0].s
        assert got == sum_in_order(values)
    assert rows.where("x is null").agg(ordered_sum(F.col("x"), "n").alias("s")).collect()[0].s is None


def sum_in_order(values):
    total = 0.0
    for x in values:
        total += x
    return total


def test_readings_around_a_minute_are_not_broadcast_to_few_edges(spark, capsys):
    """Few edges in a long grid: what lies around every minute comes from a join, which no hint on the grid passes."""
    keys = ("house_id", "phase")
    grid = staged(spark.range(200_000).select(F.lit(1).cast("long").alias("house_id"), F.lit("w1").alias("phase"), F.col("id").cast("int").alias("m"), F.lit(1.0).alias("watts")))
    found = staged(spark.createDataFrame([(1, "w1", "on", 5, 5, 900.0), (1, "w1", "off", 9, 9, -900.0)], "house_id long, phase string, event string, start int, end int, magnitude double"))
    for kind in ("on", "off"):
        detection.settle(found, grid, kind, keys).explain()
    devices.extend_tails(found.where("event = 'off'"), grid, keys=keys).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_signatures_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Sums of three in another order end in another digit, which decides pairs exactly a tolerance apart."""
    rows = [(19 + 40 * k, dt.datetime(2024, 1, 1, k), 1, "view", v) for k, v in enumerate((40.31, 254.23, 229.13, 76.52, 148.63))]
    found = set()
    for name, order in (("a", rows), ("b", rows[::-1]), ("c", rows[2:] + rows[:2])):
        spark.createDataFrame(order, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        found.add(catalogue.signatures(spark, f"{tmp_path}/{name}").first().magnitude)
    assert len(found) == 1


def test_signatures_of_zero_pair_as_in_the_sql(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 20.0), (2, 0, 0.0, 20.0), (3, 0, 5.0, 20.0)], "house_id long, pattern_id long, magnitude double, duration double")
    assert [(r.house_id_a, r.house_id_b) for r in sessions.signature_pairs(rows, 0.02, 0.05).collect()] == [(1, 2)]

"""Devices, patterns and recovery on small tables, and kernels on stretches against kernels on whole series."""

import numpy as np
import pytest

from gridloom.operators import edges, kernels, patterns, quality, recovery
from gridloom.plans.pattern_queries import classifiers
from gridloom.sources import ingest

GRID = "house_id long, phase string, m int, watts double"
RUN = "house_id long, phase string, id long, start long, end long, magnitude double, duration double, iteration long"


def grid_of(spark, **phases):
    return spark.createDataFrame([(1, p, m, float(w)) for p, watts in phases.items() for m, w in enumerate(watts)], GRID)


def noise(seed, n=900):
    """Jumps that fade, at their own speeds, under a little noise."""
    rng = np.random.default_rng(seed)
    out, fade = [0.0], 0.8
    for _ in range(n - 1):
        jump = rng.random() < 0.06
        fade = rng.choice([0.7, 0.9, 1.0, -0.5]) if jump else fade
        out.append(out[-1] * fade + (rng.uniform(300, 2500) if jump else rng.normal(0, 10)))
    return 300 + np.abs(np.array(out))


@pytest.mark.parametrize("seed", range(3))
def test_stretches_give_what_the_whole_series_gives(spark, seed):
    watts = noise(seed)
    grid = grid_of(spark, w1=watts)
    m = np.arange(len(watts))
    got = sorted((r.start, r.peak, r.end) for r in kernels.find_waves(grid).collect())
    assert got == sorted(w[:3] for w in kernels.waves(m, watts)) and got
    d = np.diff(watts)
    want = sorted((e, *x[:2]) for e, s in (("on", 1), ("off", -1)) for x in kernels.gradual_edges(m[1:], d, 700, s))
    got = kernels.gradual(edges.with_diff(grid, order=("m",)), 700).collect()
    assert sorted((r.event, r.start, r.end) for r in got) == want and want
    rng = np.random.default_rng(seed)
    start = np.sort(rng.integers(0, 3000, 150)).astype(float)
    end, size = start + rng.integers(1, 35, 150), rng.choice([500.0, 1500.0, 1550.0, 1600.0], 150)
    rows = [(1, "w1", i, float(s), float(e), float(x)) for i, (s, e, x) in enumerate(zip(start, end, size, strict=True))]
    got = {r.id: r.sequence for r in kernels.cycling(spark.createDataFrame(rows, "house_id long, phase string, id long, start double, end double, magnitude double")).collect()}
    want = kernels.cycles(start, end, size)
    blocks = lambda label: sorted(sorted(i for i in range(150) if label[i] == x) for x in {label[i] for i in range(150)} - {-1})
    assert blocks(got) == blocks(want)


def test_clusters_against_all_distances():
    points = np.random.default_rng(4).normal(0, 1, (200, 3))
    near = (np.linalg.norm(points[:, None] - points, axis=2) <= 0.6) & ~np.eye(200, dtype=bool)
    core = near.sum(1) >= 3
    got = kernels.clusters(points, 0.6)
    for i in range(200):
        assert (got[i] < 0) == (not core[i] and not (near[i] & core).any())
        assert all(got[j] == got[i] for j in np.flatnonzero(near[i] & core)) or not core[i]


def run(i, phase, start, minutes, watts, turn=0):
    return (1, phase, i, start * 60, (start + minutes) * 60, float(watts), float(minutes), turn)


def classes(spark, *rows):
    events = spark.createDataFrame(rows, RUN)
    return {r.id: r.device_type for r in patterns.cascade(events, classifiers(events)).collect()}


def test_boilers(spark):
    assert classes(spark, run(1, "w1", 0, 15, 1500), run(2, "w1", 2000, 14, 1500), run(3, "w1", 4000, 15, 1400), run(4, "w1", 6000, 30, 2000), run(5, "w1", 6090, 30, 2000)) == {1: "boiler", 2: "unknown", 3: "unknown", 4: "boiler", 5: "boiler"}


def test_devices_on_several_phases_and_acs(spark):
    rows = [run(1, "w1", 0, 30, 2000), run(2, "w2", 2, 28, 1900), run(3, "w3", 1, 29, 2100)]
    rows += [run(10 + k, "w1", 5000 + (20 + 15 * (k - 1) if k else 0), 15 if k == 0 else 10, 1200) for k in range(4)]
    rows += [run(20 + k, "w2", 5005 + (20 + 15 * (k - 1) if k else 0), 15 if k == 0 else 10, 1200) for k in range(4)]
    rows += [run(30 + k, "w3", 9000 + (20 + 15 * (k - 1) if k else 0), 15 if k == 0 else 10, 1200) for k in range(4)]
    got = classes(spark, *rows)
    assert {got[i] for i in (1, 2, 3)} == {"three_phase_device"}
    assert {got[i] for i in (*range(10, 14), *range(20, 24))} == {"central_ac"}
    assert {got[i] for i in range(30, 34)} == {"regular_ac"}


def test_chains_take_a_run_once(spark):
    rows = [run(1, "w1", 0, 5, 1), run(2, "w1", 4, 5, 1), run(3, "w2", 1, 5, 1), run(4, "w3", 2, 5, 1), run(5, "w1", 500, 5, 1)]
    assert [tuple(r) for r in patterns.chained_nearest(spark.createDataFrame(rows, RUN), ["w1", "w2", "w3"]).collect()] == [(1, 1, 3, 4)]


def test_last_in_first_out():
    at, kind = np.arange(6.0), np.array(["on", "on", "off", "off", "off", "on"])
    assert patterns.last_in_first_out(at, kind, np.array([1000.0, 2000, 2100, 900, 900, 5]), 360) == [(1, 2), (0, 3)]
    assert patterns.last_in_first_out(at[:2], np.array(["on", "off"]), np.array([1.0, 999]), 360) == []


def test_recurring_times_follow_the_mean():
    assert patterns.recurring_times(np.array([10.0, 40, 60, 400, 410]), np.array([20.0, 21, 20, 20, 20])).tolist() == [0, 0, 0, -1, -1]
    assert patterns.recurring_times(np.array([]), np.array([])).tolist() == []


def test_complete_linkage_needs_every_pair_and_one_pattern_a_house(spark):
    linkage = patterns.Linkage(0.15, 0.20)
    got = [linkage.add(h, s, 20.0) for h, s in ((1, 1000.0), (2, 1100.0), (3, 1220.0), (1, 1010.0))]
    assert got[0] == got[1] != got[2] and got[3] not in (got[0],)
    rows = [(1, 0, 1000.0, 20.0), (2, 0, 1010.0, 20.0), (3, 0, 3000.0, 30.0), (4, 0, 3010.0, 30.0), (5, 0, 90.0, 30.0)]
    linked = patterns.linked_signatures(spark.createDataFrame(rows, "house_id long, pattern_id int, magnitude double, duration double"))
    assert {(r.name, r.n_houses, round(r.magnitude)) for r in patterns.named_groups(linked).collect()} == {("Device A", 2, 3005), ("Device B", 2, 1005)}


def test_compressor_cycles_take_a_fall_once():
    d = np.zeros(40)
    d[[1, 2, 6, 20]] = 1500, 1500, -1500, -1400
    assert quality.compressor_cycles(d) == 2
    d[20] = 0
    assert quality.compressor_cycles(d) == 1


def test_a_sharp_rate_of_one_half_gives_all_points(spark):
    watts = [0, 1500, 0, 700, 1400, 0]  # one sharp crossing of two
    rows = [(1, "w1", i, float(w)) for i, w in enumerate(watts)]
    series = spark.createDataFrame(rows, "house_id long, phase string, event_id long, watts double").selectExpr("*", "timestamp_seconds(1704067200 + event_id * 60) AS ts")
    assert quality.phase_measures(series).first().sharp_rate == 0.5
    assert quality.scores(series).first().sharp_points == 20


FADE = 200 + 2300 * np.exp(np.log(0.05) / 20 * np.arange(21))
WAVE = [200.0] * 5 + FADE.tolist() + [200.0] * 30


def test_waves_are_taken_out_and_checked(spark):
    weak = [100.0] * 5 + (100 + 300 * np.exp(np.log(0.05) / 20 * np.arange(21))).tolist() + [100.0] * 30
    grid = grid_of(spark, w1=WAVE, w2=weak, w3=[50.0] * 56)
    waves, left, checks, records, _ = recovery.recover(grid)
    assert {(r.phase, r.crossed) for r in waves.collect()} == {("w1", False), ("w2", True)}
    assert all(r.valid for r in checks.collect())
    rest = {(r.phase, r.m): r.watts for r in left.collect()}
    assert min(rest.values()) >= 0 and rest["w1", 5] == pytest.approx(200) and rest["w3", 10] == 50 and len(rest) == 168
    record = {r.phase: r for r in records.collect()}["w1"]
    assert record.tag == "WAVE-MEDIUM" and record.off_magnitude == -0.5 * record.on_magnitude


def test_guided_recovery_finds_the_cycle_that_was_missed(spark):
    sessions = spark.createDataFrame([(1, "w1", 5, 1200.0, 10.0, 0.1, 0, 60), (1, "w1", 2, 1200.0, 10.0, 0.1, 0, 60)], "house_id long, phase string, cycles int, avg_magnitude double, avg_duration double, magnitude_cv double, start int, end int")
    lead = recovery.leads(sessions)
    assert [r.threshold for r in lead.collect()] == [720.0]
    grid = grid_of(spark, w1=[200.0] * 30 + [1100.0] * 8 + [200.0] * 40)
    assert [(r.on_start, r.off_start, r.magnitude) for r in recovery.guided(grid, lead).collect()] == [(30, 38, 900.0)]


def test_every_number_of_a_log_line(spark):
    lines = spark.createDataFrame([("REJECTED: negative min=-12.5 max= 7",), ("none",)], "value string")
    assert {(r.key, r.number) for r in ingest.numbers_of(lines).collect()} == {("min", -12.5), ("max", 7.0)}


def test_stacks_of_series_without_pairs(spark):
    edges_ = spark.createDataFrame([(1, "w1", "on", "a", 0, 900.0), (1, "w1", "off", "b", 5, -900.0), (2, "w1", "on", "c", 0, 900.0)], "house_id long, phase string, event string, id string, at long, magnitude double")
    for some in (edges_, edges_.where("house_id = 2")):
        got = patterns.stack_pairs(some, ["house_id", "phase"]).collect()
        assert [(r.house_id, r.on_id, r.off_id) for r in got] == ([(1, "a", "b")] if some is edges_ else [])


def test_recurring_step_of_the_cascade_with_runs_of_no_power(spark):
    events = spark.createDataFrame([(1, "w1", n, n * 86_400, n * 86_400 + 600, 0.0 if n % 2 else 900.0, 10.0, 0) for n in range(12)], RUN)
    name, step = classifiers(events)[-1]
    assert name == "recurring_pattern"
    assert {r.id for r in step(events).collect()} <= set(range(12))

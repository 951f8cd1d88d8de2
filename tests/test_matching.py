"""Detection, matching and extraction on small series, with results worked out by hand."""

import numpy as np
import pandas as pd
import pytest

from gridloom.operators import detection, matching
from gridloom.plans.disaggregate import disaggregate, find_previous


def signal(*watts):
    return matching.Signal(np.arange(len(watts)), np.array(watts, float))


HOLE = float("nan")


# Signals and verdicts of the specified cases (fixed values); the last four are our own.
@pytest.mark.parametrize(
    ("watts", "pair", "magnitude", "taken"),
    [
        ([0, 0, 1559, 1559, 1559, 0, 0], (2, 2, 5, 5), 1570, True),
        ([500, 500, 2070, 2070, 2070, 2145, 2145, 2145, 545, 500], (2, 2, 8, 9), 1570, True),
        ([500, 500, 2070, 2070, 1400, 2700, 1400, 2700, 2070, 500, 500], (2, 2, 9, 9), 1570, False),
        ([500, 500, *[2000] * 6, 500, 500], (2, 2, 8, 8), 1500, True),
        ([200, 200, 2600, 2600, HOLE, HOLE, 200, 2600, 2600, 2600, 200, 200, 2600, 200, 200], (2, 2, 13, 13), 2400, False),
        ([500, 500, 2000, 1200, 2000, 500, 500], (2, 2, 5, 5), 1500, True),  # a dip among two readings is no verdict
        ([500, 500, 2000, 600, 2000, 2000, 500, 500], (2, 2, 6, 6), 1500, False),  # among three it is
        ([500, 500, 2000, HOLE, 600, 2000, 500, 500], (2, 2, 6, 6), 1500, True),  # two of them known
        ([500, 500, 2000, 2000, 2000, 2000, 500, 500], (2, 2, 6, 6), 1500, True),
    ],
)
def test_trial_subtraction(watts, pair, magnitude, taken):
    assert (matching.correction_of(signal(*watts), pair, magnitude) is not None) == taken


def test_a_small_negative_is_a_correction():
    found = matching.correction_of(signal(0, 0, 1559, 1559, 1559, 0, 0), (2, 2, 5, 5), 1570)
    assert found == 0.0
    assert matching.correction_of(signal(500, 495, 2000, 1990, 1990, 480, 480), (2, 2, 5, 6), 1505) == pytest.approx(0.0)
    assert matching.correction_of(signal(3, 3, 1503, 1490, 0, 0), (2, 2, 4, 5), 1500) is not None


def edges_of(kind, *rows):
    return pd.DataFrame([(f"{kind}{n}", s, e, float(x)) for n, (s, e, x) in enumerate(rows)], columns=["event_id", "start", "end", "magnitude"])


def run(watts, on, off):
    return matching.match_series(signal(*watts), matching.Edges(edges_of("on", *on)), matching.Edges(edges_of("off", *off)))


def test_clean_pairs_first_and_once():
    watts = [0, 0, *[1500] * 5, 0, 0, *[1500] * 5, 0, 0]
    found = run(watts, [(2, 2, 1500), (9, 9, 1500)], [(7, 7, -1500), (14, 14, -1500)])
    assert [(r[0], r[1], r[2], r[3]) for r in found] == [("matched", 1, "on0", "off0"), ("matched", 1, "on1", "off1")]


def test_a_pair_with_a_load_between_is_noisy():
    watts = [500, 500, *[2000] * 3, *[2400] * 2, *[2000] * 2, 650, 650]
    found = run(watts, [(2, 2, 1500)], [(9, 9, -1350)])
    assert found[0][:4] == ("matched", 2, "on0", "off0")


def test_a_partial_pair_leaves_a_remainder():
    watts = [0, 0, *[3000] * 5, 1500, 1500, 1500, 0, 0]
    found = run(watts, [(2, 2, 3000)], [(7, 7, -1500)])
    assert found[0][:4] == ("matched", 3, "on0", "off0") and found[0][8] == 1500
    assert found[1][:3] == ("remainder_on", 3, "on0_remainder") and found[1][8] == 1500


def test_what_does_not_fit_stays_open():
    found = run([0, 0, *[1500] * 5, 0], [(2, 2, 1500)], [(1, 1, -1500)])
    assert sorted(r[0] for r in found) == ["unmatched_off", "unmatched_on"]
    far = run([0, 0, *[1500] * 400, 0], [(2, 2, 1500)], [(402, 402, -1500)])
    assert sorted(r[0] for r in far) == ["unmatched_off", "unmatched_on"]


def pairs(*rows):
    return pd.DataFrame(rows, columns=["stage", "on_id", "on_start", "on_end", "off_start", "off_end", "on_magnitude", "minutes"])


def test_extraction_leaves_the_base():
    left, taken, skipped = matching.extract_series(signal(500, 500, *[2000] * 6, 500, 500), pairs((1, "a", 2, 2, 8, 9, 1500.0, 7)))
    assert skipped == [] and left.tolist() == [500.0] * 10 and taken[1].sum() == 9000


def test_extraction_leaves_others_load_in_noisy_pairs():
    left, _, skipped = matching.extract_series(signal(500, 500, 2000, 2000, 2000, 3000, 3000, 2000, 500, 500), pairs((2, "a", 2, 2, 8, 9, 1500.0, 7)))
    assert skipped == [] and left[5] == left[6] == 1500 and left[3] == 500


def test_extraction_follows_a_dip():
    left, taken, skipped = matching.extract_series(signal(500, 500, 2000, 2000, 2000, 1200, 1200, 2000, 500, 500), pairs((1, "a", 2, 2, 8, 9, 1500.0, 7)))
    assert skipped == [] and taken[1][5] <= 1210 and left.min() >= 0


def test_a_pair_that_would_go_under_zero_is_skipped():
    left, taken, skipped = matching.extract_series(signal(500, 500, 2000, 300, 300, 2000, 500), pairs((3, "a", 2, 2, 5, 6, -1.0, 4), (2, "b", 2, 2, 3, 4, 1500.0, 2)))
    assert "b" in skipped or left.min() >= 0


def minutes(spark, watts, house=1):
    return spark.createDataFrame([(house, "2024-01", "w1", m, None if w is None else float(w)) for m, w in enumerate(watts)], "house_id long, month string, phase string, m int, watts double")


def found_edges(spark, watts, rows):
    return minutes(spark, watts), spark.createDataFrame([(1, "2024-01", "w1", *r) for r in rows], "house_id long, month string, phase string, event string, start int, end int, magnitude double")


@pytest.mark.parametrize(
    ("kind", "watts", "edge", "want"),
    [
        ("on", [500, 500, 3500, 2000, 2000, 2000, 2000, 500], ("on", 2, 2, 3000.0), (2, 3, 1500.0)),
        ("on", [500, 500, 3500, 3500, 2000, 2000], ("on", 2, 2, 3000.0), (2, 2, 3000.0)),
        ("on", [500, 500, 3500, 3400, 3400], ("on", 2, 2, 3000.0), (2, 2, 3000.0)),
        ("off", [500, 500, 2000, 2000, 2000, 2000, 3000, 500, 500], ("off", 7, 7, -2500.0), (6, 7, -1500.0)),
        ("off", [2000, 2000, 500, 500], ("off", 2, 2, -1500.0), (2, 2, -1500.0)),
    ],
)
def test_overshoot_settles(spark, kind, watts, edge, want):
    grid, edges = found_edges(spark, watts, [edge])
    row = detection.settle(edges, grid, kind).first()
    assert (row.start, row.end, row.magnitude) == want
    assert (row.original_magnitude == edge[3]) == (want != edge[1:])


def test_an_overshoot_ends_at_the_next_edge(spark):
    grid, edges = found_edges(spark, [500, 500, 3500, 2000, 2000, 2000], [("on", 2, 2, 3000.0), ("off", 3, 3, -1500.0)])
    assert {(r.event, r.end) for r in detection.settle(edges, grid, "on").collect()} == {("on", 2), ("off", 3)}


@pytest.mark.parametrize(("watts", "ons", "want"), [([2500, 2500, 1200, 1200, 0, 0], [], [(2, 4, -2500.0, 2)]), ([2500, 2500, 1200, 1200, 0, 0], [3], [(2, 2, -1300.0, 1), (4, 4, -1200.0, 1)]), ([2500, 2500, 100, 100, 0, 0], [], [(2, 2, -1300.0, 1), (4, 4, -1200.0, 1)])])
def test_split_offs_merge(spark, watts, ons, want):
    grid, edges = found_edges(spark, watts, [("off", 2, 2, -1300.0), ("off", 4, 4, -1200.0), *[("on", m, m, 1.0) for m in ons]])
    found = detection.merge_split_offs(edges.where("event = 'off'"), edges.where("event = 'on'"), grid)
    assert sorted((r.start, r.end, r.magnitude, r.n_merged) for r in found.collect()) == want


def test_split_offs_merge_where_nothing_was_read_between(spark):
    grid, edges = found_edges(spark, [2500, 2500], [("off", 2, 2, -1300.0), ("off", 4, 4, -1200.0)])
    found = detection.merge_split_offs(edges, edges.where("false"), grid).collect()
    assert [(r.start, r.end, r.magnitude) for r in found] == [(2, 4, -2500.0)]


def test_numbers_run_across_months(spark):
    grid = minutes(spark, [0, 0, 1500, 1500, 0, 0])
    both = grid.unionByName(grid.withColumn("month", grid.month.substr(1, 6)))
    found = detection.numbered(detection.detect(both, 1300), both, 0).collect()
    assert sorted(r.event_id for r in found) == ["off_it0_w1_1", "off_it0_w1_2", "on_it0_w1_1", "on_it0_w1_2"]
    assert {(r.event, r.start, r.nearby_value) for r in found} == {("on", 2, 0.0), ("off", 4, 0.0)}


def test_disaggregate_removes_devices_and_keeps_the_rest(spark):
    watts = [500] * 10 + [2600] * 20 + [500] * 30 + [1700] * 10 + [500] * 10
    out = disaggregate(minutes(spark, watts).unionByName(minutes(spark, [300] * 20, house=2)))
    matched = {(r.on_start, r.iteration, r.tag) for r in out.matches.where("status = 'matched'").collect()}
    assert matched == {(10, 0, "EXACT-MEDIUM"), (60, 2, "EXACT-MEDIUM")}
    left = out.remaining.toPandas()
    assert len(left) == 100 and set(left[left.house_id == 1].watts) == {500.0} and set(left[left.house_id == 2].watts) == {300.0}


def test_an_absent_previous_run_is_an_error(spark):
    runs = minutes(spark, [1]).selectExpr("0 AS run", "*", "watts AS remaining")
    assert find_previous(runs, 1).count() == 1
    with pytest.raises(LookupError, match="run 1"):
        find_previous(runs, 2)

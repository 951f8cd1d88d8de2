"""Results that must not hang on the order in which rows arrive."""

import datetime as dt
from itertools import permutations

import numpy as np

from gridloom.operators import detection, quality


def test_split_offs_at_half_the_magnitude_merge_whatever_the_order(spark):
    """(0.1 + 0.2) + 0.3 is not 0.3 + 0.2 + 0.1 in doubles, and the limit is met exactly in order of minutes only."""
    watts, keys = [0.1, 0.2, 0.3], ("house_id", "phase")
    size = -2 * ((watts[0] + watts[1]) + watts[2]) / 3
    off = [(h, "w1", s, e, x) for h in range(60) for s, e, x in ((0, 1, -5.0), (3, 3, size))]
    edges = spark.createDataFrame(off, "house_id long, phase string, start int, end int, magnitude double")
    none = edges.where("start < 0")
    for order in permutations(range(3)):
        grid = spark.createDataFrame([(h, "w1", 1 + i, watts[i]) for h in range(60) for i in order], "house_id long, phase string, m int, watts double")
        got = detection.merge_split_offs(edges, none, grid.repartition(7, "m"), keys).collect()
        assert sorted((r.house_id, r.start, r.end, r.n_merged) for r in got) == [(h, 0, 3, 2) for h in range(60)]


def test_points_keep_every_digit(spark):
    rng = np.random.default_rng(6)
    rows = [(h, "2024-01", f"w{p}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=3 * i + p), 300 * h + 3 * i + p, float(x)) for h in range(40) for p in (1, 2, 3) for i, x in enumerate(rng.exponential(100, 40 + 3 * p).round(2) * 10)]
    found = [quality.scores(dealt, quality.compressors(dealt, 30), 30).orderBy("house_id").collect() for dealt in dealings(spark, rows)]
    assert all(x == found[0] for x in found)


def dealings(spark, rows):
    """The rows in other orders, shuffled into other numbers of partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for seed, parts in enumerate((1, 5, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            order = np.random.default_rng(seed).permutation(len(rows))
            yield spark.createDataFrame([rows[i] for i in order], "house_id long, month string, phase string, ts timestamp, event_id long, watts double").repartition(seed + 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

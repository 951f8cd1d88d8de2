"""Queries on runs of devices: neighbours, chains, cascades, confidence, recurrence, patterns across houses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators import devices, kernels, patterns, sessions
from gridloom.operators.detection import Features
from gridloom.operators.edges import sharp_edges
from gridloom.plans.disaggregate import THRESHOLDS
from gridloom.plans.registry import EPOCH, SEC, query, rounded
from gridloom.sources.tables import dense_grid, power_series, read
from gridloom.sources.work import staged

#: Every event as a run: three users are a house, a user a phase; minutes follow the id, watts the value.
RUNS_SQL = f"""WITH r AS (SELECT user_id // 3 AS house_id, 'w' || CAST(user_id % 3 + 1 AS VARCHAR) AS phase, event_id AS id, event_type, {EPOCH.format("ts")} AS s, {EPOCH.format("ts")} + (event_id % 40 + 1) * 60 AS e,
  value * 10 AS magnitude, CAST(event_id % 40 + 1 AS DOUBLE) AS duration, event_id % 4 AS iteration, CAST(month(ts) AS BIGINT) AS month FROM events)"""


def runs(spark, sf_dir) -> DataFrame:
    start, minutes = SEC("ts"), F.col("event_id") % 40 + 1
    return read(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 3).alias("house_id"), F.concat(F.lit("w"), (F.col("user_id") % 3 + 1).cast("string")).alias("phase"), F.col("event_id").alias("id"), "event_type", start.alias("start"), (start + minutes * 60).alias("end"),
        (F.col("value") * 10).alias("magnitude"), minutes.cast("double").alias("duration"), (F.col("event_id") % 4).alias("iteration"), F.month("ts").cast("long").alias("month"),
    )


#: Chains in recursive SQL: a house's chains are asked one after the other, ``used`` are the runs of those taken.
CHAIN_SQL = "WITH RECURSIVE" + RUNS_SQL.removeprefix("WITH") + """,
b2 AS (SELECT * FROM (SELECT a.id AS i1, a.house_id, a.s AS s1, b.id AS i2, b.s AS s2, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.s - a.s), b.s, b.id) AS n FROM r a JOIN r b ON a.house_id = b.house_id AND a.phase = 'w1' AND b.phase = 'w2' AND abs(b.s - a.s) <= 14400) WHERE n = 1),
b3 AS (SELECT * FROM (SELECT b2.*, c.id AS i3, c.s AS s3, row_number() OVER (PARTITION BY i1 ORDER BY abs(c.s - s1), c.s, c.id) AS m FROM b2 JOIN r c ON b2.house_id = c.house_id AND c.phase = 'w3' AND abs(c.s - s1) <= 14400) WHERE m = 1),
n AS (SELECT house_id, i1, i2, i3, row_number() OVER (PARTITION BY house_id ORDER BY s1, i1) AS k FROM b3),
walk AS (SELECT DISTINCT house_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, false AS good, CAST(NULL AS BIGINT) AS i1, CAST(NULL AS BIGINT) AS i2, CAST(NULL AS BIGINT) AS i3 FROM n
  UNION ALL SELECT house_id, k, CASE WHEN good THEN list_concat(used, [i1, i2, i3]) ELSE used END, good, i1, i2, i3
  FROM (SELECT w.house_id, n.k, w.used, n.i1, n.i2, n.i3, NOT list_has_any(w.used, [n.i1, n.i2, n.i3]) AS good FROM walk w JOIN n ON n.house_id = w.house_id AND n.k = w.k + 1)),
u3 AS (SELECT house_id, i1, i2, i3 FROM walk WHERE good)"""
PHASES = ["w1", "w2", "w3"]


@query(CHAIN_SQL + " SELECT house_id, i1 AS id_w1, i2 AS id_w2, i3 AS id_w3 FROM u3")
def chained_asof(spark, sf_dir):
    return patterns.chained_nearest(runs(spark, sf_dir), PHASES, 14_400)


@query(CHAIN_SQL + """, a AS (SELECT u3.house_id, i1 AS id, max(r.s) FILTER (WHERE r.id = i1) AS s, max(r.e) AS e, sum(magnitude) AS magnitude, avg(duration) AS duration FROM u3 JOIN r ON r.id IN (i1, i2, i3) GROUP BY u3.house_id, i1),
t AS (SELECT house_id, 'central_ac' AS kind, CAST(NULL AS VARCHAR) AS phase, id, s, e, magnitude, duration FROM a
  UNION ALL SELECT house_id, 'regular_ac', phase, id, s, e, magnitude, duration FROM r WHERE magnitude >= 800 AND (duration BETWEEN 3 AND 30 OR duration >= 15) AND NOT EXISTS (SELECT 1 FROM u3 WHERE r.id IN (i1, i2, i3))),
m AS (SELECT *, s // 60 * 60 AS mn, s // 86400 * 86400 + e % 86400 // 60 * 60 AS till FROM t),
q AS (SELECT *, sum(f) OVER (PARTITION BY house_id, kind, phase ORDER BY mn, s, id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN mn - lag(till) OVER (PARTITION BY house_id, kind, phase ORDER BY mn, s, id) <= 3600 THEN 0 ELSE 1 END AS f FROM m)),
g AS (SELECT house_id, kind, phase, CAST(session AS BIGINT) AS session, min(mn) AS "start", last(till ORDER BY mn, s, id) AS "end", count(*) AS cycles, avg(floor(magnitude)) AS magnitude, CAST(max(floor(magnitude)) AS BIGINT) AS most, first(duration ORDER BY mn, s, id) AS first_minutes,
  coalesce(stddev_pop(floor(magnitude)) / nullif(avg(floor(magnitude)), 0), 0) AS cv FROM q GROUP BY house_id, kind, phase, session)
SELECT house_id, kind, phase, session, "start", "end", cycles, round(magnitude, 4) AS magnitude, most FROM g WHERE kind = 'central_ac' OR cycles >= 4 AND first_minutes >= 15 AND cv <= 0.2""")
def ac_patterns(spark, sf_dir):
    """Central ACs as sessions of chains over all phases, regular ACs as sessions of what chains leave."""
    return rounded(patterns.ac_patterns(runs(spark, sf_dir), PHASES, 14_400))


NEAR_SQL = RUNS_SQL + """, b AS (SELECT * FROM r WHERE duration >= 15 AND magnitude >= 1500)"""


def _large(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = runs(spark, sf_dir)
    return events, events.where("duration >= 15 and abs(magnitude) >= 1500")


@query(NEAR_SQL + """, c AS (SELECT b.id, count(o.id) AS n FROM b LEFT JOIN r o ON o.house_id = b.house_id AND o.phase = b.phase AND o.duration BETWEEN 3 AND 24 AND o.magnitude >= 800 AND abs(o.s - b.s) <= 21600 AND o.id <> b.id GROUP BY b.id)
SELECT id, n AS n_cycles, CASE WHEN n >= 2 THEN 'ac' ELSE 'boiler' END AS kind FROM c""")
def boilers_and_acs(spark, sf_dir):
    events, large = _large(spark, sf_dir)
    return patterns.nearby_cycles(large, events, 21_600).select("id", "n_cycles", F.when(F.col("n_cycles") >= 2, "ac").otherwise("boiler").alias("kind"))


@query(NEAR_SQL + """ SELECT id FROM b WHERE (SELECT count(*) FROM r o WHERE o.house_id = b.house_id AND o.phase = b.phase AND o.id <> b.id AND o.duration BETWEEN 3 AND 30 AND o.magnitude >= 800 AND abs(o.s - b.s) <= 21600
  AND o.magnitude >= 0.5 * b.magnitude AND o.e >= b.s - 300 AND NOT (o.s >= b.s AND o.e <= b.e)) < 2""")
def compressor_free(spark, sf_dir):
    events, large = _large(spark, sf_dir)
    return patterns.compressor_near(large, events, 21_600).select("id")


#: Greedy groups in recursive SQL: a house's sessions are asked one after the other, ``used`` are those taken so far.
OVERLAP_SQL = "WITH RECURSIVE" + RUNS_SQL.removeprefix("WITH") + """, c AS (SELECT a.id, list(b.id ORDER BY b.s, b.id) FILTER (WHERE b.phase = 'w2' AND a.phase = 'w1') AS c2, list(b.id ORDER BY b.s, b.id) FILTER (WHERE b.phase = 'w3' AND a.phase <> 'w3') AS c3
  FROM r a JOIN r b ON a.house_id = b.house_id AND a.phase < b.phase AND a.s <= b.e + 600 AND b.s <= a.e + 600 GROUP BY a.id),
n AS (SELECT r.house_id, r.id, c2, c3, row_number() OVER (PARTITION BY house_id ORDER BY phase, s, r.id) AS k FROM r JOIN c ON c.id = r.id),
walk AS (SELECT DISTINCT house_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS l_id, CAST(NULL AS BIGINT) AS r2, CAST(NULL AS BIGINT) AS r3 FROM n
  UNION ALL SELECT house_id, k, CASE WHEN coalesce(r2, r3) IS NULL THEN used ELSE list_concat(used, list_filter([l_id, r2, r3], lambda x: x IS NOT NULL)) END, l_id, r2, r3
  FROM (SELECT w.house_id, n.k, w.used, n.id AS l_id, CASE WHEN list_contains(w.used, n.id) THEN NULL ELSE list_filter(n.c2, lambda x: NOT list_contains(w.used, x))[1] END AS r2, CASE WHEN list_contains(w.used, n.id) THEN NULL ELSE list_filter(n.c3, lambda x: NOT list_contains(w.used, x))[1] END AS r3
    FROM walk w JOIN n ON n.house_id = w.house_id AND n.k = w.k + 1)),
o AS (SELECT house_id, l_id, 'w2' AS phase, r2 AS r_id FROM walk WHERE r2 IS NOT NULL UNION ALL SELECT house_id, l_id, 'w3', r3 FROM walk WHERE r3 IS NOT NULL)"""


@query(OVERLAP_SQL + " SELECT house_id, l_id, phase, r_id FROM o")
def first_overlaps(spark, sf_dir):
    """Sessions of several phases that run together, each used once."""
    return patterns.synced(runs(spark, sf_dir))


def _up(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} <= {low} THEN 0.5 WHEN {x} >= {high} THEN 1.0 ELSE 0.5 + 0.5 * ({x} - {low}) / ({high} - {low}) END"


def _down(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} <= {low} THEN 1.0 WHEN {x} >= {high} THEN 0.5 ELSE 1.0 - 0.5 * ({x} - {low}) / ({high} - {low}) END"


@query(OVERLAP_SQL + f""", w AS (SELECT l_id, r.magnitude AS size, r.s AS st, r.duration FROM o JOIN r ON r.id = o.r_id UNION ALL SELECT DISTINCT l_id, r.magnitude, r.s, r.duration FROM o JOIN r ON r.id = o.l_id),
g AS (SELECT l_id, count(*) AS n_phases, (max(st) - min(st)) / 60 AS late, CASE WHEN avg(size) > 0 THEN stddev_pop(size) / avg(size) END AS s_cv, CASE WHEN avg(duration) > 0 THEN stddev_pop(duration) / avg(duration) END AS d_cv FROM w GROUP BY l_id)
SELECT l_id, n_phases, round({_down("late", 0, 10)}, 4) AS sync, round({_down("s_cv", 0, 0.5)}, 4) AS balance,
  round(CASE WHEN n_phases >= 3 AND s_cv <= 0.10 THEN 1.0 ELSE ({_down("s_cv", 0, 0.3)} + CASE WHEN n_phases >= 3 THEN 1.0 ELSE 0.7 END + {_down("late", 0, 15)} + {_down("d_cv", 0, 0.5)}) / 4.0 END, 4) AS three_phase FROM g""")
def multi_phase_sessions(spark, sf_dir):
    return rounded(patterns.multi_phase(runs(spark, sf_dir)))


@query(RUNS_SQL + """, k AS (SELECT DISTINCT house_id, s, phase FROM r WHERE iteration = 0 AND duration >= 30) SELECT r.id FROM r JOIN k ON k.house_id = r.house_id AND k.s = r.s AND k.phase = r.phase""")
def event_indices(spark, sf_dir):
    """Rows of a house that share start and phase with a chosen event."""
    events = runs(spark, sf_dir)
    return events.join(events.where("iteration = 0 and duration >= 30").select("house_id", "start", "phase"), ["house_id", "start", "phase"], "left_semi").select("id")


SESSIONS_SQL = RUNS_SQL + """, q AS (SELECT *, sum(fresh) OVER (PARTITION BY house_id, phase ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY house_id, phase ORDER BY s, id) <= 28800 THEN 0 ELSE 1 END AS fresh FROM r)),
t AS (SELECT *, row_number() OVER w AS i, magnitude - lag(magnitude) OVER w AS step, CASE WHEN s - lag(e) OVER w > 0 THEN s - lag(e) OVER w END AS gap FROM q WINDOW w AS (PARTITION BY house_id, phase, session ORDER BY s, id)),
m AS (SELECT house_id, phase, CAST(session AS BIGINT) AS session, count(*) AS n, coalesce(min_by(duration, i) FILTER (WHERE duration >= 10), max(duration)) AS anchor, avg(magnitude) AS mean_size, avg(duration) AS mean_length, CASE WHEN avg(magnitude) > 0 THEN stddev_pop(magnitude) / avg(magnitude) ELSE 0 END AS size_cv,
  CASE WHEN count(*) >= 3 THEN stddev_pop(duration) FILTER (WHERE i > 1) / avg(duration) FILTER (WHERE i > 1) ELSE 0 END AS length_cv, CASE WHEN count(*) >= 3 AND count(gap) >= 2 THEN stddev_pop(gap) / avg(gap) ELSE 0 END AS gap_cv,
  avg(CASE WHEN duration BETWEEN 3 AND 30 THEN 1.0 ELSE 0.0 END) AS in_range, CASE WHEN count(*) >= 3 THEN (greatest(count(*) FILTER (WHERE step > 0), count(*) FILTER (WHERE step < 0)) + count(*) FILTER (WHERE step = 0)) / count(step) ELSE 1 END AS one_way,
  min(s) AS first, max(s) AS last, min(s) FILTER (WHERE duration BETWEEN 3 AND 30) AS mf, max(s) FILTER (WHERE duration BETWEEN 3 AND 30) AS ml FROM t GROUP BY house_id, phase, session),
l AS (SELECT *, least(first - last_value(ml IGNORE NULLS) OVER (PARTITION BY house_id, phase ORDER BY first, session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(mf IGNORE NULLS) OVER (PARTITION BY house_id, phase ORDER BY first, session ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - last) / 60 AS distance FROM m)"""


def sessioned(spark, sf_dir) -> DataFrame:
    return sessions.sessionise(runs(spark, sf_dir), ["house_id", "phase"], "start", "end", 28_800, "id")


KEYS = ["house_id", "phase", "session"]


@query(SESSIONS_SQL + f""" SELECT house_id, phase, session, n, round(anchor, 4) AS anchor, round(size_cv, 4) AS size_cv, round(length_cv, 4) AS length_cv, round(gap_cv, 4) AS gap_cv, round(one_way, 4) AS one_way,
  round(({_up("n", 4.0, 10)} + {_down("size_cv", 0.05, 0.2)} + {_up("anchor", 10, 20)} + {_up("mean_size", 800, 1600)}) / 4.0, 4) AS confidence,
  round(({_up("n", 4.0, 10)} + {_up("mean_size", 800, 1500)} + {_down("size_cv", 0, 0.3)} + greatest(in_range, 0.5) + {_up("one_way", 0.5, 0.85)} + {_down("length_cv", 0, 0.4)} + {_down("gap_cv", 0, 0.5)}) / 7, 4) AS ac_like FROM l""")
def ac_confidence(spark, sf_dir):
    found = patterns.ac_scores(patterns.cycling_measures(sessioned(spark, sf_dir), KEYS))
    return rounded(found.select(*KEYS, "n", "anchor", "size_cv", "length_cv", "gap_cv", "one_way", "confidence", "ac_like"))


ALONE = f"CASE WHEN distance IS NULL THEN 1.0 ELSE {_up('distance', 0, 30)} END"


def _measured(spark, sf_dir) -> DataFrame:
    rows = sessioned(spark, sf_dir)
    return patterns.cycling_measures(rows, KEYS).join(patterns.distances(rows, KEYS[:2], "session"), KEYS)


@query(SESSIONS_SQL + f""" SELECT house_id, phase, session, round(distance, 4) AS distance, round(({_up("mean_length", 15, 30)} + {_up("mean_size", 1500, 3000)} + CASE WHEN n = 1 THEN 1.0 ELSE 0.6 END + {ALONE}) / 4.0, 4) AS confidence FROM l""")
def boiler_confidence(spark, sf_dir):
    return rounded(patterns.boiler_scores(_measured(spark, sf_dir)).select(*KEYS, "distance", "confidence"))


@query(SESSIONS_SQL + f""", x AS (SELECT *, 1 - ({_up("mean_length", 0, 15)} + {_up("mean_size", 0, 1500)} + CASE WHEN n <= 2 THEN 1.0 WHEN n <= 4 THEN 0.5 ELSE greatest(1 - 0.1 * n, 0) END + {ALONE}) / 4.0 AS not_boiler,
  1 - ({_up("n", 1, 4.0)} + {_up("mean_size", 0, 800)} + {_up("anchor", 0, 10)} + {_down("size_cv", 0, 0.4)}) / 4.0 AS not_ac FROM l)
SELECT house_id, phase, session, round(not_boiler, 4) AS not_boiler, round(not_ac, 4) AS not_ac, round(least(not_boiler, not_ac), 4) AS confidence, CASE WHEN not_boiler <= not_ac THEN 'closest to a boiler' ELSE 'closest to an AC' END AS reason FROM x""")
def unknown_confidence(spark, sf_dir):
    return rounded(patterns.unknown_scores(_measured(spark, sf_dir)).select(*KEYS, "not_boiler", "not_ac", "confidence", "reason"))


@query(SESSIONS_SQL + """ SELECT DISTINCT house_id, phase, CAST(session AS BIGINT) AS session FROM (SELECT house_id, phase, session, iteration FROM q GROUP BY ALL HAVING count(*) >= 2 AND avg(magnitude) >= 800 AND stddev_pop(magnitude) <= 0.5 * avg(magnitude))""")
def dominant_rounds(spark, sf_dir):
    return patterns.dominant_rounds(sessioned(spark, sf_dir), KEYS, 2, 0.5)


@query(RUNS_SQL + """, d AS (SELECT house_id, CAST(floor(magnitude / 500) AS BIGINT) AS cluster, s, id, magnitude, duration, s - lag(s) OVER (PARTITION BY house_id, floor(magnitude / 500) ORDER BY s, id) AS gap0 FROM r WHERE duration BETWEEN 20 AND 26),
d2 AS (SELECT *, CASE WHEN gap0 > 0 THEN gap0 END AS gap FROM d),
k AS (SELECT house_id, cluster, count(*) AS n, stddev_pop(magnitude) / avg(magnitude) AS size_cv, stddev_pop(duration) / avg(duration) AS length_cv, CASE WHEN count(gap) >= 2 THEN CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE 0 END END AS gap_cv FROM d2 GROUP BY house_id, cluster)
SELECT house_id, cluster, n, round((least(0.5 + 0.05 * (n - 3), 1) + greatest(1 - 2 * size_cv, 0) + greatest(1 - 2 * length_cv, 0) + coalesce(least(greatest(1 - 0.5 * gap_cv, 0), 1), 0.5)) / 4.0, 4) AS confidence
FROM k WHERE n >= 3 AND size_cv <= 0.20 AND length_cv <= 0.20""")
def cluster_confidence(spark, sf_dir):
    rows = runs(spark, sf_dir).where("duration between 20 and 26").withColumn("cluster", F.floor(F.col("magnitude") / 500))
    return rounded(patterns.cluster_scores(rows, ["house_id", "cluster"]).drop("reason"))


TYPED = """CASE event_type WHEN 'click' THEN 'regular_ac' WHEN 'view' THEN 'central_ac' WHEN 'purchase' THEN 'boiler' WHEN 'signup' THEN 'three_phase_device' ELSE 'unknown' END"""
TAGGED = """CASE id % 5 WHEN 0 THEN 'EXACT-MEDIUM' WHEN 1 THEN 'NOISY-CLOSE-QUICK' WHEN 2 THEN 'PARTIAL-APPROX-EXTENDED-CORRECTED' WHEN 3 THEN 'LOOSE-SPIKE-TAIL' ELSE '' END"""


def activations(spark, sf_dir) -> DataFrame:
    return runs(spark, sf_dir).withColumns({"device_type": F.expr(TYPED), "tag": F.expr(TAGGED)})


@query(RUNS_SQL + f""", t AS (SELECT *, {TYPED} AS device_type, {TAGGED} AS tag FROM r), md AS (SELECT device_type, quantile_cont(magnitude, 0.5) AS sm, quantile_cont(duration, 0.5) AS lm FROM t WHERE device_type <> 'unknown' GROUP BY device_type),
ad AS (SELECT t.device_type, quantile_cont(abs(magnitude - sm), 0.5) AS sa, quantile_cont(abs(duration - lm), 0.5) AS la FROM t JOIN md ON md.device_type = t.device_type GROUP BY t.device_type),
pc AS (SELECT device_type, phase, count(*) AS c FROM t WHERE device_type <> 'unknown' GROUP BY ALL), mp AS (SELECT device_type, phase AS main FROM (SELECT *, row_number() OVER (PARTITION BY device_type ORDER BY c DESC, phase DESC) AS n FROM pc) WHERE n = 1),
j AS (SELECT t.*, sm, lm, sa, la, main FROM t LEFT JOIN md ON md.device_type = t.device_type LEFT JOIN ad ON ad.device_type = t.device_type LEFT JOIN mp ON mp.device_type = t.device_type),
q AS (SELECT *, CASE WHEN tag = '' THEN 0.3 ELSE CASE WHEN tag LIKE '%EXACT%' THEN 1.0 WHEN tag LIKE '%CLOSE%' THEN 0.8 WHEN tag LIKE '%APPROX%' THEN 0.6 WHEN tag LIKE '%LOOSE%' THEN 0.4 ELSE 0.5 END * CASE WHEN tag LIKE '%PARTIAL%' THEN 0.5 WHEN tag LIKE '%NOISY%' THEN 0.7 ELSE 1.0 END * CASE WHEN tag LIKE '%CORRECTED%' THEN 0.9 ELSE 1.0 END END AS tq,
  CASE iteration WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 ELSE 0.3 END AS it, CASE WHEN sm IS NULL THEN 0.5 WHEN sa = 0 THEN CASE WHEN magnitude = sm THEN 1 ELSE 0.5 END ELSE greatest(1 - least(abs(magnitude - sm) / sa / 3, 1), 0) END AS mf,
  CASE WHEN lm IS NULL THEN 0.5 WHEN la = 0 THEN CASE WHEN duration = lm THEN 1 ELSE 0.5 END ELSE greatest(1 - least(abs(duration - lm) / la / 3, 1), 0) END AS df,
  CASE WHEN device_type IN ('regular_ac', 'central_ac') THEN CASE WHEN month BETWEEN 5 AND 10 THEN 1.0 WHEN month IN (4, 11) THEN 0.7 ELSE 0.3 END WHEN device_type IN ('boiler', 'three_phase_device') THEN 0.8 ELSE 0.5 END AS sf,
  CASE WHEN device_type IN ('central_ac', 'three_phase_device') OR phase = main THEN 1.0 ELSE 0.5 END AS pf FROM j),
z AS (SELECT id, device_type, least(0.25 * tq + 0.15 * it + 0.20 * mf + 0.15 * df + 0.10 * sf + 0.15 * pf + 0.05, 1) AS confidence FROM q)
SELECT id, device_type, round(confidence, 4) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM z""")
def activation_confidence(spark, sf_dir):
    return rounded(patterns.activation_scores(activations(spark, sf_dir)).select("id", "device_type", "confidence", "tier"))


#: Days of the year stand in for months, of which the table holds one: twelve of them, as months of one year.
CLASS_SQL = RUNS_SQL + f""", t AS (SELECT *, {TYPED} AS device_type, 202400 + s // 86400 % 12 + 1 AS ym FROM r),
h AS (SELECT house_id, count(DISTINCT ym) AS months_total, bool_or(ym % 100 BETWEEN 5 AND 10) AND bool_or(NOT ym % 100 BETWEEN 5 AND 10) AS both_seasons FROM t GROUP BY house_id),
p AS (SELECT house_id, device_type, 1 - max(k) / sum(k) AS switching FROM (SELECT house_id, device_type, phase, count(*) AS k FROM t GROUP BY ALL) GROUP BY ALL),
g AS (SELECT house_id, device_type, count(*) AS n, count(DISTINCT ym) AS months_with, count(*) FILTER (WHERE magnitude > 0) AS ns, avg(magnitude) FILTER (WHERE magnitude > 0) AS mean, stddev_pop(magnitude) FILTER (WHERE magnitude > 0) AS spread,
  median(duration) FILTER (WHERE duration > 0) AS med, count(*) FILTER (WHERE ym % 100 BETWEEN 5 AND 10) AS warm, count(*) FILTER (WHERE NOT ym % 100 BETWEEN 5 AND 10) AS cool FROM t WHERE device_type <> 'unknown' GROUP BY ALL),
q AS (SELECT house_id, device_type, n, months_total, both_seasons, months_with / months_total AS temporal, CASE WHEN ns >= 2 THEN spread / mean ELSE 0.0 END AS cv, CASE WHEN ns >= 2 THEN switching ELSE 0.0 END AS sw, med, CASE WHEN both_seasons THEN warm / greatest(cool, 1) END AS ratio, ns, mean
  FROM g JOIN p USING (house_id, device_type) JOIN h USING (house_id)),
f AS (SELECT *, CASE WHEN device_type = 'boiler' AND temporal < 0.5 OR device_type IN ('regular_ac', 'central_ac') AND temporal > 0.9 THEN 'TEMPORAL_ANOMALY' WHEN temporal < 0.2 AND n > 5 THEN 'TEMPORAL_SPARSE' END AS temporal_flag,
  CASE WHEN ns < 2 THEN NULL WHEN device_type = 'boiler' AND cv > 0.3 THEN 'MAGNITUDE_UNSTABLE' WHEN device_type = 'boiler' AND sw > 0.1 THEN 'PHASE_SWITCHING' WHEN device_type = 'boiler' AND NOT mean BETWEEN 1500 AND 5000 THEN 'MAGNITUDE_SUSPICIOUS' WHEN device_type = 'regular_ac' AND cv > 0.4 THEN 'MAGNITUDE_UNSTABLE' END AS magnitude_flag,
  CASE WHEN device_type = 'boiler' AND med > 240 THEN 'DURATION_ANOMALY' WHEN device_type = 'boiler' AND med < 15 OR device_type IN ('regular_ac', 'central_ac') AND med < 5 THEN 'DURATION_TOO_SHORT' END AS duration_flag,
  CASE WHEN device_type IN ('regular_ac', 'central_ac') AND ratio < 1 OR device_type = 'boiler' AND ratio > 3 THEN 'SEASONAL_INVERTED' WHEN device_type IN ('regular_ac', 'central_ac') AND ratio BETWEEN 0.8 AND 1.2 AND months_total >= 6 THEN 'SEASONAL_FLAT' END AS seasonal_flag FROM q)"""


def seasoned(spark, sf_dir) -> DataFrame:
    return activations(spark, sf_dir).withColumn("year_month", 202400 + F.floor(F.col("start") / 86_400) % 12 + 1)


@query(CLASS_SQL + """ SELECT house_id, device_type, n, months_total, both_seasons, round(temporal, 4) AS temporal, round(cv, 4) AS cv, round(sw, 4) AS switching, round(med, 4) AS median, round(ratio, 4) AS ratio, temporal_flag, magnitude_flag, duration_flag, seasonal_flag FROM f""")
def type_quality(spark, sf_dir):
    """Measures and flags of every device type of a house."""
    return rounded(patterns.type_quality(seasoned(spark, sf_dir)))


@query(CLASS_SQL + f""", l AS (SELECT house_id, ym, coalesce(e > lead(s) OVER (PARTITION BY house_id, phase ORDER BY s, e, id), false) AS over_next FROM t),
hs AS (SELECT house_id, count(*) AS n_sessions, count(DISTINCT ym) AS data_months, count(*) FILTER (WHERE over_next) AS n_overlaps FROM l GROUP BY house_id),
u AS (SELECT house_id, device_type, x.k AS kind, x.v AS flag, x.has AS has FROM (SELECT house_id, device_type, unnest([{{'k': 'temporal', 'v': temporal_flag, 'has': true}}, {{'k': 'magnitude', 'v': magnitude_flag, 'has': true}}, {{'k': 'duration', 'v': duration_flag, 'has': med IS NOT NULL}}, {{'k': 'seasonal', 'v': seasonal_flag, 'has': both_seasons}}]) AS x FROM f)),
v AS (SELECT house_id, kind, CASE WHEN bool_or(regexp_matches(coalesce(flag, ''), 'ANOMALY|SWITCHING|INVERTED')) THEN 0.0 WHEN count(flag) > 0 THEN 0.5 WHEN bool_or(has) THEN 1.0 ELSE 0.5 END AS worth FROM u GROUP BY ALL),
w AS (SELECT house_id, sum(worth * CASE kind WHEN 'temporal' THEN 0.25 WHEN 'magnitude' THEN 0.3 WHEN 'duration' THEN 0.2 ELSE 0.15 END) AS part FROM v GROUP BY house_id),
n AS (SELECT house_id, string_agg(device_type || ':' || flag, ',' ORDER BY device_type || ':' || flag) AS flags FROM u WHERE flag IS NOT NULL GROUP BY house_id),
z AS (SELECT hs.*, coalesce(part, 0.45) + 0.1 * CASE WHEN n_overlaps > 0 THEN 0.5 ELSE 1 END AS score, coalesce(flags, '') AS flags FROM hs LEFT JOIN w USING (house_id) LEFT JOIN n USING (house_id))
SELECT house_id, n_sessions, data_months, n_overlaps, round(CAST(score AS DOUBLE), 4) AS score, CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.65 THEN 'good' WHEN score >= 0.45 THEN 'fair' ELSE 'poor' END AS tier, flags FROM z""")
def class_quality(spark, sf_dir):
    """How far a house's classes can be trusted: five kinds of measures, one score."""
    return rounded(patterns.class_quality(seasoned(spark, sf_dir)))


@query(RUNS_SQL + """, h AS (SELECT house_id, avg(magnitude) AS a, avg(duration) AS b, CAST(count(*) AS DOUBLE) AS c, stddev_pop(magnitude) AS d FROM r GROUP BY house_id), v AS (UNPIVOT h ON a, b, c, d INTO NAME metric VALUE x),
m AS (SELECT metric, quantile_cont(x, 0.5) AS md FROM v GROUP BY metric), k AS (SELECT v.metric, quantile_cont(abs(x - md), 0.5) AS mad FROM v JOIN m ON m.metric = v.metric GROUP BY v.metric),
z AS (SELECT house_id, v.metric, (x - md) / CASE WHEN mad = 0 THEN 1 ELSE mad END AS z FROM v JOIN m ON m.metric = v.metric JOIN k ON k.metric = v.metric)
SELECT house_id, round(max(abs(z)), 4) AS max_z, count(*) FILTER (WHERE abs(z) > 2) AS n_over_2, max(abs(z)) > 3 OR count(*) FILTER (WHERE abs(z) > 2) >= 3 AS outlier FROM z GROUP BY house_id""")
def outlier_houses(spark, sf_dir):
    houses = runs(spark, sf_dir).groupBy("house_id").agg(F.avg("magnitude").alias("a"), F.avg("duration").alias("b"), F.count("*").cast("double").alias("c"), F.stddev_pop("magnitude").alias("d"))
    long = houses.unpivot("house_id", ["a", "b", "c", "d"], "metric", "x")
    return rounded(patterns.outliers(sessions.robust_z(long, ["metric"], "x")))


@query(RUNS_SQL + f""", t AS (SELECT *, {TAGGED} AS tag FROM r WHERE {TAGGED} <> '') SELECT part, count(*) AS n, round(quantile_cont(magnitude, 0.9), 4) AS p90 FROM (SELECT unnest(string_split(tag, '-')) AS part, magnitude FROM t) GROUP BY part""")
def tag_parts(spark, sf_dir):
    rows = activations(spark, sf_dir).where("tag <> ''").select(F.explode(F.split("tag", "-")).alias("part"), "magnitude")
    return rounded(rows.groupBy("part").agg(F.count("*").alias("n"), F.percentile("magnitude", F.lit(0.9)).alias("p90")))


AC_SQL = RUNS_SQL + f""", t AS (SELECT *, {TYPED} AS device_type, s // 60 * 60 AS mn, s // 86400 * 86400 + e % 86400 // 60 * 60 AS till FROM r WHERE magnitude >= 800 AND (duration BETWEEN 3 AND 30 OR duration >= 15)),
q AS (SELECT *, sum(f) OVER (PARTITION BY house_id, phase, device_type ORDER BY mn, s, id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN mn - lag(till) OVER (PARTITION BY house_id, phase, device_type ORDER BY mn, s, id) <= 3600 THEN 0 ELSE 1 END AS f FROM t)),
g AS (SELECT house_id, phase, device_type, CAST(session AS BIGINT) AS session, min(mn) AS "start", last(till ORDER BY mn, s, id) AS "end", count(*) AS cycles, avg(floor(magnitude)) AS magnitude, CAST(max(floor(magnitude)) AS BIGINT) AS most, first(duration ORDER BY mn, s, id) AS first_minutes,
  coalesce(stddev_pop(floor(magnitude)) / nullif(avg(floor(magnitude)), 0), 0) AS cv FROM q GROUP BY house_id, phase, device_type, session)"""


@query(AC_SQL + """ SELECT device_type, count(*) AS n_sessions, count(*) FILTER (WHERE month(make_timestamp("start" * 1000000)) IN (12, 1, 2)) AS winter, count(*) FILTER (WHERE month(make_timestamp("start" * 1000000)) IN (3, 4, 5)) AS spring,
  count(*) FILTER (WHERE month(make_timestamp("start" * 1000000)) IN (6, 7, 8)) AS summer, count(*) FILTER (WHERE month(make_timestamp("start" * 1000000)) IN (9, 10, 11)) AS fall, count(*) FILTER (WHERE ("start" // 3600) % 24 BETWEEN 6 AND 17) AS day, count(*) FILTER (WHERE NOT ("start" // 3600) % 24 BETWEEN 6 AND 17) AS night
FROM g GROUP BY device_type""")
def usage_patterns(spark, sf_dir):
    """Sessions of compressor runs by device type, season and time of day."""
    found = patterns.ac_sessions(activations(spark, sf_dir), ["house_id", "phase", "device_type"], valid=False)
    return patterns.usage(found, ["device_type"])


@query(AC_SQL + """ SELECT house_id, phase, device_type, session, "start", "end", cycles, round(magnitude, 4) AS magnitude, most, round(first_minutes, 4) AS first_minutes, round(cv, 4) AS cv, cycles >= 4 AND first_minutes >= 15 AND cv <= 0.2 AS valid FROM g""")
def ac_sessions(spark, sf_dir):
    """Compressor runs at most an hour apart as sessions, and which of them look like an AC's."""
    keys = ["house_id", "phase", "device_type"]
    rows = staged(activations(spark, sf_dir))
    good = patterns.ac_sessions(rows, keys).select(*keys, "session", F.lit(True).alias("valid"))
    return rounded(patterns.ac_sessions(rows, keys, valid=False).join(good, [*keys, "session"], "left").na.fill(False, ["valid"]))


@query(RUNS_SQL + """, h AS (SELECT house_id, (s // 3600) % 24 AS hour, count(*) AS c FROM r GROUP BY ALL)
SELECT house_id, CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (WHERE hour < 6), 0) AS BIGINT) AS night, CAST(coalesce(sum(c) FILTER (WHERE hour BETWEEN 6 AND 11), 0) AS BIGINT) AS morning, CAST(coalesce(sum(c) FILTER (WHERE hour BETWEEN 12 AND 17), 0) AS BIGINT) AS afternoon,
  CAST(coalesce(sum(c) FILTER (WHERE hour >= 18), 0) AS BIGINT) AS evening, CAST(first(hour ORDER BY c DESC, hour) AS BIGINT) AS peak_hour, CAST(first(hour ORDER BY c, hour) AS BIGINT) AS quiet_hour FROM h GROUP BY house_id""")
def time_distribution(spark, sf_dir):
    """When a house's runs begin: by six hours, and the fullest and emptiest hour."""
    return rounded(patterns.time_distribution(runs(spark, sf_dir), ["house_id"]))


@query(RUNS_SQL + """, q AS (SELECT *, sum(f) OVER (PARTITION BY house_id ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY house_id ORDER BY s, id) <= 600 THEN 0 ELSE 1 END AS f FROM r WHERE event_type = 'view'))
SELECT house_id, min(s) AS "start", CASE WHEN bool_or(phase = 'w1') THEN 'V' ELSE 'X' END AS w1, CASE WHEN bool_or(phase = 'w2') THEN 'V' ELSE 'X' END AS w2, CASE WHEN bool_or(phase = 'w3') THEN 'V' ELSE 'X' END AS w3, round(avg(magnitude), 4) AS magnitude, round(max(duration), 4) AS longest FROM q GROUP BY house_id, grp""")
def central_ac_rows(spark, sf_dir):
    """Runs at most ten minutes apart as one row, with the phases that take part."""
    rows = runs(spark, sf_dir).where("event_type = 'view'")
    w = W.partitionBy("house_id").orderBy("start", "id")
    rows = rows.withColumn("fresh", F.when(F.col("start") - F.lag("start").over(w) <= 600, 0).otherwise(1)).withColumn("grp", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    seen = lambda p: F.when(F.bool_or(F.col("phase") == p), "V").otherwise("X").alias(p)
    return rounded(rows.groupBy("house_id", "grp").agg(F.min("start").alias("start"), seen("w1"), seen("w2"), seen("w3"), F.avg("magnitude").alias("magnitude"), F.max("duration").alias("longest")).drop("grp"))


@query(RUNS_SQL + f""", t AS (SELECT *, {TYPED} AS device_type FROM r), n AS (SELECT device_type, 'Device ' || chr(CAST(64 + row_number() OVER (ORDER BY device_type) AS INTEGER)) AS name FROM (SELECT DISTINCT device_type FROM t WHERE device_type <> 'unknown'))
SELECT id, t.device_type, name, round(magnitude, 2) AS magnitude FROM t LEFT JOIN n ON n.device_type = t.device_type""".replace("round(magnitude, 2)", "CAST(floor(magnitude) AS BIGINT)"))
def named_activations(spark, sf_dir):
    """Flat activations with the names of a second table where it has one."""
    rows = activations(spark, sf_dir)
    names = rows.where("device_type <> 'unknown'").select("device_type").distinct()
    names = names.withColumn("name", F.concat(F.lit("Device "), F.chr(64 + F.row_number().over(W.partitionBy(F.lit(0)).orderBy("device_type")))))  # a row per device type
    return rows.join(F.broadcast(names), "device_type", "left").select("id", "device_type", "name", F.floor("magnitude").alias("magnitude"))


@query(RUNS_SQL + f""", t AS (SELECT *, {TYPED} AS device_type FROM r), b AS (SELECT house_id, device_type, count(*) AS c, sum(duration) AS m, floor(avg(magnitude) * 100 + 0.50001) / 100 AS a FROM t GROUP BY ALL)
SELECT house_id, '{{' || string_agg('"' || device_type || '":{{"count":' || c || ',"minutes":' || m || ',"avg_magnitude":' || a || '}}', ',' ORDER BY device_type) || '}}' AS summary, CAST(sum(c) AS BIGINT) AS n_events FROM b GROUP BY house_id""")
def house_summaries(spark, sf_dir):
    return devices.breakdown(activations(spark, sf_dir))


RUN_CONFIG = '{"thresholds":[2000,1500,1100,800],"features":{"gradual":true,"near_threshold":false,"tails":true,"split_offs":true,"settling":true,"imputation":false}}'


@query(f"""SELECT user_id AS house_id, count(DISTINCT strftime(ts, '%Y-%m')) AS n_months, {EPOCH.format("min(ts)")} AS first_reading, {EPOCH.format("max(ts)")} AS last_reading, count(*) AS n_readings, '{RUN_CONFIG}' AS config FROM events GROUP BY user_id""")
def run_metadata(spark, sf_dir):
    """What a run over a house's stored readings covers, with the run's configuration as JSON."""
    flags = F.struct(*[F.lit(v).alias(k) for k, v in vars(Features()).items()])
    config = F.to_json(F.struct(F.array(*[F.lit(t) for t in THRESHOLDS]).alias("thresholds"), flags.alias("features")))
    seconds = SEC("ts")
    return power_series(spark, sf_dir).groupBy("house_id").agg(F.count_distinct("month").alias("n_months"), F.min(seconds).alias("first_reading"), F.max(seconds).alias("last_reading"), F.count("*").alias("n_readings")).withColumn("config", config)


# ---------------------------------------------------------------- order-dependent steps


@query()
def stacked_pairs(spark, sf_dir):
    """Last-in-first-out pairs of the grid's edges."""
    found = sharp_edges(dense_grid(spark, sf_dir), 800, order=("m",))
    ids = F.concat_ws("-", "event", F.col("start").cast("string"))
    return patterns.stack_pairs(found.select("house_id", "phase", "event", ids.alias("id"), F.col("start").alias("at"), "magnitude"), ["house_id", "phase"])


@query()
def recurring_runs(spark, sf_dir):
    """Runs of 20 minutes and more that recur at a time of day, by power bucket, with their period."""
    rows = runs(spark, sf_dir).where("duration >= 20").withColumn("bucket", F.floor(F.col("magnitude") / 1000))
    return rounded(patterns.recurrences(rows, ["house_id", "phase", "bucket"], least=2))


@query()
def cross_house_devices(spark, sf_dir):
    """Patterns of houses under complete linkage, named by power."""
    found = runs(spark, sf_dir).groupBy("house_id", F.col("iteration").alias("pattern_id")).agg(F.avg("magnitude").alias("magnitude"), F.avg("duration").alias("duration"), F.count("*").alias("n")).where("n >= 2 and duration >= 10")
    return rounded(patterns.named_groups(patterns.linked_signatures(found, 0.02, 0.05)))


@query()
def classified_runs(spark, sf_dir):
    """The cascade, run by run: boilers of the main phase, devices on several phases, ACs on several, ACs, recurring ones."""
    events = staged(runs(spark, sf_dir).where("duration >= 2"))
    found = patterns.cascade(events, classifiers(events))
    return rounded(found.join(events, "id").select("id", "house_id", "phase", "device_type", "duration", "magnitude"))


def classifiers(events: DataFrame, apart: int = 3600) -> list:
    """Steps of the cascade over ``events``. Boilers are looked for among all of them: isolated long strong runs. Those with
    long runs beside them on other phases are devices on several phases, with these; of the rest the main phase's are boilers."""
    keys = ["house_id", "phase"]
    alone = staged(patterns.compressor_near(devices.boiler_candidates(events), events, apart))
    several = staged(patterns.three_phase_groups(alone, events).select(F.explode(F.array("l_id", "r_id")).alias("id")).distinct())

    def three_phase(left: DataFrame) -> DataFrame:
        return several

    def boilers(left: DataFrame) -> DataFrame:
        return patterns.main_phase_only(alone.join(several, "id", "left_anti"))

    def cycling(left: DataFrame) -> DataFrame:
        minutes = left.withColumns({"start": F.col("start") / 60, "end": F.col("end") / 60}).select(*keys, "id", "start", "end", "magnitude", "iteration")
        return kernels.cycling(minutes).where("sequence >= 0")

    def central(left: DataFrame) -> DataFrame:
        marked = staged(cycling(left).join(left.select("id", F.col("start").alias("at"), F.col("end").alias("till")), "id"))
        blocks = marked.groupBy(*keys, "sequence").agg(F.min("at").alias("start"), F.max("till").alias("end"), F.min("id").alias("id"))
        both = patterns.synced(blocks).select(F.explode(F.array("l_id", "r_id")).alias("id")).distinct()
        return marked.join(blocks.join(both, "id", "left_semi").select(*keys, "sequence"), [*keys, "sequence"], "left_semi")

    def recurring(left: DataFrame) -> DataFrame:
        parts = staged(sessions.sessionise(left, keys, "start", "end", 1800, "id"))
        stats = parts.withColumn("threshold", F.col("iteration")).groupBy(*keys, "session").agg(F.min("start").alias("start"), F.avg("magnitude").alias("avg_magnitude"), F.avg("duration").alias("avg_duration"), F.count("*").alias("n_events"), F.coalesce(F.try_divide(F.stddev_pop("magnitude"), F.avg("magnitude")), F.lit(0.0)).alias("magnitude_cv"))
        marked = kernels.recurring(stats, ("avg_magnitude", "avg_duration", "n_events", "magnitude_cv")).where("cluster >= 0")
        shaped = marked.select(*keys, "cluster", "session", "start", F.col("session").alias("id"), F.col("avg_magnitude").alias("magnitude"), F.col("avg_duration").alias("duration"))
        valid = patterns.cluster_scores(shaped, [*keys, "cluster"]).select(*keys, "cluster")
        return parts.join(marked.join(valid, [*keys, "cluster"], "left_semi").select(*keys, "session"), [*keys, "session"], "left_semi")

    return [("three_phase_device", three_phase), ("boiler", boilers), ("central_ac", central), ("regular_ac", cycling), ("recurring_pattern", recurring)]

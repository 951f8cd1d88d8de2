"""All queries of the energy engine: name -> function of (spark, sf_dir), and the SQL that checks them.

Times are whole seconds since 1970, minutes of the dense grid count from 0, and doubles are rounded to
four places, so that two engines can be compared row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators import cleaning, detection, devices, edges, joins, kernels, matching, profile, sessions
from gridloom.plans.disaggregate import THRESHOLDS, disaggregate, edge_pairs
from gridloom.plans.registry import EPOCH, NUDGE, ORACLE_SQL, QUERIES, SEC, query, rounded  # noqa: F401
from gridloom.sources import ingest
from gridloom.sources.tables import GRID_SQL, HOLES_SQL, SERIES_SQL, dense_grid, ordered_sum, power_series, read, reading_grid
from gridloom.sources.work import staged

# ---------------------------------------------------------------- edges

EDGES_SQL = """
d AS (SELECT *, watts - lag(watts) OVER (PARTITION BY house_id, phase ORDER BY {o}) AS diff FROM {t}),
e AS (SELECT *, CASE WHEN diff >= {on} THEN 'on' WHEN diff <= -{off} THEN 'off' END AS event FROM d),
f AS (SELECT *, CASE WHEN event IS NOT DISTINCT FROM lag(event) OVER (PARTITION BY house_id, phase ORDER BY {o}) THEN 0 ELSE 1 END AS fresh FROM e),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY house_id, phase ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS run FROM f),
edges AS (SELECT house_id, phase, event, min({a}) AS "start", max({a}) AS "end", count(*) AS n_rows, sum(diff) AS magnitude FROM n WHERE event IS NOT NULL GROUP BY house_id, phase, run, event)"""
SERIES_EDGES = f"WITH {SERIES_SQL}, {EDGES_SQL.format(t='s', o='ts, event_id', a='ts', on=1500, off=1200)}"
GRID_EDGES = f"WITH {GRID_SQL}, {EDGES_SQL.format(t='g', o='m', a='m', on=800, off=640)}"


@query(SERIES_EDGES + f""" SELECT house_id, phase, event, {EPOCH.format('"start"')} AS "start", {EPOCH.format('"end"')} AS "end", n_rows, round(magnitude, 4) AS magnitude FROM edges""")
def sharp_edges(spark, sf_dir):
    found = edges.sharp_edges(power_series(spark, sf_dir), 1500)
    return rounded(found.withColumns({"start": SEC("start"), "end": SEC("end")}))


@query(SERIES_EDGES + """ SELECT phase, event, CAST(hour("start") AS BIGINT) AS hour, count(*) AS n_edges, round(sum(magnitude), 4) AS magnitude FROM edges GROUP BY ALL""")
def edge_counts_by_hour(spark, sf_dir):
    found = edges.sharp_edges(power_series(spark, sf_dir), 1500)
    return rounded(found.groupBy("phase", "event", F.hour("start").alias("hour")).agg(F.count("*").alias("n_edges"), F.sum("magnitude").alias("magnitude")))


@query(f"""WITH {GRID_SQL}, k AS (SELECT *, watts - lag(watts) OVER w AS diff, lag(watts) OVER w AS w_1, lag(watts, 2) OVER w AS w_2, lead(watts) OVER w AS w1 FROM g WINDOW w AS (PARTITION BY house_id, phase ORDER BY m)),
e AS (SELECT *, lag(diff) OVER w AS d_1, lead(diff) OVER w AS d1, CASE WHEN diff >= 800 THEN 'on' WHEN diff <= -640 THEN 'off' END AS event FROM k WINDOW w AS (PARTITION BY house_id, phase ORDER BY m)),
f AS (SELECT *, CASE WHEN event IS NOT DISTINCT FROM lag(event) OVER (PARTITION BY house_id, phase ORDER BY m) THEN 0 ELSE 1 END AS fresh FROM e),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY house_id, phase ORDER BY m ROWS UNBOUNDED PRECEDING) AS run FROM f),
x AS (SELECT house_id, phase, event, min(m) AS "start", max(m) AS "end", first(w_1 ORDER BY m) AS p_pre, first(w_2 ORDER BY m) AS p_pre2, first(d_1 ORDER BY m) AS d_pre, last(watts ORDER BY m) AS p_end, last(w1 ORDER BY m) AS p_post, last(d1 ORDER BY m) AS d_post
  FROM n WHERE event IS NOT NULL GROUP BY house_id, phase, event, run),
y AS (SELECT *, coalesce(p_end, 0) - coalesce(p_pre, 0) AS size, CASE WHEN event = 'on' THEN 1 ELSE -1 END AS sgn FROM x),
z AS (SELECT *, sgn * coalesce(d_pre, 0) > 0.05 * abs(size) AS early, sgn * coalesce(d_post, 0) > 0.05 * abs(size) AS late FROM y)
SELECT house_id, phase, event, CAST(CASE WHEN early THEN "start" - 1 ELSE "start" END AS BIGINT) AS "start", CAST(CASE WHEN late THEN "end" + 1 ELSE "end" END AS BIGINT) AS "end",
  round(coalesce(CASE WHEN late THEN p_post ELSE p_end END, 0) - coalesce(CASE WHEN early THEN p_pre2 ELSE p_pre END, 0), 4) AS magnitude FROM z""")
def expanded_edges(spark, sf_dir):
    grid = dense_grid(spark, sf_dir)
    return rounded(edges.expand(edges.sharp_edges(grid, 800, order=("m",)), grid))


def intervals(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("user_id", SEC("ts").alias("start"), (SEC("ts") + F.col("event_id") % 50 * 600).alias("end"), F.col("event_id").alias("id"), F.col("value").alias("magnitude"))


INTERVALS_SQL = f"""WITH i AS (SELECT user_id, {EPOCH.format("ts")} AS s, {EPOCH.format("ts")} + event_id % 50 * 600 AS e, event_id AS id, value FROM events)"""


@query(INTERVALS_SQL + """,
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(s) AS "start", max(e) AS "end", round(sum(value), 4) AS magnitude, count(*) AS n_merged FROM n GROUP BY user_id, island""")
def interval_coalesce(spark, sf_dir):
    return rounded(edges.coalesce_intervals(intervals(spark, sf_dir), ("user_id",), 600).drop("island"))


@query(f"""WITH i AS (SELECT user_id, {EPOCH.format("ts")} AS a, event_id AS id, value, CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END AS kind FROM events),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, id ROWS UNBOUNDED PRECEDING) AS chain FROM (
  SELECT *, CASE WHEN a - lag(a) OVER w <= 14400 AND kind = lag(kind) OVER w THEN 0 ELSE 1 END AS fresh FROM i WINDOW w AS (PARTITION BY user_id ORDER BY a, id))),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, chain ORDER BY a, id) - 1) // 2 AS pair FROM c)
SELECT user_id, kind, min(a) AS "start", max(a) AS "end", round(sum(value), 4) AS magnitude, count(*) AS n_merged FROM p GROUP BY user_id, kind, chain, pair""")
def pairwise_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "on").otherwise("off")
    events = e.select("user_id", SEC("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), F.col("value").alias("magnitude"))
    return rounded(edges.merge_pairs(events, ("user_id",), 14_400))


# ---------------------------------------------------------------- cleaning


@query(f"""WITH {HOLES_SQL},
r AS (SELECT *, count(watts) OVER w AS run, last_value(watts IGNORE NULLS) OVER w AS prev FROM s WINDOW w AS (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, CASE WHEN watts IS NULL THEN count(*) FILTER (WHERE watts IS NULL) OVER (PARTITION BY house_id, phase, run) ELSE 0 END AS run_length FROM r)
SELECT house_id, event_id, CAST(run_length AS BIGINT) AS run_length, round(coalesce(watts, CASE WHEN run_length <= 1 THEN prev END), 4) AS filled FROM l""")
def ffill_limited(spark, sf_dir):
    return rounded(cleaning.forward_fill(power_series(spark, sf_dir, holes=True), 1).select("house_id", "event_id", F.col("run_length").cast("long").alias("run_length"), "filled"))


@query(f"""WITH {SERIES_SQL} SELECT house_id, event_id, round(greatest(watts - avg(watts) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 59 FOLLOWING)
  + avg(watts) OVER (PARTITION BY house_id, phase), 0), 4) AS detrended FROM s""")
def detrend_centered(spark, sf_dir):
    return rounded(cleaning.detrend(power_series(spark, sf_dir)).select("house_id", "event_id", "detrended"))


@query(f"""WITH {SERIES_SQL}, p AS (SELECT month, phase, quantile_cont(watts, 0.5) AS md FROM s GROUP BY month, phase), c AS (SELECT *, avg(md) OVER (PARTITION BY month) AS common FROM p)
SELECT event_id, s.phase, round(greatest(watts - md + common, 0), 4) AS balanced FROM s JOIN c ON s.month = c.month AND s.phase = c.phase""")
def phase_balance(spark, sf_dir):
    return rounded(cleaning.balance_phases(power_series(spark, sf_dir)).select("event_id", "phase", "balanced"))


@query(f"""WITH {SERIES_SQL}, a AS (SELECT *, quantile_cont(watts, 0.5) OVER w AS md FROM s WINDOW w AS (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
b AS (SELECT *, quantile_cont(abs(watts - md), 0.5) OVER w AS mad FROM a WINDOW w AS (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))
SELECT event_id, round(md, 4) AS near_median, round(mad, 4) AS mad, round(CASE WHEN (mad > 0 AND abs(watts - md) > 3 * mad) OR (mad = 0 AND abs(watts - md) > 0) THEN md ELSE watts END, 4) AS cleaned FROM b""")
def hampel_clean(spark, sf_dir):
    return rounded(cleaning.hampel(power_series(spark, sf_dir), 24, 3.0).select("event_id", "near_median", "mad", "cleaned"))


@query(f"""WITH {SERIES_SQL}, a AS (SELECT *, {EPOCH.format("ts")} AS a FROM s),
z AS (SELECT event_id, watts, avg(watts) OVER w AS mean, stddev_samp(watts) OVER w AS dev FROM a WINDOW w AS (PARTITION BY house_id, phase ORDER BY a RANGE BETWEEN 431999 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN dev > 0 THEN (watts - mean) / dev END, 4) AS z, coalesce(abs(CASE WHEN dev > 0 THEN (watts - mean) / dev END) > 2, false) AS anomalous FROM z""")
def rolling_zscore(spark, sf_dir):
    return rounded(cleaning.rolling_z(power_series(spark, sf_dir), 432_000, 2.0).select("event_id", "z", "anomalous"))


@query(f"""WITH {SERIES_SQL}, f AS (SELECT *, CASE WHEN abs(watts - lag(watts) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id)) <= 500 THEN 0 ELSE 1 END AS fresh FROM s),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT house_id, phase, count(*) AS n_rows, {EPOCH.format("min(ts)")} AS "start", {EPOCH.format("max(ts)")} AS "end" FROM n GROUP BY house_id, phase, run""")
def flat_runs(spark, sf_dir):
    return cleaning.flat_runs(power_series(spark, sf_dir), 500).withColumns({"start": SEC("start"), "end": SEC("end")}).drop("run")


@query(f"""WITH {HOLES_SQL},
d AS (SELECT *, greatest(watts - avg(watts) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 59 FOLLOWING) + avg(watts) OVER (PARTITION BY house_id, phase), 0) AS x FROM s),
m AS (SELECT month, phase, quantile_cont(x, 0.5) AS md FROM d GROUP BY month, phase), c AS (SELECT *, avg(md) OVER (PARTITION BY month) AS common FROM m),
b AS (SELECT d.house_id, d.phase, ts, event_id, greatest(x - md + common, 0) AS y FROM d JOIN c ON c.month = d.month AND c.phase = d.phase),
h AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS BETWEEN 120 PRECEDING AND 119 FOLLOWING) AS mid FROM b),
k AS (SELECT *, quantile_cont(abs(y - mid), 0.5) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS BETWEEN 120 PRECEDING AND 119 FOLLOWING) AS mad FROM h)
SELECT house_id, event_id, round(CASE WHEN (mad > 0 AND abs(y - mid) > 5 * mad) OR (mad = 0 AND abs(y - mid) > 0) THEN mid ELSE y END, 4) AS normalised FROM k""")
def normalised_combined(spark, sf_dir):
    return rounded(cleaning.normalise(power_series(spark, sf_dir, holes=True), "combined").select("house_id", "event_id", "normalised"))


# ---------------------------------------------------------------- profiles


@query(f"""WITH {HOLES_SQL},
a AS (SELECT *, ({EPOCH.format("ts")} - lag({EPOCH.format("ts")}) OVER w) / 60.0 AS gap, count(*) OVER (PARTITION BY house_id, ts) AS copies, count(watts) OVER (PARTITION BY house_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM s WINDOW w AS (PARTITION BY house_id ORDER BY ts, event_id)),
b AS (SELECT *, count(*) FILTER (WHERE watts IS NULL) OVER (PARTITION BY house_id, run) AS run_length FROM a)
SELECT house_id, count(*) AS n_readings, count(*) FILTER (WHERE watts IS NULL) AS n_missing, CAST(date_diff('day', min(ts), max(ts)) AS BIGINT) AS span_days, round(CAST(max(gap) AS DOUBLE), 4) AS max_gap,
  count(*) FILTER (WHERE gap > 2) AS n_gaps, count(*) FILTER (WHERE copies > 1) AS n_repeated_times, max(run_length) AS longest_missing, count(*) FILTER (WHERE watts > 4000) AS n_anomalies FROM b GROUP BY house_id""")
def coverage_profile(spark, sf_dir):
    return rounded(profile.coverage(power_series(spark, sf_dir, holes=True), limit=4000))


@query(f"""WITH {SERIES_SQL}, a AS (SELECT month, phase, avg(watts) AS avg_watts, max(watts) AS max_watts, sum(watts) AS sum_watts, {", ".join(f"avg(CASE WHEN watts >= {n} THEN 1.0 ELSE 0.0 END) AS share_{n}" for n in (800, 1100, 1500, 2000))} FROM s GROUP BY month, phase)
SELECT month, phase, round(avg_watts, 4) AS avg_watts, round(max_watts, 4) AS max_watts, round(sum_watts, 4) AS sum_watts, {", ".join(f"round(share_{n}, 4) AS share_{n}" for n in (800, 1100, 1500, 2000))},
  round(sum_watts / sum(sum_watts) OVER (PARTITION BY month), 4) AS energy_share FROM a""")
def power_shares(spark, sf_dir):
    return rounded(profile.power_statistics(power_series(spark, sf_dir), ("month", "phase")))


@query(f"""WITH {SERIES_SQL}, w AS (SELECT strftime(ts, '%Y-%m-%d %H') AS slot, avg(watts) FILTER (WHERE phase = 'w1') AS w1, avg(watts) FILTER (WHERE phase = 'w2') AS w2, avg(watts) FILTER (WHERE phase = 'w3') AS w3 FROM s GROUP BY 1),
m AS (SELECT *, (coalesce(w1, 0) + coalesce(w2, 0) + coalesce(w3, 0)) / 3 AS mean FROM w)
SELECT slot, round(w1, 4) AS w1, round(w2, 4) AS w2, round(w3, 4) AS w3,
  round(CASE WHEN mean > 0 THEN sqrt(((coalesce(w1, 0) - mean) ** 2 + (coalesce(w2, 0) - mean) ** 2 + (coalesce(w3, 0) - mean) ** 2) / 3) / mean END, 4) AS imbalance FROM m""")
def phase_imbalance(spark, sf_dir):
    wide = power_series(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("slot")).pivot("phase", ["w1", "w2", "w3"]).agg(F.avg("watts"))
    return rounded(profile.imbalance(wide))


@query(f"""WITH {SERIES_SQL} SELECT house_id, round(avg(watts) FILTER (WHERE hour(ts) BETWEEN 6 AND 21), 4) AS day_watts, round(avg(watts) FILTER (WHERE hour(ts) NOT BETWEEN 6 AND 21), 4) AS night_watts FROM s GROUP BY house_id""")
def day_night(spark, sf_dir):
    return rounded(profile.day_and_night(power_series(spark, sf_dir)))


@query(f"""WITH {SERIES_SQL} SELECT CAST((dayofweek(ts) + 6) % 7 AS BIGINT) AS weekday, {", ".join(f'round(coalesce(avg(watts) FILTER (WHERE hour(ts) = {h}), 0), 4) AS "{h}"' for h in range(24))} FROM s GROUP BY 1""")
def weekday_heatmap(spark, sf_dir):
    return rounded(profile.heatmap(power_series(spark, sf_dir)))


@query(f"""WITH {SERIES_SQL} SELECT CAST(year(ts) AS BIGINT) AS "year", CAST(month(ts) AS BIGINT) AS month_no, round(avg(watts), 4) AS avg_watts, round(sum(watts), 4) AS sum_watts, count(*) AS n, coalesce(max(watts), 0) <= 0 AS no_power
FROM s GROUP BY ROLLUP (year(ts), month(ts))""")
def period_rollup(spark, sf_dir):
    return rounded(profile.by_period(power_series(spark, sf_dir)))


@query(f"""WITH {GRID_SQL}, b AS (SELECT house_id, phase, quantile_cont(watts, 0.05) AS p5 FROM g GROUP BY house_id, phase),
r AS (SELECT g.house_id, g.phase, watts AS o, least(watts, 700) AS r, p5, greatest(least(watts, 700) - p5, 0) AS above FROM g JOIN b ON g.house_id = b.house_id AND g.phase = b.phase),
a AS (SELECT house_id, phase, count(*) AS n, sum(o) AS original, sum(greatest(o - r, 0)) AS explained, min(p5) AS p5, sum(r) AS remaining, coalesce(sum(above) FILTER (WHERE above > 300), 0) AS over, coalesce(sum(above) FILTER (WHERE above <= 300), 0) AS under FROM r GROUP BY house_id, phase)
SELECT house_id, phase, n, round(original, 4) AS original, round(explained, 4) AS explained, round(p5, 4) AS p5, round(remaining, 4) AS remaining, round(over, 4) AS over, round(under, 4) AS under, round(p5 * n, 4) AS background,
  round(greatest(remaining - p5 * n, 0), 4) AS improvable, round(CASE WHEN explained + over > 0 THEN explained / (explained + over) * 100 END, 4) AS efficiency FROM a""")
def power_decomposition(spark, sf_dir):
    signal = dense_grid(spark, sf_dir).select("house_id", "phase", F.col("watts").alias("original"), F.least("watts", F.lit(700.0)).alias("remaining"))
    return rounded(profile.decomposition(signal, ("house_id", "phase"), 300))


@query(f"""WITH {GRID_SQL} SELECT phase, count(*) FILTER (WHERE watts > 1300) AS minutes_over, count(*) FILTER (WHERE watts > 1300 AND least(watts, 900) <= 1300) AS minutes_explained, round(sum(watts - least(watts, 900)) / 60000, 4) AS kwh_explained FROM g GROUP BY phase""")
def threshold_explained(spark, sf_dir):
    rest = F.least("watts", F.lit(900.0))
    return rounded(dense_grid(spark, sf_dir).groupBy("phase").agg(F.count_if(F.col("watts") > 1300).alias("minutes_over"), F.count_if((F.col("watts") > 1300) & (rest <= 1300)).alias("minutes_explained"), (F.sum(F.col("watts") - rest) / 60000).alias("kwh_explained")))


# ---------------------------------------------------------------- joins

CANDIDATES_SQL = GRID_EDGES + """,
o AS (SELECT house_id, phase, 'on-' || "start" AS on_id, "start" AS on_start, "end" AS on_end, magnitude AS on_magnitude FROM edges WHERE event = 'on'),
k AS (SELECT house_id, phase, 'off-' || "start" AS off_id, "start" AS off_start, "end" AS off_end, magnitude AS off_magnitude FROM edges WHERE event = 'off'),
c AS (SELECT o.*, off_id, off_start, off_end, off_magnitude, off_start - on_end AS minutes, abs(abs(on_magnitude) - abs(off_magnitude)) AS difference FROM o JOIN k ON o.house_id = k.house_id AND o.phase = k.phase AND off_start > on_end AND off_start <= on_end + 360 AND abs(abs(on_magnitude) - abs(off_magnitude)) <= 350),
v AS (SELECT *, CASE WHEN minutes <= 15 THEN 15 WHEN minutes <= 30 THEN 30 WHEN minutes <= 60 THEN 60 WHEN minutes <= 120 THEN 120 WHEN minutes <= 240 THEN 240 ELSE 360 END AS win FROM c)"""


@query(CANDIDATES_SQL + """ SELECT house_id, phase, on_id, off_id, CAST(minutes AS BIGINT) AS minutes, round(difference, 4) AS difference, CAST(win AS BIGINT) AS "window" FROM v""")
def band_match_candidates(spark, sf_dir):
    return rounded(edge_pairs(dense_grid(spark, sf_dir), 800).select("house_id", "phase", "on_id", "off_id", "minutes", "difference", "window"))


@query(CANDIDATES_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY house_id, phase, on_id ORDER BY win, difference, minutes, off_id) AS nth FROM v)
SELECT house_id, on_id, off_id, CASE WHEN abs(abs(on_magnitude) - abs(off_magnitude)) < 50 THEN 'EXACT' WHEN abs(abs(on_magnitude) - abs(off_magnitude)) < 100 THEN 'CLOSE' WHEN abs(abs(on_magnitude) - abs(off_magnitude)) < 200 THEN 'APPROX' ELSE 'LOOSE' END
  || '-' || CASE WHEN minutes <= 2 THEN 'SPIKE' WHEN minutes < 5 THEN 'QUICK' WHEN minutes <= 30 THEN 'MEDIUM' ELSE 'EXTENDED' END AS tag FROM b WHERE nth = 1""")
def best_match_tags(spark, sf_dir):
    pairs = edge_pairs(dense_grid(spark, sf_dir), 800).withColumn("on_key", F.col("on_id")).withColumn("on_id", F.concat_ws("/", "house_id", "phase", "on_id"))
    best = joins.best_candidate(pairs)
    return best.select("house_id", F.col("on_key").alias("on_id"), "off_id", sessions.match_tag(F.col("on_magnitude"), F.col("off_magnitude"), F.col("minutes")).alias("tag"))


def kinds(spark, sf_dir, kind: str, prefix: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{prefix}_id"), SEC("ts").alias(f"{prefix}_at"))


TWO_SQL = f"""WITH l AS (SELECT user_id, event_id AS left_id, {EPOCH.format("ts")} AS left_at FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS right_id, {EPOCH.format("ts")} AS right_at FROM events WHERE event_type = 'click'),
p AS (SELECT l.user_id, left_id, left_at, right_id, right_at, abs(right_at - left_at) AS distance, row_number() OVER (PARTITION BY left_id ORDER BY abs(right_at - left_at), right_at, right_id) AS nth FROM l JOIN r ON l.user_id = r.user_id AND abs(right_at - left_at) <= 21600)"""


@query(TWO_SQL + " SELECT l.user_id, l.left_id, right_id, distance FROM l LEFT JOIN p ON l.left_id = p.left_id AND nth = 1")
def asof_nearest(spark, sf_dir):
    found = joins.nearest(kinds(spark, sf_dir, "purchase", "left"), kinds(spark, sf_dir, "click", "right"), ["user_id"], "left_at", "right_at", 21_600, "left_id", "right_id")
    return found.select("user_id", "left_id", "right_id", "distance")


@query(TWO_SQL + " SELECT l.user_id, l.left_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE l.user_id = r.user_id AND abs(right_at - left_at) <= 21600)")
def anti_asof(spark, sf_dir):
    return joins.without_near(kinds(spark, sf_dir, "purchase", "left"), kinds(spark, sf_dir, "click", "right"), ["user_id"], "left_at", "right_at", 21_600, "left_id").select("user_id", "left_id")


@query(f"""WITH e AS (SELECT user_id, event_id, {EPOCH.format("ts")} AS a FROM events) SELECT x.event_id, count(y.event_id) - 1 AS n_near FROM e x JOIN e y ON x.user_id = y.user_id AND abs(x.a - y.a) <= 7200 GROUP BY x.event_id""")
def near_counts(spark, sf_dir):
    return joins.near_counts(read(spark, sf_dir, "events").select("user_id", "event_id", SEC("ts").alias("a")), ["user_id"], "a", 7200).select("event_id", "n_near")


@query(INTERVALS_SQL + """ SELECT a.id AS l_id, b.id AS r_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM i a JOIN i b ON a.user_id = b.user_id AND a.id % 2 = 0 AND b.id % 2 = 1 AND a.s <= b.e + 600 AND b.s <= a.e + 600""")
def interval_overlaps(spark, sf_dir):
    i = intervals(spark, sf_dir)
    side = lambda p, odd: i.where(F.col("id") % 2 == odd).select("user_id", F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))
    found = joins.overlaps(side("l", 0), side("r", 1), ["user_id"], 600, 86_400)
    return found.select("l_id", "r_id", (F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("overlap"))


# ---------------------------------------------------------------- sessions


def usage(spark, sf_dir) -> DataFrame:
    """Every event as a run of a device: its magnitude is ten times the value, its minutes follow the id."""
    e = read(spark, sf_dir, "events")
    minutes = (F.col("event_id") % 40 + 1).cast("double")
    return e.select(
        F.col("user_id").alias("house_id"), F.concat(F.lit("w"), (F.col("user_id") % 3 + 1).cast("string")).alias("phase"), F.col("event_id").alias("id"), SEC("ts").alias("start"),
        (SEC("ts") + (minutes * 60).cast("long")).alias("end"), (F.col("value") * 10).alias("magnitude"), minutes.alias("duration"), (F.col("event_id") % 4).alias("iteration"), (F.col("event_id") % 4).alias("threshold"), "event_type",
    )


USAGE_SQL = f"""WITH u AS (SELECT user_id AS house_id, 'w' || CAST(user_id % 3 + 1 AS VARCHAR) AS phase, event_id AS id, {EPOCH.format("ts")} AS s, {EPOCH.format("ts")} + (event_id % 40 + 1) * 60 AS e, value * 10 AS magnitude,
  CAST(event_id % 40 + 1 AS DOUBLE) AS duration, event_id % 4 AS iteration, event_id % 4 AS threshold, event_type FROM events),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY house_id, phase ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY house_id, phase ORDER BY s, id) <= 14400 THEN 0 ELSE 1 END AS fresh FROM u)),
st AS (SELECT house_id, phase, CAST(session AS BIGINT) AS session, min(s) AS "start", max(e) AS "end", count(*) AS n_events, avg(magnitude) AS avg_magnitude, max(magnitude) AS max_magnitude, CASE WHEN avg(magnitude) > 0 THEN stddev_pop(magnitude) / avg(magnitude) END AS magnitude_cv, avg(duration) AS avg_duration, count(DISTINCT threshold) AS n_thresholds FROM q GROUP BY house_id, phase, session)"""


def sessioned(spark, sf_dir) -> DataFrame:
    return sessions.sessionise(usage(spark, sf_dir), ["house_id", "phase"], "start", "end", 14_400, "id")


@query(USAGE_SQL + """ SELECT house_id, phase, session, "start", "end", n_events, round(avg_magnitude, 4) AS avg_magnitude, round(max_magnitude, 4) AS max_magnitude, round(magnitude_cv, 4) AS magnitude_cv, round(avg_duration, 4) AS avg_duration, n_thresholds FROM st""")
def session_stats(spark, sf_dir):
    return rounded(sessions.session_stats(sessioned(spark, sf_dir), ["house_id", "phase"]))


@query(USAGE_SQL + """, c AS (SELECT *, count(*) OVER (PARTITION BY house_id, phase, session) AS n, row_number() OVER w AS i, quantile_cont(duration, 0.5) OVER (PARTITION BY house_id, phase, session ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS md FROM q WINDOW w AS (PARTITION BY house_id, phase, session ORDER BY s, id)),
f AS (SELECT *, min(CASE WHEN n >= 3 AND i BETWEEN 2 AND 4 AND duration >= 10 AND duration >= 3 * md THEN i END) OVER (PARTITION BY house_id, phase, session) AS cut FROM c)
SELECT id, CAST(session AS BIGINT) AS session, CAST(CASE WHEN i >= cut THEN 1 ELSE 0 END AS BIGINT) AS part FROM f""")
def session_split(spark, sf_dir):
    return rounded(sessions.split_at_long(sessioned(spark, sf_dir), ["house_id", "phase"], ["start", "id"]).select("id", "session", "part"))


@query(USAGE_SQL + """ SELECT iteration, phase, count(*) AS n_events, count(*) FILTER (WHERE duration < 2) AS n_spikes, coalesce(sum(duration) FILTER (WHERE duration < 2), 0.0) AS spike_minutes, coalesce(sum(duration) FILTER (WHERE NOT duration < 2), 0.0) AS kept_minutes,
  count(*) FILTER (WHERE duration >= 2 AND duration < 15) AS n_short, count(*) FILTER (WHERE duration >= 15) AS n_long FROM u GROUP BY GROUPING SETS ((), (iteration), (phase))""")
def spike_filter_stats(spark, sf_dir):
    return sessions.spike_statistics(usage(spark, sf_dir)).select("iteration", "phase", "n_events", "n_spikes", "spike_minutes", "kept_minutes", "n_short", "n_long")


@query(USAGE_SQL + """, m AS (SELECT event_type, quantile_cont(magnitude, 0.5) AS md FROM u GROUP BY event_type), d AS (SELECT u.*, md, abs(magnitude - md) AS dev FROM u JOIN m ON u.event_type = m.event_type), a AS (SELECT event_type, quantile_cont(dev, 0.5) AS mad FROM d GROUP BY event_type)
SELECT d.id, round((magnitude - md) / CASE WHEN mad = 0 THEN 1 ELSE mad END, 4) AS z, round(CASE WHEN duration <= 3 THEN 0.5 WHEN duration >= 30 THEN 1 ELSE 0.5 + 0.5 * (duration - 3) / 27 END, 4) AS duration_score FROM d JOIN a ON d.event_type = a.event_type""")
def population_z(spark, sf_dir):
    found = sessions.robust_z(usage(spark, sf_dir), ["event_type"], "magnitude")
    return rounded(found.select("id", "z", sessions.linear_score(F.col("duration"), 3, 30).alias("duration_score")))


SIGNATURE_SQL = USAGE_SQL + """, g AS (SELECT house_id, iteration AS pattern_id, avg(magnitude) AS magnitude, avg(duration) AS duration, count(*) AS n FROM u GROUP BY house_id, iteration HAVING count(*) >= 2 AND avg(duration) >= 10)"""


def signatures(spark, sf_dir) -> DataFrame:
    magnitude = ordered_sum(F.col("magnitude"), "id") / F.count("magnitude")  # pairs exactly a tolerance apart hang on the last digit
    found = usage(spark, sf_dir).groupBy("house_id", F.col("iteration").alias("pattern_id")).agg(magnitude.alias("magnitude"), F.avg("duration").alias("duration"), F.count("*").alias("n"))
    return found.where("n >= 2 and duration >= 10")


@query(SIGNATURE_SQL + """ SELECT house_id, pattern_id, round(magnitude, 4) AS magnitude, round(duration, 4) AS duration, n FROM g""")
def pattern_signatures(spark, sf_dir):
    return rounded(signatures(spark, sf_dir))


@query(SIGNATURE_SQL + """ SELECT a.house_id AS house_id_a, a.pattern_id AS pattern_id_a, b.house_id AS house_id_b, b.pattern_id AS pattern_id_b FROM g a JOIN g b ON a.house_id < b.house_id
  AND abs(a.magnitude - b.magnitude) <= 0.02 * greatest(a.magnitude, b.magnitude) AND abs(a.duration - b.duration) <= 0.05 * greatest(a.duration, b.duration)""")
def cross_house_pairs(spark, sf_dir):
    return sessions.signature_pairs(signatures(spark, sf_dir), 0.02, 0.05).select("house_id_a", "pattern_id_a", "house_id_b", "pattern_id_b")


# ---------------------------------------------------------------- set operations and ranking


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY fresh, o_orderkey) AS n FROM (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS fresh FROM orders))
SELECT o_custkey, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM b WHERE n = 1""")
def upsert_keep_first(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    fresh = F.col("o_orderkey") % 3 == 0
    found = ingest.upsert(orders.where(~fresh), orders.where(fresh), ["o_custkey", "day"], ["o_orderkey"])
    return rounded(found.select("o_custkey", "o_orderkey", "o_totalprice"))


@query("""SELECT c_custkey, phase, round(power, 4) AS power FROM (SELECT c_custkey, 'w1' AS phase, c_acctbal AS power FROM customer UNION ALL SELECT c_custkey, 'w2', c_acctbal - 1000 FROM customer) WHERE power < 0""")
def unpivot_negatives(spark, sf_dir):
    wide = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("w1"), (F.col("c_acctbal") - 1000).alias("w2"))
    return rounded(ingest.negatives(wide, ["w1", "w2"]))


@query(f"""WITH {SERIES_SQL} SELECT house_id, round(sum(watts), 4) AS energy FROM s GROUP BY house_id ORDER BY sum(watts) DESC, house_id LIMIT 20""")
def top_houses(spark, sf_dir):
    return rounded(power_series(spark, sf_dir).groupBy("house_id").agg(F.sum("watts").alias("energy")).orderBy(F.desc("energy"), "house_id").limit(20))


@query(f"""WITH {SERIES_SQL}, t AS (SELECT month, house_id, sum(watts) AS energy FROM s GROUP BY month, house_id), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY energy) AS i, count(*) OVER (PARTITION BY month) AS n FROM t)
SELECT month, count(*) AS n_houses, round(min(energy), 4) AS least, round(max(energy), 4) AS most, round(max(CASE WHEN i = n // 2 + 1 THEN energy END), 4) AS upper_median FROM r GROUP BY month""")
def monthly_rollup(spark, sf_dir):
    houses = power_series(spark, sf_dir).groupBy("month", "house_id").agg(F.sum("watts").alias("energy"))
    return rounded(houses.groupBy("month").agg(F.count("*").alias("n_houses"), F.min("energy").alias("least"), F.max("energy").alias("most")).join(profile.middle_of(houses, ["month"], "energy", "upper_median"), "month"))


# ---------------------------------------------------------------- order-dependent steps (no SQL)


@query()
def gradual_edges(spark, sf_dir):
    return kernels.gradual(edges.with_diff(dense_grid(spark, sf_dir), order=("m",)), 1300)


@query()
def greedy_matches(spark, sf_dir):
    """All three stages on the grid's edges: pairs, remainders and what is left over."""
    grid = staged(dense_grid(spark, sf_dir).select(*detection.MONTHLY, "m", "watts"))
    found = detection.numbered(detection.detect(grid, 800), grid, 0)
    return rounded(matching.match(grid, found).select("house_id", "phase", "status", "stage", "on_id", "off_id", "minutes", "on_magnitude", "off_magnitude", "correction", "tag"))


@query()
def disaggregated(spark, sf_dir):
    """Matches of all four thresholds by house, phase and iteration, with the energy still left."""
    out = disaggregate(dense_grid(spark, sf_dir))
    rest = out.remaining.groupBy("house_id", "phase").agg(F.sum("watts").alias("remaining"))
    counts = out.matches.where("status = 'matched'").groupBy("house_id", "phase").pivot("iteration", list(range(len(THRESHOLDS)))).agg(F.count("on_id"))
    return rounded(rest.join(counts, ["house_id", "phase"], "left").na.fill(0))


@query()
def segment_power(spark, sf_dir):
    """Energy before and after a round on real readings, and taken out by short, medium and long pairs."""
    grid = staged(reading_grid(spark, sf_dir))
    found = detection.numbered(detection.detect(grid, 2000), grid, 0)
    return rounded(matching.summary(matching.extract(grid, matching.match(grid, found))))


@query()
def wave_patterns(spark, sf_dir):
    return kernels.find_waves(dense_grid(spark, sf_dir))


@query()
def cycling_sequences(spark, sf_dir):
    minutes = usage(spark, sf_dir).withColumns({"start": F.col("start") / 60, "end": F.col("end") / 60})
    return kernels.cycling(minutes.select("house_id", "phase", "id", "start", "end", "magnitude"))


@query()
def recurring_patterns(spark, sf_dir):
    stats = sessions.session_stats(sessioned(spark, sf_dir), ["house_id", "phase"])
    return kernels.recurring(stats, ("avg_magnitude", "avg_duration", "n_events", "magnitude_cv")).select("house_id", "phase", "session", "cluster")


# ---------------------------------------------------------------- devices and reports


@query(f"""WITH {GRID_SQL}, b AS (SELECT house_id, phase, quantile_cont(watts, 0.05) AS base FROM g GROUP BY ALL),
o AS (SELECT g.house_id, g.phase, m, watts - base AS above, m - row_number() OVER (PARTITION BY g.house_id, g.phase ORDER BY m) AS region FROM g JOIN b ON g.house_id = b.house_id AND g.phase = b.phase WHERE watts - base >= 300),
d AS (SELECT *, quantile_cont(above, 0.5) OVER (PARTITION BY house_id, phase, region) AS md FROM o),
x AS (SELECT *, CASE WHEN sign(above - md) <> lag(sign(above - md)) OVER (PARTITION BY house_id, phase, region ORDER BY m) THEN 1 ELSE 0 END AS crossed FROM d),
r AS (SELECT house_id, phase, min(m) AS s, max(m) AS e, count(*) AS minutes, avg(above) AS a, max(above) AS mx, sum(above) / 60 AS wh, sum(crossed) AS crossings, stddev_pop(above) / avg(above) AS cv FROM x GROUP BY house_id, phase, region)
SELECT house_id, phase, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", minutes, round(a, 4) AS avg_above, round(mx, 4) AS max_above, round(wh, 4) AS watt_hours, CAST(crossings AS BIGINT) AS crossings,
  CASE WHEN minutes < 5 THEN 'spike' WHEN crossings >= 6 THEN 'cycling' WHEN cv < 0.15 THEN 'flat' ELSE 'gradual' END AS shape FROM r WHERE minutes BETWEEN 3 AND 1440""")
def remaining_events(spark, sf_dir):
    return rounded(devices.remaining_events(dense_grid(spark, sf_dir)))


@query(USAGE_SQL + """ SELECT id, magnitude + 0.0 AS magnitude FROM (SELECT id, round(magnitude, 4) AS magnitude FROM u a WHERE duration >= 15 AND magnitude >= 1500 AND NOT EXISTS (
  SELECT 1 FROM u b WHERE b.house_id = a.house_id AND b.phase = a.phase AND b.duration BETWEEN 3 AND 30 AND NOT (b.duration >= 15 AND b.magnitude >= 1500) AND abs(b.s - a.s) <= 1800))""")
def isolated_boilers(spark, sf_dir):
    return rounded(devices.boiler_candidates(usage(spark, sf_dir)).select("id", "magnitude"))


BY_TYPE = USAGE_SQL.replace("'w' || CAST(user_id % 3 + 1 AS VARCHAR) AS phase", "event_type AS phase")


def by_type(spark, sf_dir) -> DataFrame:
    return usage(spark, sf_dir).withColumn("phase", F.col("event_type"))


@query(BY_TYPE + """ SELECT a.id AS l_id, b.id AS r_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM u a JOIN u b ON a.house_id = b.house_id AND a.phase < b.phase AND a.duration >= 15 AND b.duration >= 15
  AND greatest(a.duration, b.duration) <= 2 * least(a.duration, b.duration) AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.5 * least(a.duration, b.duration) * 60""")
def simultaneous_runs(spark, sf_dir):
    return devices.simultaneous(by_type(spark, sf_dir))


@query(USAGE_SQL + """, t AS (SELECT *, event_type AS device_type, e AS fin, s // 86400 AS day FROM u), l AS (SELECT *, CASE WHEN lead(s) OVER (PARTITION BY house_id, device_type ORDER BY s, id) < fin THEN 1 ELSE 0 END AS o FROM t),
p AS (SELECT device_type, max(n) / sum(n) AS share FROM (SELECT device_type, phase, count(*) AS n FROM t GROUP BY ALL) GROUP BY device_type)
SELECT l.device_type, count(*) AS n_events, round(stddev_pop(magnitude) / avg(magnitude), 4) AS magnitude_cv, quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.75) AS q3, CAST(sum(o) AS BIGINT) AS n_overlaps, round(any_value(share), 4) AS main_phase_share,
  round(count(DISTINCT day) / (SELECT count(DISTINCT day) FROM t), 4) AS temporal FROM l JOIN p ON l.device_type = p.device_type GROUP BY l.device_type""")
def device_quality(spark, sf_dir):
    found = devices.device_quality(usage(spark, sf_dir).withColumn("device_type", F.col("event_type")))
    return found.select("device_type", "n_events", "q1", "q3", "n_overlaps", *[(F.round(F.col(c) + NUDGE, 4) + 0.0).alias(c) for c in ("magnitude_cv", "main_phase_share", "temporal")])


@query(f"""WITH {GRID_SQL}, a AS (SELECT house_id, phase, m, watts - lag(watts) OVER (PARTITION BY house_id, phase ORDER BY m) AS d FROM g),
x AS (SELECT a.house_id, a.phase, k.lag, a.d, b.d AS past FROM a CROSS JOIN (SELECT CAST(range AS BIGINT) AS lag FROM range(3, 8)) k LEFT JOIN a b ON b.house_id = a.house_id AND b.phase = a.phase AND b.m = a.m - k.lag)
SELECT house_id, phase, lag, round(corr(d, past), 4) AS correlation FROM x GROUP BY house_id, phase, lag""")
def wave_autocorrelation(spark, sf_dir):
    return rounded(devices.autocorrelation(dense_grid(spark, sf_dir), range(3, 8)))


@query(f"""WITH {SERIES_SQL} SELECT house_id, {EPOCH.format("time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01 06:00:00')")} AS segment, count(*) AS n, round(avg(watts), 4) AS avg_watts FROM s GROUP BY ALL""")
def day_night_segments(spark, sf_dir):
    slot = F.window("ts", "12 hours", "12 hours", "6 hours")
    found = power_series(spark, sf_dir).groupBy("house_id", slot.alias("w")).agg(F.count("*").alias("n"), F.avg("watts").alias("avg_watts"))
    return rounded(found.select("house_id", SEC("w.start").alias("segment"), "n", "avg_watts"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, round(avg(n), 4) AS per_day, min(n) AS least, max(n) AS most, round(stddev_samp(n), 4) AS spread FROM d GROUP BY user_id""")
def daily_stats(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rounded(days.groupBy("user_id").agg(F.avg("n").alias("per_day"), F.min("n").alias("least"), F.max("n").alias("most"), F.stddev_samp("n").alias("spread")))


@query(USAGE_SQL + """, b AS (SELECT phase, CAST(floor(magnitude / 100) AS BIGINT) AS bucket, CAST((s // 3600) % 24 AS BIGINT) AS hour, s // 86400 AS day FROM u)
SELECT phase, bucket, hour, count(*) AS n, count(DISTINCT day) AS days FROM b GROUP BY ALL HAVING count(DISTINCT day) >= 3""")
def recurring_hours(spark, sf_dir):
    at = F.col("start")
    found = usage(spark, sf_dir).groupBy("phase", F.floor(F.col("magnitude") / 100).alias("bucket"), (F.floor(at / 3600) % 24).alias("hour")).agg(F.count("*").alias("n"), F.count_distinct(F.floor(at / 86_400)).alias("days"))
    return found.where("days >= 3")


@query(USAGE_SQL + """, c AS (SELECT iteration, count(*) AS n, sum(magnitude * duration / 60000) AS kwh FROM u GROUP BY iteration)
SELECT iteration, n, round(kwh, 4) AS kwh, round(sum(kwh) OVER (ORDER BY iteration), 4) AS kwh_so_far, n - lag(n) OVER (ORDER BY iteration) AS n_more FROM c""")
def iteration_progress(spark, sf_dir):
    rounds = usage(spark, sf_dir).groupBy("iteration").agg(F.count("*").alias("n"), F.sum(F.col("magnitude") * F.col("duration") / 60_000).alias("kwh"))
    w = W.orderBy("iteration")  # a row per iteration
    return rounded(rounds.withColumn("kwh_so_far", F.sum("kwh").over(w)).withColumn("n_more", F.col("n") - F.lag("n").over(w)))


@query(CANDIDATES_SQL + """ SELECT o.house_id, o.on_id FROM o WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.house_id = o.house_id AND v.phase = o.phase AND v.on_id = o.on_id)""")
def unmatched_on(spark, sf_dir):
    grid = dense_grid(spark, sf_dir)
    on = edges.sharp_edges(grid, 800, order=("m",)).where("event = 'on'").select("house_id", "phase", F.concat_ws("-", "event", F.col("start").cast("string")).alias("on_id"))
    return on.join(edge_pairs(grid, 800), ["house_id", "phase", "on_id"], "left_anti").select("house_id", "on_id")


def _tail_sql(minutes: int = 10) -> str:
    """The walk along falling minutes, a column a minute."""
    at = ", ".join(f"lead(watts, {k} + 0) OVER w AS c{k}" for k in range(1, minutes + 1))
    lives = "c0 AS (SELECT *, watts AS c0, true AS l0 FROM t)"
    for k in range(1, minutes + 1):
        lives += f", l{k} AS (SELECT *, l{k - 1} AND coalesce(c{k} <= c{k - 1} + 30, false)" + (f" AND c{k - 1} >= 100" if k > 1 else "") + f" AS l{k} FROM {'c0' if k == 1 else f'l{k - 1}'})"
    reached = " ".join(f"WHEN l{k} THEN {{}}{k}" for k in range(minutes, 0, -1))
    walked = f"CASE {reached.replace('{}', '')} ELSE 0 END AS far, CASE {reached.replace('{}', 'c')} ELSE c0 END AS low"
    return GRID_EDGES + f""", t AS (SELECT *, {at} FROM g WINDOW w AS (PARTITION BY house_id, phase ORDER BY m)), {lives},
ft AS (SELECT house_id, phase, m, c0, {walked} FROM l{minutes}), j AS (SELECT edges.*, c0, far, low, c0 >= 100 AND c0 >= 0.05 * abs(magnitude) AND c0 - low >= 100 AS taken FROM edges JOIN ft ON ft.house_id = edges.house_id AND ft.phase = edges.phase AND ft.m = "end" WHERE event = 'off')
SELECT house_id, phase, CAST("start" AS BIGINT) AS "start", CAST(CASE WHEN taken THEN "end" + far ELSE "end" END AS BIGINT) AS "end", round(CASE WHEN taken THEN magnitude - (c0 - low) ELSE magnitude END, 4) AS magnitude, taken AS tail_extended, CAST(CASE WHEN taken THEN "end" END AS BIGINT) AS original_end FROM j"""


@query(_tail_sql())
def extended_tails(spark, sf_dir):
    grid = dense_grid(spark, sf_dir)
    return rounded(devices.extend_tails(edges.sharp_edges(grid, 800, order=("m",)).where("event = 'off'").drop("event", "n_rows"), grid))


@query()
def session_documents(spark, sf_dir):
    return devices.session_documents(sessions.session_stats(sessioned(spark, sf_dir), ["house_id", "phase"]))


@query(GRID_EDGES.replace("800", "1700").replace("640", "1360") + """, k AS (SELECT CAST(b.range AS INTEGER) AS b, CAST(a.range AS INTEGER) AS a FROM range(4) b, range(4) a),
miss AS (SELECT d.*, (SELECT count(*) FROM edges e WHERE e.event = 'on' AND e.house_id = d.house_id AND e.phase = d.phase AND d.m BETWEEN e."start" AND e."end") AS covered FROM d WHERE diff >= 1445 AND diff < 1700),
x AS (SELECT y.house_id, y.phase, y.m, k.b, k.a, hi.watts - lo.watts AS magnitude, row_number() OVER (PARTITION BY y.house_id, y.phase, y.m ORDER BY k.a + k.b, k.a) AS nth
  FROM miss y CROSS JOIN k JOIN g hi ON hi.house_id = y.house_id AND hi.phase = y.phase AND hi.m = y.m + k.a JOIN g lo ON lo.house_id = y.house_id AND lo.phase = y.phase AND lo.m = y.m - 1 - k.b WHERE covered = 0 AND hi.watts - lo.watts >= 1700)
SELECT house_id, phase, CAST(m - b AS BIGINT) AS "start", CAST(m + a AS BIGINT) AS "end", round(magnitude, 4) AS magnitude FROM x WHERE nth = 1""")
def near_threshold_edges(spark, sf_dir):
    grid = dense_grid(spark, sf_dir)
    return rounded(edges.near_threshold(grid, edges.sharp_edges(grid, 1700, order=("m",)), 1700))


def _edges(spark, sf_dir, threshold: float) -> tuple[DataFrame, DataFrame]:
    grid = dense_grid(spark, sf_dir)
    return grid, edges.sharp_edges(grid, threshold, order=("m",)).drop("n_rows")


MERGED_SQL = GRID_EDGES.replace("diff >= 800", "diff >= 250").replace("diff <= -640", "diff <= -200") + """,
o AS (SELECT *, max("end") OVER (PARTITION BY house_id, phase ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM edges WHERE event = 'off'),
j AS (SELECT *, CASE WHEN "start" - last BETWEEN 0 AND 2
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.event = 'on' AND e.house_id = o.house_id AND e.phase = o.phase AND e."start" > o.last AND e."start" < o."start")
    AND (SELECT avg(watts) FROM g WHERE g.house_id = o.house_id AND g.phase = o.phase AND g.m BETWEEN o.last AND o."start") >= 0.5 * abs(magnitude) THEN 0 ELSE 1 END AS fresh2 FROM o),
i AS (SELECT *, sum(fresh2) OVER (PARTITION BY house_id, phase ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM j),
k AS (SELECT house_id, phase, min("start") AS s, max("end") AS e, sum(magnitude) AS total, count(*) AS n_merged FROM i GROUP BY house_id, phase, island)
SELECT k.house_id, k.phase, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", round(CASE WHEN n_merged > 1 THEN coalesce(a.watts - b.watts, total) ELSE total END, 4) AS magnitude, n_merged
FROM k LEFT JOIN g a ON a.house_id = k.house_id AND a.phase = k.phase AND a.m = e LEFT JOIN g b ON b.house_id = k.house_id AND b.phase = k.phase AND b.m = s - 1"""


@query(MERGED_SQL)
def merged_split_offs(spark, sf_dir):
    grid, found = _edges(spark, sf_dir, 250)
    return rounded(detection.merge_split_offs(found.where("event = 'off'"), found.where("event = 'on'"), grid, ("house_id", "phase")))


def _settle_sql(edges_: str, kind: str, out: str) -> str:
    """One step of settling: ``edges_`` with the edges of a kind moved, as ``out``."""
    on = kind == "on"
    at, d, first = ("w.e + w.k + 1", "d.diff", "e") if on else ("w.s - w.k - 1", "-d.diff", "s")
    stop = f"(d.m IS NULL OR d.busy OR d.diff IS NULL OR {d} > 0.1 * abs(w.magnitude))"
    power = lambda name, m: f"LEFT JOIN g {name} ON {name}.house_id = x.house_id AND {name}.phase = x.phase AND {name}.m = {m}"
    joins = [power("f0", "x.e"), power("t0", "x.last"), power("b0", "x.s - 1")] if on else [power("f0", "x.s - 1"), power("t0", "x.last - 1"), power("b0", "x.e + 1"), power("z0", "x.e")]
    size = "t0.watts - coalesce(b0.watts, 0)" if on else "coalesce(b0.watts, z0.watts, 0) - t0.watts"
    good = f"coalesce({size} {'>' if on else '<'} 0 AND f0.watts - t0.watts >= 0.25 * abs(x.magnitude), false)"
    return f""", busy_{kind} AS (SELECT DISTINCT d.house_id, d.phase, d.m FROM d JOIN {edges_} q ON q.house_id = d.house_id AND q.phase = d.phase AND d.m BETWEEN q.s AND q.e),
d_{kind} AS MATERIALIZED (SELECT d.house_id, d.phase, d.m, d.diff, b.m IS NOT NULL AS busy FROM d LEFT JOIN busy_{kind} b ON b.house_id = d.house_id AND b.phase = d.phase AND b.m = d.m),
w_{kind} AS (SELECT house_id, phase, event, s, e, magnitude, 0 AS k, CAST(NULL AS INTEGER) AS last, 0 AS steady, true AS live FROM {edges_} WHERE event = '{kind}'
  UNION ALL SELECT w.house_id, w.phase, w.event, w.s, w.e, w.magnitude, w.k + 1, CASE WHEN NOT {stop} AND {d} < 0 THEN d.m ELSE w.last END, CASE WHEN {stop} THEN w.steady WHEN {d} < 0 THEN 0 ELSE w.steady + 1 END,
    CASE WHEN {stop} THEN false WHEN {d} < 0 THEN true ELSE w.last IS NOT NULL AND w.steady < 1 END FROM w_{kind} w LEFT JOIN d_{kind} d ON d.house_id = w.house_id AND d.phase = w.phase AND d.m = {at} WHERE w.live AND w.k < 5),
x_{kind} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY house_id, phase, s, e ORDER BY k DESC) AS nth FROM w_{kind}) WHERE nth = 1),
y_{kind} AS (SELECT x.*, {good} AS good, {size} AS size FROM x_{kind} x {" ".join(joins)}),
{out} AS (SELECT house_id, phase, event, {"s, CASE WHEN good THEN last ELSE e END AS e" if on else "CASE WHEN good THEN last ELSE s END AS s, e"}, CASE WHEN good THEN size ELSE magnitude END AS magnitude, CASE WHEN good THEN magnitude END AS original FROM y_{kind}
  UNION ALL SELECT house_id, phase, event, s, e, magnitude, original FROM {edges_} WHERE event <> '{kind}')"""


SETTLED_SQL = (
    GRID_EDGES.replace("diff >= 800", "diff >= 600").replace("diff <= -640", "diff <= -480").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e0 AS (SELECT house_id, phase, event, "start" AS s, "end" AS e, magnitude, CAST(NULL AS DOUBLE) AS original FROM edges)"""
    + _settle_sql("e0", "on", "e1") + _settle_sql("e1", "off", "e2")
    + """ SELECT house_id, phase, event, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", round(magnitude, 4) AS magnitude, round(original, 4) AS original_magnitude FROM e2"""
)


@query(SETTLED_SQL)
def settled_edges(spark, sf_dir):
    grid, found = _edges(spark, sf_dir, 600)
    for kind in ("on", "off"):
        found = staged(detection.settle(found, grid, kind, ("house_id", "phase")))
    return rounded(found.select("house_id", "phase", "event", "start", "end", "magnitude", "original_magnitude"))


@query()
def detected_edges(spark, sf_dir):
    """The whole composition on real readings, numbered, with the power beside every edge."""
    grid = staged(reading_grid(spark, sf_dir))
    found = detection.detect(grid, 1500, detection.Features(near_threshold=True))
    return rounded(detection.numbered(found, grid, 0).select("house_id", "month", "phase", "event", "start", "end", "magnitude", "event_id", "nearby_value"))


FLAGSHIP = session_stats

from gridloom.plans import house_queries, pattern_queries, run_queries  # noqa: E402, F401

"""Queries on houses: quality, runs, windows, evaluation, months, tables of stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators import profile, quality, reports
from gridloom.plans.registry import EPOCH, SEC, query, rounded
from gridloom.sources.tables import HOLES_SQL, SERIES_SQL, as_raw, ordered_sum, power_series, read


def phase_series(spark, sf_dir, holes: bool = True) -> DataFrame:
    """Readings of ``events`` of houses with three phases: three users are a house."""
    return power_series(spark, sf_dir, holes).withColumn("house_id", F.floor(F.col("house_id") / 3))


PHASES_SQL = HOLES_SQL.replace("user_id AS house_id", "user_id // 3 AS house_id")


def _knots(x: str, knots: list[tuple[float, float]]) -> str:
    out = f"CASE WHEN {x} <= {knots[0][0]} THEN {knots[0][1]}"
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out += f" WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) / ({x1} - {x0}) * ({y1} - {y0})"
    return f"{out} ELSE {knots[-1][1]} END"


QUALITY_SQL = f"""WITH {PHASES_SQL},
k AS (SELECT *, lag(watts) OVER w AS prev, stddev_samp(watts) OVER p AS dev, avg(watts) OVER p AS mean FROM s WHERE watts IS NOT NULL WINDOW w AS (PARTITION BY house_id, phase ORDER BY ts, event_id), p AS (PARTITION BY house_id, phase)),
c AS (SELECT *, coalesce(prev, 0) < 1300 AND watts >= 1300 AS crossed, sum(CASE WHEN watts >= 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM k),
u AS (SELECT house_id, phase, count(*) AS runs FROM (SELECT house_id, phase, run FROM c WHERE watts >= 2000 GROUP BY house_id, phase, run HAVING count(*) >= 20) GROUP BY house_id, phase),
a AS (SELECT house_id, phase, count(*) AS n_known, sum(watts) AS power, count(*) FILTER (WHERE watts < 0) AS n_negative, count(*) FILTER (WHERE abs(watts - prev) > 2000) AS n_jumps,
  avg(CASE WHEN dev > 0 AND abs(watts - mean) > 3 * dev THEN 1.0 ELSE 0.0 END) AS outlier_share,
  CASE WHEN count(*) FILTER (WHERE crossed) > 0 THEN count(*) FILTER (WHERE crossed AND watts - coalesce(prev, 0) >= 1300) / count(*) FILTER (WHERE crossed) END AS sharp_rate,
  avg(CASE WHEN watts >= 500 AND watts < 1000 THEN 1.0 ELSE 0.0 END) AS mid_share, avg(CASE WHEN watts < 100 THEN 1.0 ELSE 0.0 END) AS low_share, avg(CASE WHEN watts >= 800 THEN 1.0 ELSE 0.0 END) AS high_share, count(*) FILTER (WHERE watts > 20000) AS n_extreme FROM c GROUP BY house_id, phase),
z AS (SELECT house_id, phase, count(*) AS n FROM s GROUP BY house_id, phase),
b AS (SELECT z.house_id, z.phase, z.n, a.* EXCLUDE (house_id, phase, power), coalesce(a.power, 0) AS power, 1 - coalesce(n_known, 0) / z.n AS missing_share, CASE WHEN n_known >= 30 THEN coalesce(runs, 0) / (n_known / 10000) END AS sustained
  FROM z LEFT JOIN a ON a.house_id = z.house_id AND a.phase = z.phase LEFT JOIN u ON u.house_id = z.house_id AND u.phase = z.phase),
d AS (SELECT *, (sum(power) OVER (PARTITION BY house_id) - power) / nullif(count(*) OVER (PARTITION BY house_id) - 1, 0) AS sisters FROM b),
ph AS (SELECT *, coalesce(sisters > 0 AND power < 0.02 * sisters, false) AS dead, NOT coalesce(sisters > 0 AND power < 0.02 * sisters, false) AND missing_share >= 0.10 AS faulty FROM d)"""


@query(QUALITY_SQL + """ SELECT house_id, phase, n, n_known, n_negative, n_jumps, n_extreme, round(power, 4) AS power, round(outlier_share, 4) AS outlier_share, round(sharp_rate, 4) AS sharp_rate, round(mid_share, 4) AS mid_share,
  round(low_share, 4) AS low_share, round(high_share, 4) AS high_share, round(missing_share, 4) AS missing_share, round(sustained, 4) AS sustained, dead, faulty FROM ph""")
def quality_phases(spark, sf_dir):
    return rounded(quality.phase_measures(phase_series(spark, sf_dir), least=30))


#: Compressor cycles in recursive SQL: a series' rises one after the other, each takes the first fall that fits and is not in ``taken``.
CYCLES_SQL = """dd AS (SELECT house_id, month, phase, row_number() OVER w AS i, watts - lag(watts) OVER w AS d FROM s WHERE watts IS NOT NULL WINDOW w AS (PARTITION BY house_id, month, phase ORDER BY ts, event_id)),
cf AS (SELECT a.house_id, a.month, a.phase, a.i, list(b.i ORDER BY b.i) AS falls FROM dd a JOIN dd b ON a.house_id = b.house_id AND a.month = b.month AND a.phase = b.phase AND b.i BETWEEN a.i + 3 AND a.i + 30
  WHERE a.d BETWEEN 1300 AND 3000 AND -b.d >= 1300 AND abs(-b.d / a.d - 1) <= 0.30 GROUP BY ALL),
cn AS (SELECT *, row_number() OVER (PARTITION BY house_id, month, phase ORDER BY i) AS k FROM cf),
cw AS (SELECT DISTINCT house_id, month, phase, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken FROM s
  UNION ALL SELECT cw.house_id, cw.month, cw.phase, cn.k, CASE WHEN len(list_filter(cn.falls, lambda x: NOT list_contains(cw.taken, x))) > 0 THEN list_append(cw.taken, list_filter(cn.falls, lambda x: NOT list_contains(cw.taken, x))[1]) ELSE cw.taken END
  FROM cw JOIN cn ON cn.house_id = cw.house_id AND cn.month = cw.month AND cn.phase = cw.phase AND cn.k = cw.k + 1),
cc AS (SELECT house_id, month, phase, max(len(taken)) AS n FROM cw GROUP BY ALL),
cy AS (SELECT c.house_id, c.month, c.phase, CASE WHEN count(watts) >= 30 THEN max(c.n) END AS cycles, count(watts) AS n FROM cc c JOIN s ON s.house_id = c.house_id AND s.month = c.month AND s.phase = c.phase GROUP BY ALL)"""


@query("WITH RECURSIVE" + QUALITY_SQL.removeprefix("WITH") + ", " + CYCLES_SQL + f""",
cd AS (SELECT house_id, avg(d) AS density FROM (SELECT house_id, phase, sum(cycles) / (sum(n) / 10000) AS d FROM cy GROUP BY house_id, phase) GROUP BY house_id),
f AS (SELECT house_id, coalesce(avg(sharp_rate), 0) AS sharp_rate, coalesce(avg(sustained), 0) AS sustained, coalesce(avg(mid_share), 0) AS mid_share, coalesce(avg(low_share), 0) AS low_share, coalesce(avg(high_share), 0) AS high_share,
  sum(coalesce(n_negative, 0)) AS n_negative, sum(coalesce(n_extreme, 0)) AS n_extreme, count(*) FILTER (WHERE dead) AS n_dead, count(*) FILTER (WHERE faulty) AS n_faulty, avg(missing_share) AS missing, max(missing_share) AS most_missing, count(sharp_rate) AS n_crossing FROM ph GROUP BY house_id),
mi AS (SELECT house_id, ts, sum(watts) AS total FROM s GROUP BY house_id, ts),
hg AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY house_id ORDER BY ts))) // 1000000 / 60 AS gap FROM mi),
hm AS (SELECT house_id, CAST(date_diff('day', min(ts), max(ts)) AS DOUBLE) AS days, least(count(*) / ((epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) / 60 + 1), 1) AS coverage,
  avg(CASE WHEN gap > 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE gap IS NOT NULL) * 100 AS long_gaps, CASE WHEN avg(total) > 0 THEN stddev_samp(total) / avg(total) ELSE 0 END AS variation FROM hg GROUP BY house_id),
mo AS (SELECT house_id, date_trunc('month', ts) AS o, count(*) AS n, avg(total) AS mean FROM mi GROUP BY house_id, date_trunc('month', ts)),
mm AS (SELECT house_id, count(*) AS n_months, stddev_pop(least(n / (day(last_day(o)) * 1440), 1)) AS unevenness, count(*) FILTER (WHERE mean < 1 AND n > 100) AS n_dark FROM mo GROUP BY house_id),
al AS (SELECT f.*, hm.* EXCLUDE (house_id), mm.* EXCLUDE (house_id), (1 - coverage) * 100 + most_missing * 100 * coverage AS lost, missing * 100 AS pct, coalesce(density, 0) AS density FROM f LEFT JOIN cd ON cd.house_id = f.house_id JOIN hm ON hm.house_id = f.house_id JOIN mm ON mm.house_id = f.house_id),
pt AS (SELECT house_id, n_dead, n_faulty, lost,
  CASE WHEN n_crossing = 0 THEN 0 WHEN sharp_rate >= 0.5 - 1e-9 THEN 20 ELSE {_knots("sharp_rate", quality.SHARP_KNOTS)} END AS sharp_points, {_knots("sustained", quality.SUSTAINED_KNOTS)} + {_knots("density", quality.COMPRESSOR_KNOTS)} AS device_points,
  20 - greatest(least((mid_share - 0.10) / 0.25 * 15, 15), 0) - greatest(least((0.15 - low_share) / 0.15 * 5, 5), 0) AS profile_points, {_knots("variation", quality.VARIATION_KNOTS)} AS variation_points,
  least({_knots("days", quality.DAYS_KNOTS)} + CASE WHEN n_months > 1 THEN greatest(5 * (1 - 2 * unevenness), 0) ELSE 5 END, 15) AS volume_points,
  greatest(10 - greatest(least(4, pct - 1), 0) - greatest(least((coalesce(long_gaps, 0) - 5) / 10 * 3, 3), 0) - greatest(least((n_negative - 100) / 500 * 3, 3), 0) - greatest(least(n_extreme / 50 * 2, 2), 0) - greatest(least(n_dark / n_months * 10, 3), 0), 0) AS integrity_points,
  least(15 * n_dead, 30) + least(10 * n_faulty, 20) + CASE WHEN coverage < 0.5 THEN 15 WHEN coverage < 0.7 THEN 8 ELSE 0 END + CASE WHEN n_extreme > 0 THEN 5 ELSE 0 END + CASE WHEN high_share > 0.40 THEN 8 WHEN high_share > 0.25 THEN 4 ELSE 0 END
    + CASE WHEN lost >= 40 THEN 10 WHEN lost >= 15 THEN 5 ELSE 0 END AS penalty FROM al),
sc AS (SELECT *, greatest(sharp_points + device_points + profile_points + variation_points + volume_points + integrity_points - penalty, 0) AS score FROM pt)
SELECT house_id, round(sharp_points, 4) AS sharp_points, round(device_points, 4) AS device_points, round(profile_points, 4) AS profile_points, round(variation_points, 4) AS variation_points, round(volume_points, 4) AS volume_points,
  round(integrity_points, 4) AS integrity_points, CAST(penalty AS DOUBLE) AS penalty, round(score, 4) AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS tier,
  concat_ws(',', CASE WHEN sharp_points < 8 THEN 'low_sharp_entry' END, CASE WHEN device_points < 4 THEN 'low_device_signature' END, CASE WHEN profile_points < 10 THEN 'low_power_profile' END, CASE WHEN variation_points < 8 THEN 'low_variability' END,
    CASE WHEN volume_points < 7 THEN 'low_data_volume' END, CASE WHEN integrity_points < 5 THEN 'low_data_integrity' END) AS flags,
  CASE WHEN n_dead > 0 AND n_faulty > 0 THEN 'faulty_both' WHEN n_dead > 0 THEN 'faulty_dead_phase' WHEN n_faulty > 0 THEN 'faulty_high_nan' END AS label,
  CASE WHEN lost < 5 THEN 'continuous' WHEN lost < 15 THEN 'minor_gaps' WHEN lost < 40 THEN 'discontinuous' ELSE 'fragmented' END AS continuity FROM sc""")
def quality_scores(spark, sf_dir):
    series = phase_series(spark, sf_dir)
    return rounded(quality.scores(series, quality.compressors(series, least=30), least=30))


@query("WITH RECURSIVE " + PHASES_SQL + ", " + CYCLES_SQL + " SELECT house_id, month, phase, cycles, n FROM cy")
def compressor_cycles(spark, sf_dir):
    """Greedy pairs of rises and falls by house, month and phase."""
    return rounded(quality.compressors(phase_series(spark, sf_dir), least=30))


@query(f"""WITH {SERIES_SQL}, f AS (SELECT *, CASE WHEN abs(watts - lag(watts) OVER w) <= 500 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY house_id, phase ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f), r AS (SELECT house_id, phase, run, count(*) AS c FROM n GROUP BY ALL)
SELECT house_id, phase, CAST(sum(c) AS BIGINT) AS n, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) * 100, 4) AS flat_share FROM r GROUP BY house_id, phase""")
def flat_shares(spark, sf_dir):
    return rounded(reports.flat_share(power_series(spark, sf_dir), 500))


@query(f"""WITH {SERIES_SQL}, a AS (SELECT *, {EPOCH.format("ts")} AS a FROM s),
z AS (SELECT *, avg(watts) OVER w AS mean, stddev_samp(watts) OVER w AS dev FROM a WINDOW w AS (PARTITION BY house_id, phase ORDER BY a RANGE BETWEEN 431999 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, CASE WHEN dev > 0 THEN (watts - mean) / dev END AS z FROM z),
r AS (SELECT *, sum(CASE WHEN coalesce(abs(z) > 0.8, false) THEN 0 ELSE 1 END) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM y)
SELECT house_id, phase, count(*) AS n_rows, {EPOCH.format("min(ts)")} AS "start", {EPOCH.format("max(ts)")} AS "end", round(max(abs(z)), 4) AS max_z FROM r WHERE abs(z) > 0.8 GROUP BY house_id, phase, run HAVING count(*) >= 3""")
def anomalous_runs(spark, sf_dir):
    return rounded(reports.anomalous_runs(power_series(spark, sf_dir), 432_000, 0.8, 3).withColumns({"start": SEC("start"), "end": SEC("end")}))


@query(f"""WITH {SERIES_SQL}, d AS (SELECT CAST(min(ts) AS DATE) + 1 AS day FROM s)
SELECT event_id, 'day' AS half FROM s, d WHERE ts BETWEEN day + INTERVAL 6 HOUR AND day + INTERVAL 18 HOUR UNION ALL SELECT event_id, 'night' FROM s, d WHERE ts BETWEEN day + INTERVAL 18 HOUR AND day + INTERVAL 30 HOUR""")
def half_day_readings(spark, sf_dir):
    rows = power_series(spark, sf_dir)
    day = str(rows.agg(F.date_add(F.to_date(F.min("ts")), 1)).first()[0])
    half = lambda kind: reports.in_window(rows, "ts", day, kind).select("event_id", F.lit(kind).alias("half"))
    return half("day").unionByName(half("night"))


RUNS_SQL = f"""WITH u AS (SELECT user_id AS house_id, event_id AS id, event_type, {EPOCH.format("ts")} AS s, {EPOCH.format("ts")} + (event_id % 40 + 1) * 60 AS e, value * 10 AS watts FROM events)"""


def runs(spark, sf_dir) -> DataFrame:
    start = SEC("ts")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("house_id"), F.lit("w1").alias("phase"), F.col("event_id").alias("id"), "event_type", start.alias("start"), (start + (F.col("event_id") % 40 + 1) * 60).alias("end"), (F.col("value") * 10).alias("watts"))


@query(RUNS_SQL + """ SELECT a.id, count(*) AS n_points, count(*) FILTER (WHERE b.s BETWEEN a.s AND a.e) AS n_inside, min(b.s) AS first_at, max(b.s) AS last_at, CAST(sum(CAST(floor(b.watts + 0.5) AS BIGINT)) AS BIGINT) AS watts
  FROM u a JOIN u b ON a.house_id = b.house_id AND b.s BETWEEN a.s - 7200 AND a.e + 7200 WHERE a.event_type = 'purchase' GROUP BY a.id""")
def chart_windows(spark, sf_dir):
    all_ = runs(spark, sf_dir)
    found = reports.around(all_.where("event_type = 'purchase'"), all_.select("house_id", "phase", F.col("start").alias("at"), "watts"), 7200)
    watts = F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p["watts"])
    return found.select("id", F.size("points").cast("long").alias("n_points"), F.size(F.filter("points", lambda p: p["kind"] == "ses")).cast("long").alias("n_inside"), F.col("points")[0]["at"].alias("first_at"), F.element_at("points", -1)["at"].alias("last_at"), watts.alias("watts"))


@query(RUNS_SQL + """ SELECT house_id, k * 43200 + 21600 AS segment, count(*) AS n_runs, round(sum(watts), 4) AS watts FROM (SELECT *, unnest(range(CAST(floor((s - 21600) / 43200.0) AS BIGINT), CAST(floor((e - 21600) / 43200.0) AS BIGINT) + 1)) AS k FROM u) GROUP BY house_id, k""")
def session_segments(spark, sf_dir):
    return rounded(reports.segments_of(runs(spark, sf_dir)).groupBy("house_id", "segment").agg(F.count("*").alias("n_runs"), F.sum("watts").alias("watts")))


WAVES_SQL = f"""WITH {SERIES_SQL}, i AS (SELECT *, coalesce(watts BETWEEN 200 AND 4000, false) AS inside FROM s), q AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY house_id, phase ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM i),
r AS (SELECT *, count(*) OVER p AS n, min(ts) OVER p AS st, row_number() OVER (PARTITION BY house_id, phase, run ORDER BY ts, event_id) AS i FROM q WHERE inside WINDOW p AS (PARTITION BY house_id, phase, run)),
d AS (SELECT *, watts - lag(watts) OVER (PARTITION BY house_id, phase, run ORDER BY ts, event_id) AS d FROM r WHERE n BETWEEN 8 AND 180),
c AS (SELECT a.house_id, a.phase, a.run, a.st, a.n, k.lag, corr(a.d, b.d) AS peak, count(b.d) AS pairs FROM d a CROSS JOIN (SELECT CAST(range AS BIGINT) AS lag FROM range(2, 5)) k JOIN d b ON a.house_id = b.house_id AND a.phase = b.phase AND a.run = b.run AND b.i = a.i - k.lag GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY house_id, phase, run ORDER BY peak DESC, lag) AS nth FROM c WHERE pairs >= 3 AND peak IS NOT NULL AND NOT isnan(peak)) WHERE nth = 1)"""


def _waves(spark, sf_dir) -> DataFrame:
    return reports.wave_windows(power_series(spark, sf_dir), 200, 4000, 8, 180, range(2, 5))


@query(WAVES_SQL + f""" SELECT house_id, phase, {EPOCH.format("st")} AS "start", n, round(peak, 4) AS peak FROM w""")
def wave_windows(spark, sf_dir):
    return rounded(_waves(spark, sf_dir).withColumn("start", SEC("start")).drop("lag"))


@query(WAVES_SQL + """ SELECT house_id, phase, count(*) AS n_windows, round(sum(greatest(peak, 0) * n) / sum(n), 4) AS score, CASE WHEN sum(CASE WHEN month(st) BETWEEN 5 AND 10 THEN n ELSE 0 END) * 2 >= sum(n) THEN 'warm' ELSE 'cool' END AS season FROM w GROUP BY house_id, phase""")
def wave_scores(spark, sf_dir):
    return rounded(reports.wave_score(_waves(spark, sf_dir)))


# ---------------------------------------------------------------- evaluation and reports


@query(f"""WITH {SERIES_SQL}, b AS (SELECT house_id, phase, {EPOCH.format("ts")} // 3600 AS slot, min_by(watts, event_id) AS base, min_by(watts, event_id) FILTER (WHERE event_id % 3 <> 0) AS now FROM s GROUP BY ALL),
p AS (SELECT house_id, phase, {EPOCH.format("ts")} // 3600 AS slot, min_by(watts, event_id) FILTER (WHERE event_id % 2 = 0) AS prev FROM s GROUP BY ALL),
j AS (SELECT b.phase, base, now * 0.7 - 20 AS now, prev * 0.9 AS prev FROM b LEFT JOIN p ON p.house_id = b.house_id AND p.phase = b.phase AND p.slot = b.slot)
SELECT phase, count(*) AS minutes, count(*) FILTER (WHERE base > 1300) AS minutes_over, round(coalesce(sum(base - now) FILTER (WHERE base > 1300), 0), 4) AS explained, round(coalesce(sum(prev - now) FILTER (WHERE base > 1300), 0), 4) AS explained_now,
  count(*) FILTER (WHERE now < 0) AS n_negative, count(*) FILTER (WHERE now IS NULL) AS n_missing FROM j GROUP BY phase""")
def run_evaluation(spark, sf_dir):
    rows = power_series(spark, sf_dir).select("house_id", "phase", F.floor(SEC("ts") / 3600).alias("slot"), F.col("event_id").alias("id"), "watts")
    now = rows.where("id % 3 <> 0").withColumn("watts", F.col("watts") * 0.7 - 20)
    before = rows.where("id % 2 = 0").withColumn("watts", F.col("watts") * 0.9)
    return rounded(reports.evaluation(rows, now, before, ["house_id", "slot"], 1300))


@query(f"""WITH {SERIES_SQL}, o AS (SELECT house_id, phase, {EPOCH.format("ts")} // 3600 AS slot, min_by(watts, event_id) AS original FROM s GROUP BY ALL), r AS (SELECT house_id, phase, {EPOCH.format("ts")} // 3600 AS slot, max_by(watts, event_id) * 0.5 AS remaining FROM s WHERE event_id % 5 <> 0 GROUP BY ALL),
j AS (SELECT o.phase, greatest(original, 0) AS o, greatest(remaining, 0) AS r FROM o JOIN r ON r.house_id = o.house_id AND r.phase = o.phase AND r.slot = o.slot), b AS (SELECT phase, quantile_cont(o, 0.05) AS p5 FROM j GROUP BY phase),
e AS (SELECT j.*, p5, greatest(r - p5, 0) AS above FROM j JOIN b ON b.phase = j.phase)
SELECT phase, count(*) AS n, round(sum(greatest(o - r, 0)) / sum(o) * 100, 4) AS explained_share, round(sum(r) FILTER (WHERE r <= 200) / 60000, 4) AS noise_kwh, round(sum(r) FILTER (WHERE r > 200 AND r <= 800) / 60000, 4) AS small_kwh, round(sum(r) FILTER (WHERE r > 800) / 60000, 4) AS large_kwh,
  round(coalesce(sum(above) FILTER (WHERE above > 800), 0), 4) AS over FROM e GROUP BY phase""")
def remaining_classes(spark, sf_dir):
    """Inner join of the first run's original with the last run's remaining signal, and what is left by size."""
    slots = power_series(spark, sf_dir).select("house_id", "phase", F.floor(SEC("ts") / 3600).alias("slot"), "event_id", "watts")
    keys = ["house_id", "phase", "slot"]
    original = slots.groupBy(*keys).agg(F.min_by("watts", "event_id").alias("original"))
    rest = slots.where("event_id % 5 <> 0").groupBy(*keys).agg((F.max_by("watts", "event_id") * 0.5).alias("remaining"))
    joined = original.join(rest, keys)
    found = profile.decomposition(joined, ("phase",), 800).select("phase", "n", (F.col("explained") / F.col("original") * 100).alias("explained_share"), "over")
    r = F.greatest(F.col("remaining"), F.lit(0.0))
    kwh = lambda c: F.sum(F.when(c, r)) / 60_000
    return rounded(found.join(joined.groupBy("phase").agg(kwh(r <= 200).alias("noise_kwh"), kwh((r > 200) & (r <= 800)).alias("small_kwh"), kwh(r > 800).alias("large_kwh")), "phase"))


@query(f"""WITH {SERIES_SQL}, h AS (SELECT house_id, month, avg(CASE WHEN watts >= 1500 THEN 1.0 ELSE 0.0 END) AS rate FROM s GROUP BY ALL)
SELECT month, count(*) AS n_houses, round(avg(rate), 4) AS mean, round(min(rate), 4) AS least, round(max(rate), 4) AS most, round(stddev_pop(rate), 4) AS spread, count(*) FILTER (WHERE rate < 0.4) AS n_problem, count(*) FILTER (WHERE rate >= 0.6) AS n_good,
  coalesce(string_agg(CAST(house_id AS VARCHAR), ',' ORDER BY house_id) FILTER (WHERE rate < 0.4), '') AS problem_houses FROM h GROUP BY month""")
def month_rates(spark, sf_dir):
    return rounded(reports.month_rates(power_series(spark, sf_dir).select("house_id", "month", (F.col("watts") >= 1500).alias("matched"))))


@query(f"""WITH {SERIES_SQL}, t AS (SELECT *, house_id // 3 AS h, row_number() OVER (PARTITION BY house_id // 3 ORDER BY ts, event_id) AS i FROM s),
g AS (SELECT h, phase, sum(watts) AS power, avg(CASE WHEN watts >= 1000 THEN 1.0 ELSE 0.0 END) AS share FROM t GROUP BY ALL), d AS (SELECT *, power < 0.01 * max(power) OVER (PARTITION BY h) AS damaged FROM g),
p AS (SELECT h, count(*) FILTER (WHERE damaged) AS n_damaged, sum(CASE WHEN damaged THEN 0 ELSE share END) / 3 AS share FROM d GROUP BY h),
r AS (SELECT h, avg(CASE WHEN watts >= 500 THEN 1.0 ELSE 0.0 END) AS first_rate, avg(CASE WHEN watts >= 800 THEN 1.0 ELSE 0.0 END) - 0.1 AS change, count(*) FILTER (WHERE watts < 50) AS n_negative FROM t GROUP BY h),
s2 AS (SELECT p.h AS house_id, n_damaged, CASE WHEN change > 0 THEN least(100, first_rate * 100 + change * 50) ELSE first_rate * 100 END AS matching, greatest(p.share * 100 - least(20, n_negative * 0.5), 0) AS segmentation FROM p JOIN r ON r.h = p.h),
s3 AS (SELECT *, 0.7 * matching + 0.3 * segmentation AS score FROM s2), s4 AS (SELECT *, CASE WHEN n_damaged >= 2 THEN 'DAMAGED' WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD' WHEN score >= 40 THEN 'FAIR' ELSE 'POOR' END AS category FROM s3)
SELECT house_id, n_damaged, round(matching, 4) AS matching, round(segmentation, 4) AS segmentation, round(score, 4) AS score, category, CAST(list_position(['EXCELLENT', 'GOOD', 'FAIR', 'POOR', 'DAMAGED'], category) AS BIGINT) AS place FROM s4""")
def house_grades(spark, sf_dir):
    rows = phase_series(spark, sf_dir, holes=False)
    share = lambda n: F.avg((F.col("watts") >= n).cast("double"))
    seg = rows.groupBy("house_id", "phase").agg(F.sum("watts").alias("power"), share(1000).alias("share"))
    rates = rows.groupBy("house_id").agg(share(500).alias("first_rate"), (share(800) - 0.1).alias("change"), F.count_if(F.col("watts") < 50).alias("n_negative"))
    return rounded(reports.grades(seg, rates))


EVENTS_SQL = SERIES_SQL.replace("event_type, value", "event_type, CAST(hour(ts) AS BIGINT) AS hour, value")


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT phase, hour, count(*) AS c FROM s GROUP BY ALL), k AS (SELECT phase, max_by(hour, c * 100 - hour) AS peak FROM p GROUP BY phase)
SELECT s.phase, count(*) AS n, round(avg(watts), 4) AS mean, round(quantile_cont(watts, 0.5), 4) AS median, round(stddev_samp(watts), 4) AS spread, round(quantile_cont(watts, 0.25), 4) AS q1, round(quantile_cont(watts, 0.75), 4) AS q3, round(quantile_cont(watts, 0.90), 4) AS p90, round(quantile_cont(watts, 0.99), 4) AS p99,
  count(*) FILTER (WHERE watts < 1000) AS n_small, count(*) FILTER (WHERE watts >= 1000 AND watts < 2000) AS n_medium, count(*) FILTER (WHERE watts >= 2000) AS n_large, any_value(peak) AS peak_hour FROM s JOIN k ON k.phase = s.phase GROUP BY s.phase""")
def event_metrics(spark, sf_dir):
    rows = power_series(spark, sf_dir).withColumn("hour", F.hour("ts"))
    hours = rows.groupBy("phase", "hour").agg(F.count("*").alias("c")).groupBy("phase").agg(F.max_by("hour", F.col("c") * 100 - F.col("hour")).alias("peak_hour"))
    q = lambda p: F.percentile("watts", F.lit(p))
    found = rows.groupBy("phase").agg(
        F.count("*").alias("n"), F.avg("watts").alias("mean"), q(0.5).alias("median"), F.stddev_samp("watts").alias("spread"), q(0.25).alias("q1"), q(0.75).alias("q3"), q(0.90).alias("p90"), q(0.99).alias("p99"),
        F.count_if(F.col("watts") < 1000).alias("n_small"), F.count_if((F.col("watts") >= 1000) & (F.col("watts") < 2000)).alias("n_medium"), F.count_if(F.col("watts") >= 2000).alias("n_large"),
    )
    return rounded(found.join(hours, "phase"))


@query(RUNS_SQL + """, t AS (SELECT event_type, CASE WHEN (e - s) // 60 <= 2 THEN 'short' WHEN (e - s) // 60 < 25 THEN 'medium' ELSE 'long' END AS bucket, watts, (e - s) / 60.0 AS minutes FROM u)
SELECT event_type AS device_type, count(*) AS n, round(avg(watts), 4) AS avg_watts, round(sum(watts * minutes) / 60000, 4) AS kwh, round(sum(watts * minutes) / sum(sum(watts * minutes)) OVER (), 4) AS share,
  round(coalesce(sum(watts) FILTER (WHERE bucket = 'short'), 0), 4) AS short, round(coalesce(sum(watts) FILTER (WHERE bucket = 'medium'), 0), 4) AS medium, round(coalesce(sum(watts) FILTER (WHERE bucket = 'long'), 0), 4) AS long FROM t GROUP BY event_type""")
def device_breakdown(spark, sf_dir):
    """Energy by device type, its share of all, and power by duration (pivoted)."""
    minutes = (F.col("end") - F.col("start")) / 60
    rows = runs(spark, sf_dir).withColumns({"energy": F.col("watts") * minutes, "bucket": reports.duration_bucket(minutes)})
    found = rows.groupBy(F.col("event_type").alias("device_type")).agg(F.count("*").alias("n"), F.avg("watts").alias("avg_watts"), (F.sum("energy") / 60_000).alias("kwh"))
    found = found.withColumn("share", F.col("kwh") / F.sum("kwh").over(W.partitionBy()))  # a row per device type
    buckets = rows.groupBy(F.col("event_type").alias("device_type")).pivot("bucket", ["short", "medium", "long"]).agg(F.sum("watts")).na.fill(0.0)
    return rounded(found.join(buckets, "device_type"))


@query(f"""WITH {SERIES_SQL}, d AS (SELECT month, phase, event_id % 7 AS part, watts AS o, greatest(watts - 900, 0) AS r, CASE WHEN event_id % 40 < 2 THEN least(watts, 900) ELSE 0 END AS short, CASE WHEN event_id % 40 BETWEEN 2 AND 23 THEN least(watts, 900) ELSE 0 END AS medium, CASE WHEN event_id % 40 > 23 THEN least(watts, 900) ELSE 0 END AS long FROM s)
SELECT month, phase, count(*) AS minutes, round(sum(o), 4) AS total_power, round(sum(o - r) / sum(o), 4) AS segmentation_ratio, round(sum(short) / sum(o), 4) AS short_ratio, round(sum(medium) / sum(o), 4) AS medium_ratio, round(sum(long) / sum(o), 4) AS long_ratio, count(*) FILTER (WHERE r < 0) AS n_negative FROM d GROUP BY month, phase""")
def segmentation_metrics(spark, sf_dir):
    """Power before and after a run by month and phase, and the shares taken out by short, medium and long
    pairs; sums are partial by file and then final, as Spark adds up anyway."""
    rows = power_series(spark, sf_dir)
    gone, turn = F.least("watts", F.lit(900.0)), F.col("event_id") % 40
    rows = rows.withColumns({"r": F.greatest(F.col("watts") - 900, F.lit(0.0)), "bucket": reports.duration_bucket(turn + 1), "gone": gone})
    share = lambda b: (F.sum(F.when(F.col("bucket") == b, F.col("gone")).otherwise(0.0)) / F.sum("watts")).alias(f"{b}_ratio")
    return rounded(rows.groupBy("month", "phase").agg(F.count("*").alias("minutes"), F.sum("watts").alias("total_power"), (F.sum(F.col("watts") - F.col("r")) / F.sum("watts")).alias("segmentation_ratio"), share("short"), share("medium"), share("long"), F.count_if(F.col("r") < 0).alias("n_negative")))


# ---------------------------------------------------------------- stored tables


@query(f"""WITH {SERIES_SQL} SELECT house_id // 3 AS house_id, {EPOCH.format("ts")} // 3600 AS m, round(max(watts) FILTER (WHERE phase = 'w1') / 2, 4) AS w1, round(max(watts) FILTER (WHERE phase = 'w2') / 2, 4) AS w2, round(max(watts) FILTER (WHERE phase = 'w3') / 2, 4) AS w3 FROM s GROUP BY ALL""")
def raw_again(spark, sf_dir):
    """A run's summarised table as the raw readings of the next run."""
    rows = phase_series(spark, sf_dir, holes=False).withColumn("m", F.floor(SEC("ts") / 3600))
    wide = rows.groupBy("house_id", "m").pivot("phase", ["w1", "w2", "w3"]).agg(F.max("watts"))
    done = wide.select("house_id", "m", *[F.col(p).alias(f"original_{p}") for p in ("w1", "w2", "w3")], *[(F.col(p) / 2).alias(f"remaining_{p}") for p in ("w1", "w2", "w3")])
    return rounded(as_raw(done))


@query("""WITH n AS (SELECT DISTINCT user_id || '_' || strftime(ts, '%m_%Y') || CASE WHEN user_id % 11 = 0 THEN '.tmp.x1' ELSE '.pkl' END AS name, user_id AS h, CAST(month(ts) AS BIGINT) AS month, CAST(year(ts) AS BIGINT) AS year FROM events)
SELECT CAST(h AS VARCHAR) AS house, year, month, CAST(row_number() OVER (PARTITION BY h ORDER BY year, month) AS BIGINT) AS place FROM n WHERE h % 11 <> 0""")
def month_files(spark, sf_dir):
    """Files of months by their names, in order of time, not of name; other names are none."""
    e = read(spark, sf_dir, "events")
    ending = F.when(F.col("user_id") % 11 == 0, ".tmp.x1").otherwise(".pkl")
    names = e.select(F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "MM_yyyy"), ending).alias("name")).distinct()
    found = names.select(*[c.alias(n) for n, c in reports.month_of_name(F.col("name")).items()]).where("house is not null")
    return rounded(found.withColumn("place", F.row_number().over(W.partitionBy("house").orderBy("year", "month"))))


@query("""WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, min_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL),
n AS (SELECT o_custkey, day, price * 0.5 AS price FROM o WHERE o_custkey % 4 = 0) SELECT o.o_custkey, CAST(o.day AS VARCHAR) AS day, round(coalesce(n.price, o.price), 4) AS price FROM o LEFT JOIN n ON n.o_custkey = o.o_custkey AND n.day = o.day WHERE o.o_custkey % 9 <> 0""")
def updated_remaining(spark, sf_dir):
    """First rows per key; values replaced where a newer table has them; rows of deleted ids gone."""
    stored = read(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.min_by("o_totalprice", "o_orderkey").alias("price"))
    fresh = stored.where("o_custkey % 4 = 0").withColumn("price", F.col("price") * 0.5)
    gone = stored.where("o_custkey % 9 = 0").select("o_custkey").distinct()
    found = reports.updated(stored, fresh, ["o_custkey", "day"], "price").join(gone, "o_custkey", "left_anti")
    return rounded(found.select("o_custkey", F.col("day").cast("string").alias("day"), "price"))


@query("""SELECT CAST(user_id AS BIGINT) AS house_id, CASE WHEN count(*) >= 60 THEN 'updated' WHEN count(*) >= 50 THEN 'partial' ELSE 'failed' END AS status, count(*) AS n_rows, CAST(min(ts) AS DATE)::VARCHAR AS first_day, CAST(max(ts) AS DATE)::VARCHAR AS last_day FROM events GROUP BY user_id""")
def house_catalogue(spark, sf_dir):
    """What is stored of each house: range of dates, rows, and how its last update went."""
    n = F.count("*")
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("house_id")).agg(F.when(n >= 60, "updated").when(n >= 50, "partial").otherwise("failed").alias("status"), n.alias("n_rows"), F.to_date(F.min("ts")).cast("string").alias("first_day"), F.to_date(F.max("ts")).cast("string").alias("last_day"))


@query("""SELECT user_id AS house_id, count(*) AS coverage_n, round(avg(value), 4) AS power_mean, round(max(value), 4) AS power_peak_watts, min(event_id) AS power_peak_first FROM events GROUP BY user_id""")
def flattened_reports(spark, sf_dir):
    """Nested reports, one column per leaf."""
    nested = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("house_id")).agg(F.struct(F.count("*").alias("n")).alias("coverage"), F.struct(F.avg("value").alias("mean"), F.struct(F.max("value").alias("watts"), F.min("event_id").alias("first")).alias("peak")).alias("power"))
    return rounded(reports.flattened(nested))


@query("""WITH j AS (SELECT user_id AS house_id, CASE WHEN user_id % 5 = 0 THEN 'faulty_dead_phase' END AS label, avg(value) AS score FROM events GROUP BY user_id)
SELECT house_id, coalesce(label, CAST(CAST(floor(score) AS BIGINT) AS VARCHAR)) AS pre_analysis, CASE WHEN label IS NULL THEN 'score' ELSE 'label' END AS kind FROM j""")
def pre_analysis(spark, sf_dir):
    """Label of a faulty house or else its score, read from JSON reports."""
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("house_id")).agg(F.floor(ordered_sum(F.col("value"), "event_id") / F.count("value")).alias("score"))
    body = F.to_json(F.struct(F.struct(F.when(F.col("house_id") % 5 == 0, "faulty_dead_phase").alias("quality_label"), F.col("score").alias("quality_score")).alias("data_quality")))
    parsed = e.select("house_id", F.from_json(body, "data_quality struct<quality_label: string, quality_score: bigint>").alias("r"))
    label = F.col("r.data_quality.quality_label")
    return parsed.select("house_id", F.coalesce(label, F.col("r.data_quality.quality_score").cast("string")).alias("pre_analysis"), F.when(label.isNull(), "score").otherwise("label").alias("kind"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(value * 10 AS DOUBLE) AS watts, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS BIGINT) AS iteration FROM events)
SELECT event_id, iteration, CAST(CASE iteration WHEN 0 THEN 2000 WHEN 1 THEN 1500 WHEN 2 THEN 1100 ELSE 0 END AS BIGINT) AS threshold, CASE WHEN iteration = 0 THEN round(watts, 4) END AS original FROM e WHERE iteration >= 0 OR event_type = 'signup'""")
def all_runs_matches(spark, sf_dir):
    """Every run's matches as one table, columns that a run lacks null, tagged by iteration and threshold."""
    e = read(spark, sf_dir, "events")
    one = lambda kind, n, t: e.where(F.col("event_type") == kind).select("event_id", F.lit(n).cast("long").alias("iteration"), F.lit(t).cast("long").alias("threshold"), *([(F.col("value") * 10).alias("original")] if n == 0 else []))
    found = one("click", 0, 2000)
    for kind, n, t in (("view", 1, 1500), ("purchase", 2, 1100), ("signup", -1, 0)):
        found = found.unionByName(one(kind, n, t), allowMissingColumns=True)
    return rounded(found)


@query("""WITH p AS (SELECT user_id, CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2) SELECT user_id, bucket, n FROM p ORDER BY n DESC, user_id, bucket LIMIT 20""")
def top_patterns(spark, sf_dir):
    """The twenty patterns that occur most."""
    found = read(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("value") / 10).alias("bucket")).agg(F.count("*").alias("n")).where("n >= 2")
    return found.orderBy(F.desc("n"), "user_id", "bucket").limit(20)

"""Incremental ingest: ranges to fetch, responses, upserts, token lists, and match logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.profile import medians
from gridloom.sources.work import staged

RESPONSE = "sums struct<`1`: map<string, string>, `2`: map<string, string>, `3`: map<string, string>>"


def fetch_ranges(latest: DataFrame, until: str, days: int = 7) -> DataFrame:
    """Half-open ranges of at most ``days`` days from each house's last reading (ts) to ``until``."""
    end = F.to_timestamp(F.lit(until))
    step = F.expr(f"interval {days} days")
    starts = latest.where(F.col("ts") < end).withColumn("from", F.explode(F.sequence("ts", end, step))).where(F.col("from") < end)
    return starts.select("house_id", "from", F.least(F.col("from") + step, end).alias("to"))


def parse_responses(raw: DataFrame) -> DataFrame:
    """(house_id, body JSON) -> minutes (house_id, ts, w1, w2, w3): phases joined by their epoch
    milliseconds; ``undef`` and non-numbers are NULL. A body that is no such JSON gives no rows."""
    body = raw.select("house_id", F.from_json("body", RESPONSE).alias("r"))
    parts = [body.select("house_id", F.lit(f"w{n}").alias("phase"), F.explode(F.col(f"r.sums.`{n}`")).alias("ms", "v")) for n in (1, 2, 3)]
    long = parts[0].unionAll(parts[1]).unionAll(parts[2])
    value = F.expr("try_cast(v AS double)")
    return long.groupBy("house_id", F.timestamp_millis(F.col("ms").cast("long")).alias("ts")).pivot("phase", ["w1", "w2", "w3"]).agg(F.first(value))


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """All rows once per key; stored rows win over fresh ones, and the first by ``tie`` among equals."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("_new", *tie)
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def clean_token(c: Column) -> Column:
    """Trimmed, without leading quotes or equal signs; blank and ``nan`` are NULL."""
    bare = F.regexp_replace(F.trim(c), "^['=]+", "")
    return F.when(~F.lower(bare).isin("", "nan"), bare)


def tokens(spark: SparkSession, primary: str, backup: str | None = None) -> DataFrame:
    """CSV ID,Token -> (house_id, token); a different backup token overrides."""
    load = lambda path: spark.read.csv(path, header=True).select(F.trim("ID").alias("house_id"), clean_token(F.col("Token")).alias("token")).where("token is not null")
    found = load(primary)
    if backup is None:
        return found
    return found.join(load(backup).withColumnRenamed("token", "other"), "house_id", "left").select("house_id", F.coalesce("other", "token").alias("token"))


def parse_match_log(lines: DataFrame, bins: int = 10_000) -> DataFrame:
    """Text lines (value) -> (reason, n, n_values, avg_value, p50, p90) over REJECTED, CORRECTABLE and Matched
    lines, from the first key=number of every line. Percentiles are to one part in ``bins``; no line is
    left out, and no reason's lines meet in one task."""
    rows = log_values(lines)
    share = lambda p: F.percentile_approx("number", p, bins)
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.count("number").alias("n_values"), F.avg("number").alias("avg_value"), share(0.5).alias("p50"), share(0.9).alias("p90"))


#: Parts into which a sample's random order is cut; only one part of a group is ever ranked.
ORDER_PARTS = 4096


def bottom_sample(rows: DataFrame, by: list[str], most: int = 100_000, seed: int = 0) -> DataFrame:
    """A uniform sample without replacement of ``most`` rows of every group, or the whole group if it has no more.

    Every row gets a place in a random order by hash; a group's sample is its first ``most`` places, so samples of
    parts of a group merge to one of the whole. Counts by part of the order tell, for every part, whether it is in as
    a whole, out, or the one where the sample ends; only that one is ranked. So no task holds a group, and a
    group of a third of all rows costs what others cost. Null groups are groups."""
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *[F.col(c) for c in rows.columns])
    dealt = rows.select(*rows.columns, place.alias("_place")).withColumn("_part", F.pmod("_place", F.lit(ORDER_PARTS)))
    dealt = staged(dealt)  # places depend on how rows lie in files: fixed from here on
    sizes = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).where(F.col("_before") < most)
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_of__part"), "_n", "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_part"]])
    near = dealt.join(sizes, same).select(*dealt.columns, "_n", "_before")
    whole = near.where(F.col("_before") + F.col("_n") <= most)
    nth = F.row_number().over(W.partitionBy(*by, "_part").orderBy("_place", *rows.columns))
    cut = near.where(F.col("_before") + F.col("_n") > most).withColumn("_nth", nth).where(F.col("_before") + F.col("_nth") <= most)
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))


def log_values(lines: DataFrame) -> DataFrame:
    """(reason, number): the first key=number of every REJECTED, CORRECTABLE and Matched line, null where it has none."""
    kind = F.regexp_extract("value", r"\b(REJECTED|CORRECTABLE|Matched)\b(?::?\s*([A-Za-z_]+))?", 1)
    reason = F.regexp_extract("value", r"\bREJECTED:?\s*([A-Za-z_]+)", 1)
    number = F.expr(r"try_cast(regexp_extract(value, '=\\s*(-?[0-9.]+)', 1) AS double)")
    return lines.select(F.when(reason != "", reason).otherwise(kind).alias("reason"), number.alias("number")).where("reason <> ''")


def sampled_log(lines: DataFrame, most: int | None = 100_000) -> DataFrame:
    """(reason, n_sampled, avg_value, least, most, p50) over a sample of at most ``most`` values a reason: exact up to that many.
    With None over all values."""
    values = log_values(lines).where("number is not null")
    sample = values if most is None else bottom_sample(values, ["reason"], most)
    middle = medians(sample, ["reason"], "number", "p50")
    return sample.groupBy("reason").agg(F.count("*").alias("n_sampled"), F.avg("number").alias("avg_value"), F.min("number").alias("least"), F.max("number").alias("most")).join(middle, "reason")


def numbers_of(lines: DataFrame) -> DataFrame:
    """(value, key, number): every ``key=number`` of text lines."""
    pairs = F.explode(F.expr(r"regexp_extract_all(value, '([A-Za-z_]+)=\\s*-?[0-9.]+', 0)"))
    found = lines.select("value", pairs.alias("pair"))
    return found.select("value", F.substring_index("pair", "=", 1).alias("key"), F.expr("try_cast(trim(substring_index(pair, '=', -1)) AS double)").alias("number"))


def negatives(wide: DataFrame, phases: list[str]) -> DataFrame:
    """Unpivots phases and keeps values under 0."""
    ids = [c for c in wide.columns if c not in phases]
    return wide.unpivot(ids, phases, "phase", "power").where("power < 0")


def write_months(series: DataFrame, path: str) -> None:
    """Parquet by house and month; a month written again replaces that month only."""
    series.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("house_id", "month").parquet(path)

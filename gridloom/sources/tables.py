"""Power series from stored readings.

The canonical form is long: (house_id, month, phase, ts, event_id, watts), one row per reading, in the
order of (ts, event_id). Missing watts are NULL; NaN becomes NULL at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ORDER = ("ts", "event_id")
SERIES = ("house_id", "phase")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_watts(c: str) -> F.Column:
    """NULL for NaN."""
    return F.when(~F.isnan(c), F.col(c))


def power_series(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    """Readings of ``events``: a user is a house, its phase is fixed, watts are ten times the value.

    With ``holes``, every seventh reading by id is missing."""
    watts = clean_watts("value") * 10
    if holes:
        watts = F.when(F.col("event_id") % 7 != 0, watts)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("house_id"),
        F.date_format("ts", "yyyy-MM").alias("month"),
        F.concat(F.lit("w"), (F.col("user_id") % 3 + 1).cast("string")).alias("phase"),
        "ts",
        "event_id",
        "event_type",
        watts.alias("watts"),
    )


#: The same series in DuckDB.
SERIES_SQL = """
s AS (SELECT user_id AS house_id, strftime(ts, '%Y-%m') AS month, 'w' || CAST(user_id % 3 + 1 AS VARCHAR) AS phase, ts, event_id, event_type, value * 10 AS watts FROM events)"""
HOLES_SQL = SERIES_SQL.replace("value * 10 AS watts", "CASE WHEN event_id % 7 <> 0 THEN value * 10 END AS watts")

def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(house_id, phase, m, ts, watts, month): the readings of ``events`` as they are, without gaps: a house's n-th reading
    is minute n of its series, and stands in its own month."""
    w = W.partitionBy("house_id").orderBy("ts", "event_id")
    rows = power_series(spark, sf_dir).withColumn("m", F.row_number().over(w) - 1)
    return rows.select("house_id", "phase", "m", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60).alias("ts"), "watts", "month")


GRID_SQL = SERIES_SQL + """,
g AS (SELECT house_id, phase, CAST(row_number() OVER (PARTITION BY house_id ORDER BY ts, event_id) - 1 AS INTEGER) AS m, watts FROM s)"""


def reading_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(house_id, month, phase, m, watts): the readings of ``events`` as they are, a minute each: the n-th
    reading of a house's month is minute n."""
    w = W.partitionBy("house_id", "month").orderBy("ts", "event_id")
    return power_series(spark, sf_dir).select("house_id", "month", "phase", (F.row_number().over(w) - 1).alias("m"), "watts")


READING_SQL = SERIES_SQL + """,
g AS (SELECT house_id, month, phase, CAST(row_number() OVER (PARTITION BY house_id, month ORDER BY ts, event_id) - 1 AS INTEGER) AS m, watts FROM s)"""


def as_raw(wide: DataFrame) -> DataFrame:
    """A wide table as raw readings: of a summarised one the remaining phases, under the phases' names, and
    nothing else of it; phases named 1 to 3 become w1 to w3; a ``sum`` goes. NaN becomes NULL."""
    phases = ("w1", "w2", "w3")
    if set(f"remaining_{p}" for p in phases) & set(wide.columns):
        keys = [c for c in wide.columns if c in ("house_id", "month", "ts", "m")]
        return wide.select(*keys, *[clean_watts(f"remaining_{p}").alias(p) for p in phases if f"remaining_{p}" in wide.columns])
    named = wide.withColumnsRenamed({str(n): f"w{n}" for n in (1, 2, 3)}).drop("sum")
    return named.withColumns({p: clean_watts(p) for p in phases if p in named.columns})


def by(*keys: str, order: tuple[str, ...] = ORDER) -> W:
    return W.partitionBy(*keys).orderBy(*order)


def ordered_sum(value: F.Column, *order: str) -> F.Column:
    """The sum of doubles added up in the given order, so that its last digits don't hang on how rows were dealt; nulls don't
    count, no value gives null. For groups of few rows: a group's values meet in one task."""
    held = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("_value")))))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x["_value"]))


def ordered_mean(value: F.Column, *order: str) -> F.Column:
    """The mean of doubles by their ordered_sum()."""
    return ordered_sum(value, *order) / F.count(value)

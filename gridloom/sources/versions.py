"""Tables in versions: a run writes a new version, none changes an old one, and readers ask for the latest as of a run.

A version is a folder ``version=<n>`` of a table's folder, so that one scan reads any of them, partitions pruned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, folder: str, version: int) -> DataFrame:
    """Writes a version and returns it as read back; an existing one is an error."""
    path = f"{folder}/version={version}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, folder: str) -> DataFrame | None:
    """All versions with their number in ``version``, or None where nothing was written."""
    try:
        return spark.read.option("basePath", folder).option("mergeSchema", True).parquet(f"{folder}/version=*")
    except AnalysisException:
        return None


def as_of(rows: DataFrame, version: int, unit: list[str], name: str = "version") -> DataFrame:
    """For every unit (a house's month, say) the rows of its latest version up to ``version``; a unit that a
    version lacks comes from the nearest one before that has it. Adds ``from_version``.

    One aggregate over the units and a join to it: rows never meet rows of another version."""
    known = rows.where(F.col(name) <= version)
    latest = known.groupBy(*unit).agg(F.max(name).alias(name))
    return known.join(latest, [*unit, name], "left_semi").withColumn("from_version", F.col(name)).drop(name)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (null-safe) are not in ``gone``."""
    gone = gone.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(gone, same, "left_anti")


def completed(summary: DataFrame, raw: DataFrame, earlier: DataFrame | None, run: int, unit: list[str], phases: tuple[str, ...] = ("w1", "w2", "w3")) -> DataFrame:
    """A run's summaries with every month that has data: ``summary`` has those in which something was taken out.

    A month of ``raw`` (unit, m, phases) that lacks one passes through: what remains is what was read, and nothing
    was taken out; minutes that no phase has read are left out. A month that ``raw`` lacks too comes from the latest
    of ``earlier`` runs (column ``run``) that has it. Adds ``origin``: run, passthrough or the earlier run's number."""
    done = summary.select(*unit).distinct()
    read = raw.where(reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in phases])).join(done, unit, "left_anti")
    buckets = ("short_duration", "medium_duration", "long_duration")
    passed = read.select(*unit, "m", *[F.col(p).alias(f"original_{p}") for p in phases], *[F.col(p).alias(f"remaining_{p}") for p in phases], *[F.lit(0.0).alias(f"{b}_{p}") for b in buckets for p in phases])
    out = summary.withColumn("origin", F.lit("run")).unionByName(passed.withColumn("origin", F.lit("passthrough")), allowMissingColumns=True)
    if earlier is None:
        return out
    missing = as_of(earlier, run - 1, unit, "run").join(out.select(*unit).distinct(), unit, "left_anti")
    return out.unionByName(missing.withColumn("origin", F.col("from_version").cast("string")).drop("from_version"), allowMissingColumns=True)

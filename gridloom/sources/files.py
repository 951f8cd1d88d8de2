"""Monthly files of houses: ``<root>/<house>/<house>_<MM>_<YYYY>.parquet``, or one file ``<root>/<house>.parquet``.

Spark lists and reads the files, in any store that it reads; only names are looked at here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: House, month and year of a file's name; summarised tables have a prefix that is not part of the house's.
NAME = r"([^/]+?)_(\d{2})_(\d{4})\.parquet$"
PREFIX = "summarized_"


def _parts(path: str) -> dict[str, Column]:
    house = F.regexp_replace(F.regexp_extract(path, NAME, 1), f"^{PREFIX}", "")
    month = F.concat(F.regexp_extract(path, NAME, 3), F.lit("-"), F.regexp_extract(path, NAME, 2))
    return {"house": house, "month": month}


def month_files(spark: SparkSession, root: str) -> DataFrame:
    """(house, month, path, length, place): every monthly file under ``root``; place counts a house's months from 1
    in order of time. Other files are none of them. Names only: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_[0-9][0-9]_[0-9][0-9][0-9][0-9].parquet").load(root)
    found = files.select(F.col("path"), "length").withColumns(_parts("path")).where("house <> ''")
    place = F.row_number().over(W.partitionBy("house").orderBy("month", "path"))
    return found.select("house", "month", "path", "length", place.alias("place"))


def _globs(root: str, houses: Iterable[str] | None, months: Iterable[str] | None) -> str:
    """A pattern that lists the wanted houses' folders and months only (months as yyyy-MM)."""
    choice = lambda xs: "{" + ",".join(sorted(xs)) + "}"
    folder = choice(houses) if houses is not None else "*"
    name = "*_" + choice(f"{m[5:7]}_{m[:4]}" for m in months) + ".parquet" if months is not None else "*_[0-9][0-9]_[0-9][0-9][0-9][0-9].parquet"
    return f"{root.rstrip('/')}/{folder}/{name}"


def read_months(spark: SparkSession, root: str, houses: Iterable[str] | None = None, months: Iterable[str] | None = None) -> DataFrame:
    """Rows of the wanted houses' monthly files with ``house`` and ``month`` from their names. Files of other houses and
    months are not even listed; columns that a file lacks are null. No file: an error of the scan."""
    rows = spark.read.option("mergeSchema", True).parquet(_globs(root, houses, months))
    return rows.select("*", F.col("_metadata.file_path").alias("_path")).withColumns(_parts("_path")).drop("_path")


def read_house(spark: SparkSession, root: str, house: str) -> DataFrame:
    """A house's readings in order of time, from its folder of months or else from its single file."""
    if not month_files(spark, root).where(F.col("house") == house).isEmpty():
        return read_months(spark, root, [house]).drop("house", "month").orderBy("ts")
    return spark.read.parquet(f"{root.rstrip('/')}/{house}.parquet").orderBy("ts")

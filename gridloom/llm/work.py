"""Work tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (tests) gets a temporary folder that is then
    kept in the session; on a cluster that would be a machine-local folder, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridloom.work.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-work-")
        spark.conf.set("gridloom.work.dir", root)
    return root.rstrip("/") if "://" in root else "file://" + root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    This cuts the lineage: an executor lost later costs a reread, never the work above.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns of any
    name can't clash: ``rows_of(df, doc_id="id", text="body")``."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, facts: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` (about ``total``) to ``facts``, unique in ``on``, where column ``n`` of
    ``facts`` is about the number of ``rows`` that have the key.

    Keys of a thousandth of all rows or more, of which there can be about a thousand, are broadcast; the
    rest is a shuffle join in which no key is large. ``n`` is dropped.
    """
    limit = max(1000, total // 1000)
    hot = F.broadcast(facts.where(F.col(n) >= limit).drop(n))
    cold = rows.join(F.broadcast(facts.where(F.col(n) >= limit).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(facts.where(F.col(n) < limit).drop(n), on))

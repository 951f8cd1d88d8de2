"""Intermediate results as tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the setting is absent, a local session (tests) gets a
    temporary folder, kept in the session; on a cluster that would be one machine's, so it is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridloom.stage.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-stage-")
        spark.conf.set("gridloom.stage.dir", root)
    return root.rstrip("/") if "://" in root else "file://" + root.rstrip("/")


#: Rows of numbers and names above which a stored table is no more sent whole to the driver and every executor.
FEW_ROWS = 50_000


def merged(minutes: DataFrame) -> DataFrame:
    """A row per minute, or readings around every minute, never broadcast: joins merge sorted rows. Where such a table comes
    from a join or a union, the hint of staged() no longer reaches it, and plans take lists for one element each."""
    return minutes.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back, without a word on how it is joined: for a table of many rows whose every
    join says so itself."""
    path = f"{work_root(df.sparkSession)}/gridloom/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage is cut, a lost executor costs a reread, and the
    plans behind see a table of known size.

    Plans take the files' size for the table's, but minutes and edges are many times larger in memory than in compressed
    files. So joins of a table of many rows, or of rows with arrays, merge sorted rows; none broadcasts it."""
    table = stored(df)
    few = 0 if any(kind.startswith("array") for _, kind in df.dtypes) else FEW_ROWS
    return table if few and table.count() <= few else table.hint("merge")

"""Where queries and the SQL that checks them are registered, and how both round alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Added before rounding, so that halves, which two engines may reach from either side, go up in both
#: (and 0.0 after it, for there is a negative zero).
NUDGE = 1e-7
EPOCH = "epoch_us({}) // 1000000"


def query(sql: str | None = None):
    """Registers a query under its function's name. In ``sql`` every ``round(x, 4)`` rounds as rounded()
    does; any other use of four places or of round() is an error, so that none changes unseen."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            if sql.count("round(") != sql.count(", 4)"):
                raise ValueError(f"{f.__name__}: every round() in its SQL must end in ', 4)' and nothing else may")
            ORACLE_SQL[f.__name__] = sql.replace(", 4)", f" + {NUDGE}, 4) + 0.0")
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(n) + NUDGE, 4) + 0.0).alias(n) if t == "double" else F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes])


def SEC(c):
    return F.unix_timestamp(c)

"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("customer", "orders", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False)
    plain = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(repr(tuple(map(plain, v))) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


#: Sessions of three alike cycles do not occur in the smallest table.
EMPTY = {"guided_cycles"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0 or name in EMPTY


def test_plans_push_filters_and_columns(spark):
    plan = catalogue.QUERIES["anti_asof"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type)" in plan and "props" not in plan.split("ReadSchema")[1]

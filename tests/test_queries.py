"""Every registered query against its SQL, on whole small tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from check import rows_of
from tidemark.plans.checked import ORACLES as SQL
from tidemark.plans.checked import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = rows_of(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


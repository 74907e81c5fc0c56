"""Every registered query against its SQL counterpart, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from ledgerline.session import steps

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cell(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def test_every_query_has_an_oracle():
    own = {n for n in driver.queries() if not n.startswith("op") and n != "pipeline"}
    assert own <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query(spark, duck, name):
    with steps(spark):
        df = driver.queries()[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(map(cell, row)) for row in df.select(*columns).collect())
    result = duck.execute(driver.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(cell(row[i]) for i in order) for row in result.fetchall())
    assert got == expected

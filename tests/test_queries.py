"""Every named query against its SQL on the small tables, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__
from lodestone import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(x):
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sql, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    got = sql.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

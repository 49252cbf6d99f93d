"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest
from given_tables import SMALL

import __spark_entry__ as entry
from check import TABLES, canonical

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    mine = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert len(mine) > 0
        return
    theirs = db.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every query with oracle SQL agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from graphloom.plans import catalog

from tables import DATA, TABLES

FOLDER = f"{DATA}/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: float(v) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(([columns[k] for k in order], [clean(r[k]) for k in order]).__repr__() for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine = [tuple(r) for r in got.collect()]
    theirs = want.fetchall()
    assert len(mine) == len(theirs)
    fix = lambda rows: [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in rows]
    assert rows_of(got.columns, mine) == rows_of(want.columns, fix(theirs))


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in catalog.QUERIES

"""Every registered query of the core runs; where it has SQL, both agree over the smallest tables."""

import os

import duckdb
import pytest

from conftest import DATA
from kinetra.plans import catalog

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def comparable(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            return str(x)
        return f"{float(x):.6f}"

    return sorted(tuple(one(row[i]) for i in order) for row in values)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    values = [tuple(r) for r in found.collect()]
    if name in catalog.sql():
        said = duck.sql(catalog.sql()[name])
        assert sorted(found.columns) == sorted(said.columns)
        assert comparable(found.columns, values) == comparable(said.columns, said.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

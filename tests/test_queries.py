"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from linewarden.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 17


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    frame = entry_points.queries()[name](spark, sf)
    sql = entry_points.oracle_sql()[name]
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = rows(columns, result.fetchall())
    assert expected and rows(frame.columns, frame.collect()) == expected

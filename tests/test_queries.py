"""Every registered query against its SQL, on the smallest tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.plans.oracles import ORACLES
from barloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def test_names_agree():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = sorted(frame.columns)
    assert sorted(names) == order
    want = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in order) for row in frame.collect()), key=repr)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 25

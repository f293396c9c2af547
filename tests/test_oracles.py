"""Every registered query against its SQL form on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.plans.queries import QUERIES as PLAIN

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OWN = set(PLAIN)
QUERIES = {key: run for key, run in entry.queries().items() if key in OWN}
ORACLES = {key: sql for key, sql in entry.oracle_sql().items() if key in OWN}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [
        tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows
    ]
    return sorted(columns), sorted(flat, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", list(QUERIES))
def test_same_result(spark, duck, key):
    ours = QUERIES[key](spark, SF)
    got = canonical(ours.columns, [tuple(r) for r in ours.collect()])
    result = duck.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert got == canonical(names, result.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: -r.times_mentioned)

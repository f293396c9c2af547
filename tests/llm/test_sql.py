"""Registered queries against their SQL forms on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(flat, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES) and set(ORACLES) <= set(entry.oracle_sql())
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("key", list(ORACLES))
def test_same_result(spark, duck, key):
    ours = QUERIES[key](spark, SF)
    got = canonical(ours.columns, [tuple(r) for r in ours.collect()])
    result = duck.execute(ORACLES[key])
    assert got == canonical([d[0] for d in result.description], result.fetchall())

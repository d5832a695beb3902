"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from shorefall.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(columns, found):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(tidy(r[i]) for i in by) for r in found), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    want = duck.sql(catalogue.oracle_sql()[name])
    assert got == rows(want.columns, want.fetchall())
    assert got[1]

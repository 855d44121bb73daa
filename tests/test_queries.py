"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from wayline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = comparable(got.columns, map(tuple, got.collect()))
    assert rows and rows == comparable(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0

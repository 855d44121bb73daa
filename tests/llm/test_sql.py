"""The queries of the training-data operators against their SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from wayline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: float(f"{v:.9g}") + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(*columns)
    rows = comparable(columns, map(tuple, got.collect()))
    assert rows and rows == comparable(columns, want.fetchall())

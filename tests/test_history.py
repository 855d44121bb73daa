"""Scans of stored history against plain filters, and the files they open."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.sources.history import history_files, scan_history, write_history

SCANS = [
    {"planes": ["p1", "p4"]},
    {"planes": []},
    {"start": 90_000.0, "end": 95_000.0},
    {"box": (-10.0, 20.0, 30.0, 60.0)},
    {"box": (-90.0, 170.0, 90.0, -170.0)},
    {"planes": ["p2"], "start": 10_000.0, "end": 40_000.0, "box": (0.0, 0.0, 40.0, 90.0)},
    {"start": 1e9},
    {},
]


def inside(r, planes=None, start=None, end=None, box=None):
    _, p, t, lat, lon = r
    ok = planes is None or p in planes
    ok &= start is None or (t is not None and t >= start)
    ok &= end is None or (t is not None and t <= end)
    if box is not None:
        s, w, n, e = box
        ok &= lat is not None and lon is not None and s <= lat <= n and (w <= lon <= e if w <= e else lon >= w or lon <= e)
    return ok


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(k, rng.choice(["p1", "p1", "p2", "p3", "p4", None]), rng.uniform(0, 3 * 86_400), rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(6_000)]
    rows += [(7_000, "p1", None, 1.0, 2.0), (7_001, "p2", 20_000.0, None, None), (7_002, "p2", 20_000.0, 10.0, 10.0), (7_003, "p2", 20_000.0, 500.0, 10.0)] * 2
    path = str(tmp_path_factory.mktemp("history") / "h")
    write_history(spark.createDataFrame(rows, "id long, icao24 string, state_time double, lat double, lon double"), path, files=64)
    return path, rows


@pytest.mark.parametrize("scan", SCANS, ids=str)
def test_scan_equals_filter(spark, stored, scan):
    path, rows = stored
    assert sorted(r["id"] for r in scan_history(spark, path, **scan).collect()) == sorted(r[0] for r in rows if inside(r, **scan))


def test_few_files_are_opened(spark, stored):
    path, _ = stored
    every = history_files(spark, path).count()
    assert every > 40
    assert history_files(spark, path, start=90_000.0, end=95_000.0).count() < every / 4
    box = history_files(spark, path, start=90_000.0, end=110_000.0, box=(-10.0, 20.0, 30.0, 60.0)).count()
    assert box < history_files(spark, path, start=90_000.0, end=110_000.0).count()  # some twenty files a day cut a box coarsely
    small = scan_history(spark, path, start=90_000.0, end=95_000.0)
    assert len(small.inputFiles()) == history_files(spark, path, start=90_000.0, end=95_000.0).count()


def test_empty_table_and_nan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", float("nan"), float("nan"), 0.0)], "id long, icao24 string, state_time double, lat double, lon double")
    write_history(rows, str(tmp_path / "a"), files=2)
    assert scan_history(spark, str(tmp_path / "a"), planes=["p"]).count() == 1
    write_history(rows.limit(0), str(tmp_path / "b"), files=2)
    assert scan_history(spark, str(tmp_path / "b"), start=0.0).count() == 0

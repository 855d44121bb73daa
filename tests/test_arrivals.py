"""The interval join and the points of arrivals, against nested loops."""

import numpy as np
from pyspark.sql import functions as F

from wayline.operators.arrivals import arrival_points, interval_join


def plain(points, arrivals, first, last):
    out = {}
    for call, plane, begin, end in arrivals:
        hits = [p for p in points if p[1] == plane and max(first, begin - 600) <= p[2] <= min(last, end + 240)]
        named = sum(p[0] == call for p in hits) >= 3
        for c, _, t, lat, lon, u in hits:
            if not named or c in (call, ""):
                k = (call, plane, end, t, lat, lon)
                out[k] = min(out.get(k, u), u)
    return sorted((*k, v) for k, v in out.items())


def test_arrival_points_against_loops(spark):
    rng = np.random.default_rng(2)
    calls = ["DLH1", "DLH2", "", "BAW7"]
    points = [(str(rng.choice(calls)), str(rng.choice(["aaaaaa", "bbbbbb"])), float(rng.integers(0, 20_000)), float(rng.integers(0, 3)), 1.0, float(rng.integers(0, 99))) for _ in range(3000)]
    arrivals = sorted({(str(rng.choice(["DLH1", "DLH2", "NONE"])), str(rng.choice(["aaaaaa", "cccccc", "bbbbbb"])), float(b), float(b + rng.choice([0, 60, 5000]))) for b in rng.integers(0, 20_000, 40)})
    a = spark.createDataFrame(arrivals, "callsign string, icao24 string, firstseen double, lastseen double")
    p = spark.createDataFrame([(" " + c.lower(), i.upper(), *r) for c, i, *r in points], "callsign string, icao24 string, t double, lat double, lon double, lastposupdate double").repartition(3)
    got = arrival_points(a, p, 1000.0, 19_000.0)
    assert sorted(map(tuple, got.select("callsign", "icao24", "lastseen", "t", "lat", "lon", "lastposupdate").collect())) == plain(points, arrivals, 1000.0, 19_000.0)
    assert arrival_points(a.limit(0), p, 0.0, 1.0).count() == 0 == arrival_points(a, p.limit(0), 0.0, 1.0).count()


def test_interval_join_edges(spark):
    intervals = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 10.0, 10.0, "b"), (1, 12.0, 11.0, "never"), (None, 0.0, 99.0, "null"), (1, None, 5.0, "open"), (2, -1e6, 1e6, "long"), (1, -25.0, -20.0, "before")], "k int, low double, high double, name string")
    points = spark.createDataFrame([(1, 10.0), (1, 0.0), (1, -20.0), (1, -19.0), (2, 77.7), (1, None), (None, 5.0)], "k int, t double")
    got = interval_join(points, intervals, "k").select("t", "name").collect()
    assert sorted(map(tuple, got)) == [(-20.0, "before"), (0.0, "a"), (10.0, "a"), (10.0, "b"), (77.7, "long")]


def candidates(spark, n):
    """Rows that meet before the times are compared, for one plane with n points and n / 10 intervals of one length."""
    points = spark.range(n).select(F.lit("x").alias("k"), (F.col("id") * 10.0).alias("t"))
    intervals = spark.range(n // 10).select(F.lit("x").alias("k"), (F.col("id") * 100.0).alias("low"), (F.col("id") * 100.0 + 300).alias("high"))
    out = interval_join(points, intervals, "k")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    assert "__bin" in plan.toString() and "NestedLoop" not in plan.toString() and "Cartesian" not in plan.toString()
    width = 300.0
    bins = lambda c: F.floor(F.col(c) / width)
    cells = intervals.withColumn("b", F.explode(F.sequence(bins("low"), bins("high"))))
    return points.withColumn("b", bins("t")).join(cells, ["k", "b"]).count(), out.count()


def test_candidates_of_one_hot_plane_grow_with_the_points(spark):
    few, found = candidates(spark, 2_000)
    many, found_many = candidates(spark, 20_000)
    assert found_many < 10.2 * found and many < 10.2 * few and many < 3 * found_many

"""Exact quantiles against NumPy, and the two ways of down-sampling metrics against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import sampling
from wayline.operators.hausdorff import pair_statistics
from wayline.operators.quantiles import exact_quantiles

WANTED = {"low": ("x", 0.0), "mid": ("x", 0.5), "p95": ("x", 0.95), "top": ("x", 1.0), "other": ("y", 0.25)}


def test_against_numpy_with_ties_signs_and_nulls(spark):
    rng = np.random.default_rng(6)
    groups = {
        "ties": rng.integers(-2, 3, 500).astype(float), "far": np.concatenate([rng.normal(0, 1e-9, 100), rng.normal(0, 1e12, 101)]), "one": np.array([-7.25]), "equal": np.full(300, 1 / 3),
        "zeros": np.array([0.0, -0.0, -1.0, 1.0]), "ends": np.array([-np.inf, np.inf, 1.0]), None: rng.random(50),
    }
    rows = [(k, float(v), float(i)) for k, vs in groups.items() for i, v in enumerate(vs)] + [("ties", None, None), ("empty", None, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], WANTED).collect()}
    assert set(got) == {*groups, "empty"}
    ends = got["ends"]  # NumPy has NaN between infinite values
    assert (ends["low"], ends["mid"], ends["top"]) == (-np.inf, 1.0, np.inf)
    for k, v in groups.items():
        for name, (c, p) in WANTED.items() if k != "ends" else ():
            assert got[k][name] == pytest.approx(np.percentile(v if c == "x" else np.arange(len(v)), 100 * p), rel=1e-12, nan_ok=True), (k, name)
    assert [got["empty"][n] for n in WANTED] == [None, None, None, None, 3.0]
    whole = exact_quantiles(df, [], {"m": ("y", 0.5)}).collect()
    assert len(whole) == 1 and whole[0]["m"] == np.median([y for _, _, y in rows if y is not None])


def test_pair_statistics_of_no_pair(spark):
    empty = spark.createDataFrame([], "a long, b long, hausdorff_km double")
    assert [tuple(r) for r in pair_statistics(empty).collect()] == [(0, 0.0, 0.0, 0.0, 0.0)]


def test_packed_and_spread_flights_agree(spark):
    rng = np.random.default_rng(9)
    rows = [(f, float(t), 40 + float(rng.random()), 7 + float(t) / 1000) for f in range(4) for t in np.unique(rng.choice([5, 10, 30, 60, 200], 80 if f else 1).cumsum())]
    df = spark.createDataFrame([*rows, (9, None, 1.0, 1.0)], "flight_id long, t double, lat double, lon double").repartition(3)
    order = ["interval_sec", "flight_id", *(c.split()[0] for c in sampling.METRICS.split(", ")), "retention_pct", "path_length_abs_error_pct"]
    one, other = (sorted(map(tuple, sampling.downsampling_metrics(df, [20, 60], n).select(*order).collect())) for n in (10**6, 5))
    assert len(one) == 8
    known = lambda row: [-1.0 if v is None else v for v in row]  # noqa: E731  a flight of one point has no share of a path
    for a, b in zip(map(known, one), map(known, other)):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
    metrics = sampling.downsampling_metrics(df, [20, 60])
    for a, b in zip(*(sorted(map(tuple, sampling.downsampling_summary(metrics, n).collect())) for n in (10**6, 0))):
        assert a == pytest.approx(b, rel=1e-12)
    assert sampling.downsampling_metrics(df.limit(0), [20]).count() == 0
    assert df.where(F.col("t").isNull()).count() == 1

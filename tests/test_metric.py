"""Bounds and what they leave to compare, against the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import cluster, hausdorff, metric
from wayline.operators.common import materialise


def flights(rng, n):
    """Three bundles of tracks, some with one remote point, one far away, one of a single point, and two that are equal."""
    out = {}
    for k in range(n):
        f = np.sort(rng.random(rng.integers(15, 40)))
        p = np.stack([50 - f + 0.7 * (k % 3) * f * (1 - f) + 0.01 * rng.normal(size=len(f)), 8 * f], axis=1)
        if k % 4 == 1:
            p[rng.integers(len(p))] = [20 + 0.01 * k, 106]
        out[k] = p
    out[n] = out[n - 1] + [-70.0, 100.0]
    out[n + 1], out[n + 2] = out[2][:1], out[3]
    return out


@pytest.fixture(scope="module", params=[0, 1])
def case(request, spark):
    sets = flights(np.random.default_rng(request.param), 70)
    rows = [(k, float(a), float(o)) for k, p in sets.items() for a, o in p] + [(None, 1.0, 1.0), (3, None, 2.0)]
    points = materialise(spark.createDataFrame(rows, "flight_id long, lat double, lon double").repartition(3))
    return metric.Sets(points, anchors=40, block_points=700), materialise(hausdorff.distance_matrix(points)), len(sets)


def rows(df):
    return sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_bounds_hold(case):
    sets, matrix, n = case
    pdf = sets.table.toPandas().sort_values("id").reset_index(drop=True)
    low, high = metric.lower(pdf, pdf), metric.upper(pdf, pdf)
    at = {k: i for i, k in enumerate(pdf.id)}
    for r in matrix.collect():
        chord, i, j = metric._chord(r["hausdorff_km"]), at[r["a"]], at[r["b"]]
        assert low[i, j] <= chord <= high[i, j]
    assert len(at) == n and sets.blocks > 2


@pytest.mark.parametrize("samples", [[5], [1, 3], [1], [200]])
def test_core_distances(case, samples):
    sets, matrix, n = case
    assert rows(metric.core_distances(sets, samples)) == rows(cluster.core_distances(matrix, samples))


@pytest.mark.parametrize("epsilon", [0.0, 5.0, 30.0, 500.0, 30_000.0])
def test_linkage_cut(case, epsilon):
    sets, matrix, n = case
    ids = sets.table.select(F.col("id").alias("i"))
    assert rows(metric.linkage_cut(sets, epsilon)) == rows(cluster.linkage_cut(matrix, ids, epsilon))


@pytest.mark.parametrize("top", [1, 10, 10_000])
def test_top_pairs(case, top):
    sets, matrix, n = case
    assert rows(metric.top_pairs(sets, top)) == rows(hausdorff.top_pairs(matrix, top))


def test_medoids(case, spark):
    sets, matrix, n = case
    labels = spark.createDataFrame([(k, -1 if k % 7 == 3 else 99 if k == 5 else k % 3) for k in range(n)], "i long, label long")
    assert rows(metric.medoids(sets, labels)) == rows(cluster.medoids(matrix, labels))


def test_few_pairs_are_compared(case, spark):
    sets, matrix, n = case
    whole = n * (n - 1) // 2
    assert matrix.count() == whole
    labels = spark.createDataFrame([(k, k % 3) for k in range(n)], "i long, label long")
    assert metric.core_pairs(sets, 5).count() < whole / 2
    assert metric.far_pairs(sets, 10).count() < whole / 4
    assert metric.medoid_pairs(sets, labels).count() < whole / 2
    compared = lambda km: metric.linked(sets, km).agg(F.sum("compared")).first()[0]
    assert compared(30.0) < whole / 4 and compared(500.0) < whole / 20


def test_no_sets_one_set_and_text_ids(spark):
    points = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0), ("b", 1.5, 3.0)], "flight_id string, lat double, lon double")
    got = metric.top_pairs(metric.Sets(points), 3).collect()
    assert [(r["a"], r["b"]) for r in got] == [("a", "b")]
    for few in (points.where("flight_id = 'a'"), points.limit(0)):
        sets = metric.Sets(few)
        assert metric.top_pairs(sets, 3).count() == 0 and metric.linkage_cut(sets, 1.0).count() == sets.count


def test_long_sets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(metric, "SET_POINTS", 2)
    points = spark.createDataFrame([(1, 1.0, float(k)) for k in range(3)], "flight_id int, lat double, lon double")
    with pytest.raises(ValueError, match="whole matrix"):
        metric.Sets(points)

"""The stored matrix: incremental, checked while it is written, published whole."""

import uuid

import pytest
from pyspark.sql import functions as F

from wayline.operators import matrix_store
from wayline.operators.hausdorff import distance_matrix
from wayline.operators.matrix_store import MatrixStore, matrix_metrics, set_digests, stored_matrix, unsound


@pytest.fixture
def points(spark):
    rows = [(f, float(t), 50 + 0.1 * f * f + 0.01 * t, 8.0 + 0.02 * t * f) for f in range(12) for t in range(5)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), (3, 9.0, None, 1.0)], "flight_id long, t double, lat double, lon double").repartition(3)


@pytest.fixture
def store(spark):
    return MatrixStore(spark, uuid.uuid4().hex)


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_only_pairs_of_changed_sets_are_compared(store, points, spark):
    matrix, manifest = store.update(points)
    assert rows(matrix) == rows(distance_matrix(points)) and manifest["compared"] == 66
    again, same = store.update(points.withColumn("t", F.col("t") + 1).repartition(5))  # times and files are no part of a distance
    assert same == manifest and rows(again) == rows(matrix)
    moved = points.where("flight_id <> 4").withColumn("lat", F.when(F.col("flight_id") == 7, F.col("lat") + 0.3).otherwise(F.col("lat")))
    moved = moved.unionByName(spark.createDataFrame([(20, 0.0, 51.0, 9.0), (20, 1.0, 51.5, 9.5)], points.schema))
    matrix, manifest = store.update(moved)
    assert rows(matrix) == rows(distance_matrix(moved)) and manifest["pairs"] == 66
    assert manifest["compared"] == 10 + 10 + 1  # flight 7 and flight 20, with the ten others and each other
    matrix, manifest = store.update(moved.where("flight_id <> 0"))
    assert manifest["compared"] == 0 and rows(matrix) == rows(distance_matrix(moved.where("flight_id <> 0")))
    assert len(store.files.names(f"{store.root}/versions")) == 2


def test_another_kernel_or_changed_files_are_stale(store, points, monkeypatch, spark):
    store.update(points)
    path, _ = store.latest()
    spark.range(1).write.mode("append").parquet(f"{path}/matrix")
    assert store.latest() is None and store.update(points)[1]["compared"] == 66
    monkeypatch.setattr(matrix_store, "KERNEL", 99)
    assert store.latest() is None and store.update(points)[1]["compared"] == 66


def test_a_crash_leaves_nothing_and_an_unsound_matrix_is_not_published(store, points, monkeypatch, spark):
    for broken in (lambda p, fresh: distance_matrix(p).where("a <> 3"), lambda p, fresh: distance_matrix(p).withColumn("hausdorff_km", F.lit(float("nan"))), lambda p, fresh: distance_matrix(p).withColumn("b", F.when((F.col("a") == 1) & (F.col("b") == 3), 2).otherwise(F.col("b")))):
        monkeypatch.setattr(matrix_store, "distance_matrix", broken)
        with pytest.raises(ValueError, match="unsound distance matrix"):
            store.update(points)
        assert store.latest() is None and not store.files.names(f"{store.root}/aside")
    monkeypatch.undo()
    whole = matrix_store.Files.rename
    monkeypatch.setattr(matrix_store.Files, "rename", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.update(points)
    assert store.latest() is None
    monkeypatch.setattr(matrix_store.Files, "rename", whole)
    assert store.update(points)[1]["compared"] == 66 and store.latest()


def test_metrics_know_all_pairs_from_others(spark, points):
    sets, matrix = set_digests(points), distance_matrix(points)
    found = lambda m: unsound(m.agg(*[c.alias(k) for k, c in matrix_metrics(m).items()]).first().asDict(), sets)
    assert found(matrix) == {}
    twice = matrix.where("NOT (a = 1 AND b = 2)").unionByName(matrix.where("a = 3 AND b = 4"))
    assert list(found(twice)) == ["other_pairs"]
    assert found(matrix.limit(0))["missing"] == 66


def test_no_sets_and_text_ids(spark):
    empty = spark.createDataFrame([], "flight_id string, lat double, lon double")
    name = uuid.uuid4().hex
    assert stored_matrix(empty, name).count() == 0
    some = spark.createDataFrame([("x", 1.0, 2.0), ("y", 1.0, 3.0)], empty.schema)
    assert [(r["a"], r["b"]) for r in stored_matrix(some, name).collect()] == [("x", "y")]

"""Sets in blocks of similar ones: which blocks a set visits, and the queries that need no matrix."""

import numpy as np
import pytest

from wayline.operators import cluster, hausdorff, metric
from wayline.operators.common import materialise
from wayline.plans import distances

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def towns(spark):
    """Four towns of short tracks, 400 km apart."""
    rng = np.random.default_rng(5)
    rows = [(k, 40.0 + 4 * (k % 4) + float(a), 5.0 + float(b)) for k in range(120) for a, b in 0.05 * rng.normal(size=(12, 2))]
    points = materialise(spark.createDataFrame(rows, "flight_id long, lat double, lon double"))
    return metric.Sets(points, anchors=40, block_points=130), materialise(hausdorff.distance_matrix(points))


def test_a_set_is_sent_to_few_blocks(towns):
    sets, _ = towns
    assert sets.blocks >= 10
    chord = metric._chord(50.0)
    ranges = sets.ranges
    moves = sets.toward(lambda pdf: ranges.low(np.stack(pdf.f)) <= chord).count()
    assert moves <= sets.count * sets.blocks / 3
    towns_of = sets.table.selectExpr("block", "id % 4 AS town").distinct().groupBy("block").count()
    assert not towns_of.where("count > 1").take(1)


def test_towns_equal_the_matrix(towns):
    sets, matrix = towns
    rows = lambda df: sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(metric.core_distances(sets, [1, 4])) == rows(cluster.core_distances(matrix, [1, 4]))
    assert rows(metric.top_pairs(sets, 7)) == rows(hausdorff.top_pairs(matrix, 7))
    ids = sets.table.selectExpr("id AS i")
    assert rows(metric.linkage_cut(sets, 20.0)) == rows(cluster.linkage_cut(matrix, ids, 20.0))


@pytest.mark.parametrize("name", ["top_pairs", "top_pair_appearances", "hausdorff_witness", "linkage_cut", "core_distance", "cluster_medoids", "noise_ranking", "noise_candidates", "persistent_noise_review"])
def test_no_matrix_is_made(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("the whole matrix")

    monkeypatch.setattr(distances, "stored_matrix", refuse)
    assert distances.QUERIES[name](spark, SF).count() > 0

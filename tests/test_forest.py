"""Spanning forests against Kruskal's algorithm, and what is shuffled for them."""

import numpy as np
import pytest

from wayline.operators import forest
from wayline.operators.cluster import core_distances, mutual_reachability, spanning_edges
from wayline.operators.forest import local_forests, minimum_forest


def kruskal(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    out = []
    for w, i, j in sorted(edges):
        a, b = find(i), find(j)
        if a != b:
            top[a] = b
            out.append((w, i, j))
    return sorted(out)


@pytest.mark.parametrize("n,density,ties", [(2, 1.0, True), (30, 1.0, True), (60, 0.05, True), (200, 0.02, False), (300, 0.5, True)])
def test_arrays_against_kruskal(n, density, ties):
    rng = np.random.default_rng(n)
    i, j = np.triu_indices(n, 1)
    some = rng.random(len(i)) < density
    i, j = i[some], j[some]
    w = rng.integers(0, 5, len(i)).astype(float) if ties else rng.random(len(i))
    at = minimum_forest(i, j, w, n)
    assert sorted((w[k], i[k], j[k]) for k in at) == kruskal(zip(w, i, j))


def test_each_task_keeps_a_forest_and_both_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, parts = 60, 6
    rows = [(ms, int(i), int(j), float(rng.integers(0, 9))) for ms in (1, 5) for i, j in zip(*np.triu_indices(n, 1))]
    rows += [(5, 900, 901, 1.0)]  # a second component
    df = spark.createDataFrame(rows, "ms int, i long, j long, w double").repartition(parts)
    want = sorted((ms, i, j, w) for ms in (1, 5) for w, i, j in kruskal([(w, i, j) for m, i, j, w in rows if m == ms]))
    shuffled = local_forests(df).count()
    assert shuffled <= parts * (2 * (n - 1) + 1) < len(rows) / 4
    assert sorted(map(tuple, spanning_edges(df).collect())) == want
    monkeypatch.setattr(forest, "HELD", 50)  # batches are reduced on the way
    assert sorted(map(tuple, spanning_edges(df).collect())) == want
    monkeypatch.setattr(forest, "AT_ONCE", 20)  # too many for a task: the rounds of Spark
    assert sorted(map(tuple, spanning_edges(df).collect())) == want


def test_core_distances_drop_far_rows_before_the_shuffle(spark):
    matrix = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 3, 4.0)], "a long, b long, hausdorff_km double")
    core = core_distances(matrix, [1, 2, 3])
    assert "WindowGroupLimit" in core._jdf.queryExecution().toString()
    assert sorted(map(tuple, core.collect())) == [(1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0), (2, 1, 1.0), (2, 2, 1.0), (2, 3, 2.0), (3, 1, 2.0), (3, 2, 4.0), (3, 3, 4.0)]
    got = mutual_reachability(matrix, core_distances(matrix, [2])).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 2, 1.0), (2, 1, 3, 2.0), (2, 2, 3, 4.0)]

"""The spatial index against comparing every point with every point."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import spatial
from wayline.operators.hausdorff import distance_matrix
from wayline.operators.spatial import Leaves, curve_key, directed_leaves, nearest_leaves, pieces


def sphere(lat, lon):
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def track(rng, n, spread=0.4):
    f, bend = np.sort(rng.random(n)), rng.normal(0, spread, 3)
    lat = 51.5 - 1.4 * f + sum(b * np.sin((k + 1) * np.pi * f) for k, b in enumerate(bend))
    return np.stack([lat, -0.5 + 9 * f], axis=1)


def brute(a, b):
    """Squared chords from all of ``a`` to the nearest of ``b``."""
    return ((a[:, None] - b[None]) ** 2).sum(axis=2).min(axis=1)


SETS = {
    "tracks": lambda rng: (sphere(*track(rng, 1500).T), sphere(*track(rng, 1333).T)),
    "globe": lambda rng: (sphere(rng.uniform(-90, 90, 900), rng.uniform(-180, 180, 900)), sphere(rng.uniform(-90, 90, 7), rng.uniform(-180, 180, 7))),
    "equal points": lambda rng: (np.repeat(sphere([10.0], [179.9]), 100, axis=0), np.repeat(sphere([10.0], [-179.9]), 33, axis=0)),
    "one point": lambda rng: (sphere([1.0], [2.0]), sphere(*track(rng, 100).T)),
    "same": lambda rng: (sphere(*track(np.random.default_rng(1), 700).T),) * 2,
}


@pytest.mark.parametrize("name", SETS)
def test_leaves_are_exact(name):
    a, b = SETS[name](np.random.default_rng(3))
    p, q = Leaves(a), Leaves(b)
    for x, y, s, t in ((a, b, p, q), (b, a, q, p)):
        want = brute(x, y)
        assert directed_leaves(s, t) == pytest.approx(want.max(), rel=1e-12, abs=1e-30)
        assert sorted(set(nearest_leaves(s, t).round(15))) == sorted(set(want.round(15)))


def test_few_distances_are_computed(monkeypatch):
    """On two tracks of 3,629 points far fewer than the 13 million distances of a pair."""
    rng, seen = np.random.default_rng(0), [0]
    least = spatial._least

    def counted(a, b, i, j):
        seen[0] += len(i) * a.axes[0].shape[1] * b.axes[0].shape[1]
        return least(a, b, i, j)

    monkeypatch.setattr(spatial, "_least", counted)
    p, q = (Leaves(sphere(*track(rng, 3629).T)) for _ in range(2))
    directed_leaves(p, q)
    assert seen[0] < 3629**2 / 20


def test_pieces_hold_all_points_in_compact_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, x)) for k, n in enumerate((3000, 40, 1)) for x in sphere(rng.uniform(-90, 90, n), rng.uniform(-180, 180, n))]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double").repartition(5)
    got = pieces(df, 100).collect()
    assert sorted((r["id"], *map(float, x)) for r in got for x in np.frombuffer(r["points"]).reshape(-1, 3)) == sorted(set(rows))
    assert all(r["n"] <= 100 for r in got) and len({r["piece"] for r in got}) == len(got)
    assert np.median([r["r"] for r in got if r["id"] == 0]) < 0.9  # of random points it is near 1
    keys = df.select(curve_key(F.col("x"), F.col("y"), F.col("z")).alias("k")).agg(F.min("k"), F.max("k")).first()
    assert 0 <= keys[0] < keys[1] < 1 << 48


def test_long_sets_meet_piece_by_piece(spark, monkeypatch):
    """Sets over the bound, among short ones, with pieces and parts made small, against all points."""
    monkeypatch.setattr(spatial, "PIECE_POINTS", 64)
    monkeypatch.setattr(spatial, "PIECES_TOGETHER", 2)
    rng = np.random.default_rng(7)
    sets = {k: track(rng, n) for k, n in enumerate((900, 30, 700, 5, 1))} | {9: np.stack([rng.uniform(-90, 90, 800), rng.uniform(-180, 180, 800)], axis=1)}
    rows = [(k, float(la), float(lo)) for k, p in sets.items() for la, lo in p] + [(0, None, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "flight_id int, lat double, lon double").repartition(4)
    got = {(r["a"], r["b"]): r[2:] for r in distance_matrix(df, set_points=100).collect()}
    assert sorted(got) == [(a, b) for a in sorted(sets) for b in sorted(sets) if a < b]
    whole = {(r["a"], r["b"]): r[2:] for r in distance_matrix(df).collect()}
    for (a, b), (ab, ba, d) in got.items():
        p, q = sphere(*sets[a].T), sphere(*sets[b].T)
        want = [2 * 6371.0088 * np.arcsin(np.sqrt(brute(x, y).max()) / 2) for x, y in ((p, q), (q, p))]
        assert [ab, ba, d] == pytest.approx([*want, max(want)], rel=1e-4) and [ab, ba, d] == pytest.approx(list(whole[a, b]), abs=1e-9)

import math
import random

import numpy as np
import pytest

from wayline.llm.embedding_dedup import Geometry, _rotated, _unit, embedding_dedup
from wayline.llm.graph import connected_components

SCHEMA = "vec_id long, embedding array<double>, label int, Kept string"


def brute(rows, threshold):
    def fit(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if None in (a[0], b[0], a[2], b[2]) or a[2] != b[2] or not fit(a[1]) or not fit(b[1]) or len(a[1]) != len(b[1]):
                continue
            u, v = (np.array(x) / np.abs(x).max() for x in (a[1], b[1]))
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), c, rows[i][0] == c))
    return sorted(out, key=str)


def data(rng, dim, n, labels):
    centres = [rng.normal(size=dim) for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.15])
        rows.append((int(i * 7 % 1000), [float(x) for x in c * rng.choice([1e-3, 1, 50])], int(rng.integers(labels)), "x"))
    return rows


@pytest.mark.parametrize("dim,sizes", [(64, {}), (64, {"cell_rows": 20, "aim_rows": 3}), (3, {"cell_rows": 30, "aim_rows": 2}), (10, {"aim_rows": 1}), (1, {}), (64, {"pairs_a_row": 0}), (10, {"pairs_a_row": 0, "cell_rows": 20, "aim_rows": 4})])
def test_against_brute_force(spark, dim, sizes):
    rng = np.random.default_rng(dim)
    rows = data(rng, dim, 220, 2)
    odd = [[0.0] * dim, None, [], [None] * dim, [float("nan")] * dim, [float("inf")] * dim, [1e300] * dim, [-1e-300] * dim]
    rows += [(2000 + i, v, 0, None) for i, v in enumerate(odd)]
    rows += [rows[0], rows[0], (3000, rows[0][1], None, "n"), (None, rows[0][1], 0, "n"), (3001, rows[0][1], rows[0][2], "copy"), (3002, [*rows[0][1], 1.0], rows[0][2], "longer")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = embedding_dedup(df, **sizes).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 0.98)


def test_pairs_share_a_block():
    rng = np.random.default_rng(0)
    geometry = Geometry(64, 0.98, 8)
    u = _unit(rng.normal(size=(500, 64)))
    v = _unit(u + rng.normal(size=u.shape) * 0.026)
    close = (u * v).sum(axis=1) >= 0.98
    gaps = ((_rotated(u) - _rotated(v)) ** 2).reshape(len(u), 8, 8).sum(axis=2)
    assert close.sum() > 50 and (gaps.min(axis=1)[close] <= geometry.budget).all()


def test_empty(spark):
    out = embedding_dedup(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["vec_id", "embedding", "label", "n_links", "component_id", "kept"] and out.count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(25)] + [(5, None), (3, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()))
    assert got == {n: find(n) for n in parent if find(n) != n}

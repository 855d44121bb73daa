"""Pairs of sets of two blocks against brute force, in little memory."""

import tracemalloc

import numpy as np
import pytest

from wayline.operators.hausdorff import compare_blocks


def tracks(rng, n, points=60):
    out = []
    for k in range(n):
        f = np.sort(rng.random(rng.integers(points // 2, points)))
        lat, lon = np.radians(50 - f + 0.1 * (k % 3)), np.radians(8 * f)
        out.append(np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1))
    return out


def brute(a, b):
    x, y, z = (np.subtract.outer(a[:, k], b[:, k]) for k in range(3))
    c2 = x * x + y * y + z * z
    return float(c2.min(axis=1).max()), float(c2.min(axis=0).max())


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("part", [1.0, 0.2])
def test_blocks_equal_brute_force(same, part):
    rng = np.random.default_rng(3)
    left = tracks(rng, 30)
    left += [left[0][:1], left[1], left[2] + 1e-9, left[3][::-1], np.repeat(left[4], 30, axis=0)]
    right = left if same else tracks(rng, 20) + left[:3] + left[-1:]
    wanted = None if part == 1.0 else rng.random((len(left), len(right))) < part
    want = [(i, j, *brute(a, b)) for i, a in enumerate(left) for j, b in enumerate(right) if (j > i or not same) and (wanted is None or wanted[i, j])]
    got = sorted(compare_blocks(left, right, same, wanted))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    long = [max(len(left[i]), len(right[j])) > 1024 for i, j, *_ in want]
    for g, w, by_index in zip(got, want, long):
        assert g == w or by_index and np.allclose(g, w, rtol=1e-12, atol=0)


def test_chords_of_a_set_and_a_block_are_never_all_in_memory():
    sets = tracks(np.random.default_rng(4), 150)
    tracemalloc.start()
    compare_blocks(sets, sets[:], False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6

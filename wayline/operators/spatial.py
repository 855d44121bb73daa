"""An index for nearest points: balanced leaves in a set, compact pieces of sets too long for a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.common import materialise

#: Points of a leaf at most, and leaves looked at together.
LEAF, TOGETHER = 16, 4
#: Bounds are widened by this, far above what rounding of unit vectors can do.
SLACK = 1e-7
#: Points of a piece, and pieces of the other set that meet one piece in a task.
PIECE_POINTS, PIECES_TOGETHER = 8_192, 16


class Leaves:
    """Points halved at the median of their widest axis until a part is a leaf, with each leaf's centre and radius.

    All leaves have one size; the last point is repeated to fill them, which changes no distance.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        depth = max(0, int(np.ceil(np.log2(len(points) / leaf))))
        size = -(-len(points) // (1 << depth))
        p = np.concatenate([points, np.repeat(points[-1:], (size << depth) - len(points), axis=0)])[None]
        for _ in range(depth):
            widest = np.ptp(p, axis=1).argmax(axis=1)
            order = np.argsort(np.take_along_axis(p, widest[:, None, None], 2)[:, :, 0], axis=1, kind="stable")
            p = np.take_along_axis(p, order[:, :, None], 1).reshape(2 * len(p), -1, 3)
        self.axes = [np.ascontiguousarray(p[:, :, k]) for k in range(3)]
        self.centre = p.mean(axis=1)
        self.radius = np.sqrt(((p - self.centre[:, None]) ** 2).sum(axis=2).max(axis=1))

    def __len__(self) -> int:
        return len(self.radius)


def _least(a: Leaves, b: Leaves, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of leaves: the squared chord from every point of the one to its nearest in the other, from differences."""
    out = None
    for x, y in zip(a.axes, b.axes):
        d = x[i][:, :, None] - y[j][:, None, :]
        d *= d
        out = d if out is None else np.add(out, d, out=out)
    return out.min(axis=2)


def _bounds(a: Leaves, b: Leaves) -> tuple[np.ndarray, np.ndarray]:
    """Chords between centres, and for each point of ``a`` its nearest in the leaf of ``b`` with the nearest centre."""
    square = (a.centre**2).sum(axis=1)[:, None] + (b.centre**2).sum(axis=1) - 2 * a.centre @ b.centre.T
    apart = np.sqrt(np.maximum(square, 0))
    return apart, _least(a, b, np.arange(len(a)), apart.argmin(axis=1))


def _exact(a: Leaves, b: Leaves, apart: np.ndarray, upper: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The nearest of ``b`` for all points of some leaves: only leaves of ``b`` that can be as near as the bounds are looked at."""
    near = apart[rows] - b.radius - a.radius[rows][:, None] <= np.sqrt(upper[rows].max(axis=1))[:, None] + SLACK
    i, j = np.nonzero(near)
    return np.minimum.reduceat(_least(a, b, rows[i], j), np.flatnonzero(np.diff(i, prepend=-1)), axis=0)


def directed_leaves(a: Leaves, b: Leaves) -> float:
    """Largest squared chord from a point of ``a`` to its nearest in ``b``.

    Leaves are taken in falling order of their bound, until no bound is above the largest distance found.
    """
    apart, upper = _bounds(a, b)
    bound = upper.max(axis=1)
    order, best = np.argsort(-bound, kind="stable"), 0.0
    for k in range(0, len(order), TOGETHER):
        rows = order[k : k + TOGETHER]
        rows = rows[bound[rows] > best]
        if not len(rows):
            break
        best = max(best, float(_exact(a, b, apart, upper, rows).max()))
    return best


def nearest_leaves(a: Leaves, b: Leaves) -> np.ndarray:
    """The squared chord from every point of ``a``, in the order of its leaves, to its nearest in ``b``."""
    apart, upper = _bounds(a, b)
    return np.concatenate([_exact(a, b, apart, upper, np.arange(k, min(k + TOGETHER, len(a)))) for k in range(0, len(a), TOGETHER)]).ravel()


def curve_key(x: Column, y: Column, z: Column, bits: int = 16) -> Column:
    """The place of a point of the unit sphere along a curve that keeps near points together (bits of the three axes in turn)."""
    cells = [F.floor((c + 1) * (1 << (bits - 1))).cast("long") for c in (x, y, z)]
    one = lambda b, k: F.shiftleft(F.shiftright(cells[k], b).bitwiseAND(F.lit(1).cast("long")), 3 * b + k)
    return reduce(lambda u, v: u.bitwiseOR(v), [one(b, k) for b in range(bits) for k in range(3)])


def pieces(rows: DataFrame, piece_points: int | None = None) -> DataFrame:
    """(id, piece, n, cx, cy, cz, r, points) of sets (id, x, y, z) of any size: compact parts with their bounding balls.

    The points are sorted by ranges of (id, place on the curve), so a long set is cut over partitions and no task
    holds a set. Repeated points of a piece are dropped.
    """
    most = piece_points or PIECE_POINTS
    kind = dict(rows.dtypes)["id"]
    ordered = rows.withColumn("key", curve_key(F.col("x"), F.col("y"), F.col("z"))).repartitionByRange("id", "key").sortWithinPartitions("id", "key")
    schema = f"id {kind}, piece long, n int, cx double, cy double, cz double, r double, points binary"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, own = TaskContext.get().partitionId() << 33, [], None

        def emit() -> pd.DataFrame:
            nonlocal number, held
            p = np.unique(np.concatenate(held), axis=0)
            centre = p.mean(axis=0)
            number, held = number + 1, []
            return pd.DataFrame({"id": [own], "piece": number, "n": len(p), "cx": centre[0], "cy": centre[1], "cz": centre[2], "r": float(np.sqrt(((p - centre) ** 2).sum(axis=1).max())), "points": p.tobytes()})

        for pdf in batches:
            ids, p = pdf["id"].to_numpy(), pdf[["x", "y", "z"]].to_numpy()
            starts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for s, e in zip(starts, starts[1:]):
                if held and own != ids[s]:
                    yield emit()
                while s < e:
                    room = most - sum(map(len, held))
                    own = ids[s]
                    held.append(p[s : min(e, s + room)])
                    s += room
                    if sum(map(len, held)) == most:
                        yield emit()
        if held:
            yield emit()

    return ordered.select("id", "x", "y", "z").mapInPandas(cut, schema)


def _candidates(source: pd.DataFrame, target: pd.DataFrame) -> list[tuple[int, list[int]]]:
    """The pieces of ``source`` that can hold the farthest point, each with the pieces of ``target`` that can hold a nearest one."""
    c = ["cx", "cy", "cz"]
    p, q = source[c].to_numpy(), target[c].to_numpy()

    def bounds(at: slice) -> tuple[np.ndarray, np.ndarray]:
        apart = np.sqrt(sum(np.subtract.outer(p[at, k], q[:, k]) ** 2 for k in range(3)))
        both = source.r.to_numpy()[at, None] + target.r.to_numpy() + SLACK
        return apart - both, (apart + both).min(axis=1)

    parts = [slice(k, k + 256) for k in range(0, len(p), 256)]
    least = max(0.0, max(float(bounds(at)[0].min(axis=1).max()) for at in parts))
    out = []
    for at in parts:
        low, upper = bounds(at)
        out += [(at.start + k, np.flatnonzero(low[k] <= upper[k]).tolist()) for k in np.flatnonzero(upper >= least).tolist()]
    return out


def long_pairs(rows: DataFrame, long_ids: DataFrame, blocks: int, piece_points: int | None = None) -> DataFrame:
    """(a, b, ab, ba): squared directed chords of all pairs a < b of sets (id, x, y, z) of which one at least is in ``long_ids``.

    Bounding balls choose for each piece of a set the pieces of the other that can hold a nearest point; a task compares
    one piece with at most ``PIECES_TOGETHER`` of them, so no task grows with a set.
    """
    kind = dict(rows.dtypes)["id"]
    table = materialise(pieces(rows, piece_points))
    balls = table.drop("points", "n").join(F.broadcast(long_ids).withColumn("long", F.lit(True)) if long_ids.count() <= 100_000 else long_ids.withColumn("long", F.lit(True)), "id", "left")
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    placed = balls.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = placed.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        sets = {i: (g, bool(g.long.fillna(False).any()), int(g.own.iloc[0])) for i, g in pdf.groupby("id")}
        out = []
        for i, (p, p_long, p_own) in sets.items():
            for j, (q, q_long, q_own) in sets.items():
                if i < j and (p_long or q_long) and {p_own, q_own} == {low, high}:
                    for forth, s, t in ((True, p, q), (False, q, p)):
                        for k, near in _candidates(s, t):
                            parts = -(-len(near) // PIECES_TOGETHER)
                            out += [(i, j, forth, s.piece.iloc[k], t.piece.iloc[m], n // PIECES_TOGETHER, parts == 1) for n, m in enumerate(near)]
        return pd.DataFrame(out, columns=["a", "b", "forth", "source", "target", "part", "whole"])

    chosen = materialise(placed.groupBy("low", "high").applyInPandas(choose, f"a {kind}, b {kind}, forth boolean, source long, target long, part int, whole boolean"))
    task = ["a", "b", "forth", "source", "part", "whole"]
    side = lambda rows, by, k: rows.join(table.select(F.col("piece").alias(by), "points"), by).select(*task, F.lit(k).alias("side"), "points")
    meet = side(chosen, "target", 1).unionByName(side(chosen.select(*task).distinct(), "source", 0))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = (np.concatenate([np.frombuffer(b).reshape(-1, 3) for b in pdf.points[pdf.side == k]]) for k in (0, 1))
        whole = bool(pdf.whole.iloc[0])
        c2 = [directed_leaves(Leaves(p), Leaves(q))] if whole else nearest_leaves(Leaves(p), Leaves(q))
        return pdf[["a", "b", "forth", "source"]].iloc[:1].assign(c2=[c2])

    found = meet.groupBy(*task).applyInPandas(compare, f"a {kind}, b {kind}, forth boolean, source long, c2 array<double>")
    # the parts of one piece give each of its points in the same order
    near = found.select("a", "b", "forth", "source", F.posexplode("c2").alias("at", "c2")).groupBy("a", "b", "forth", "source", "at").agg(F.min("c2").alias("c2"))
    return near.groupBy("a", "b").agg(F.max(F.when(F.col("forth"), F.col("c2"))).alias("ab"), F.max(F.when(~F.col("forth"), F.col("c2"))).alias("ba"))

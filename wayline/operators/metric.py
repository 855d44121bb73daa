"""Answers from Hausdorff distances without all of them: bounds from anchor points leave few pairs to compare.

With f(A, q) the chord from an anchor point q to its nearest of A, no two sets are nearer than
``|f(A, q) - f(B, q)|`` or farther apart than ``max(r(A, q) + f(B, q))`` both ways, where r(A, q) is the chord from q to the farthest
point of A that has q as its nearest anchor. The anchors are points of the data and only decide how much
work is saved. Similar sets share a block, a set visits only the blocks whose ranges of bounds it can't rule out, and the bounds
of pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import EARTH_KM, arc_km, unit_sphere
from wayline.operators import cluster
from wayline.operators.common import materialise
from wayline.operators.forest import roots
from wayline.operators.hausdorff import MOST_TASKS, SET_POINTS, compare_packed
from wayline.operators.hausdorff import top_pairs as top_of
from wayline.operators.spatial import SLACK

#: Anchor points, and the points of the data that they are chosen from; sets that the blocks are planned from.
ANCHORS, SAMPLE, SAMPLE_SETS = 160, 4_096, 2_048
#: Points and sets of a block at most, about; blocks of little data at least.
NEAR_POINTS, BLOCK_SETS, LEAST_BLOCKS = 131_072, 2_048, 3
#: Cells of two blocks' points at most, and rows whose distances are screened together.
CELLS, STRIP = 1_536, 256

Visit = Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]


class LongSets(ValueError):
    """Some sets have too many points for a task."""


class Sets:
    """Packed sets (id, x, y, z, f, r, block), written once, in blocks of similar sets, and the ranges of f and r in each block.

    A block's ranges are a few numbers for about two thousand sets; they are sent to the tasks that choose which sets meet which blocks.
    """

    def __init__(self, points: DataFrame, id_col: str = "flight_id", anchors: int = ANCHORS, block_points: int = NEAR_POINTS):
        x, y, z = unit_sphere(F.col("lat"), F.col("lon"))
        self.kind = dict(points.dtypes)[id_col]
        rows = points.where(F.col(id_col).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col(id_col).alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))
        sizes = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n"), F.count("*")).first()
        if (sizes[1] or 0) > SET_POINTS:
            raise LongSets(f"sets of over {SET_POINTS} points need the whole matrix")
        self.count = sizes[2]
        sample = rows.orderBy(F.xxhash64("id", "x", "y", "z"), "id", "x", "y", "z").select("x", "y", "z").limit(SAMPLE).collect()
        q = anchor_points(np.array([tuple(p) for p in sample], float).reshape(-1, 3), anchors)

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                f, r = [], []
                for p in _points(pdf):
                    least, owner, dist = np.full(len(q), np.inf), [], []
                    for k in range(0, len(p), 4096):
                        apart = np.sqrt(sum(np.subtract.outer(p[k : k + 4096, c], q[:, c]) ** 2 for c in range(3)))
                        least = np.minimum(least, apart.min(axis=0))
                        owner.append(apart.argmin(axis=1))
                        dist.append(apart.min(axis=1))
                    far = np.full(len(q), -np.inf)
                    np.maximum.at(far, np.concatenate(owner), np.concatenate(dist))
                    f.append(np.concatenate([least, p.min(axis=0), p.max(axis=0)]))
                    r.append(far)
                yield pdf.assign(f=f, r=r)

        packed = rows.groupBy("id").agg(F.collect_list(F.struct("x", "y", "z")).alias("p")).select("id", "p.x", "p.y", "p.z", F.xxhash64("id").alias("h"))
        packed = materialise(packed)
        schema = f"id {self.kind}, x array<double>, y array<double>, z array<double>, f array<double>, r array<double>"
        some = packed.orderBy("h", "id").limit(SAMPLE_SETS).mapInPandas(lambda batches: (pdf[["f"]] for pdf in measured(batches)), "f array<double>").collect()
        wide = min(BLOCK_SETS, max(1, int(self.count * block_points / max(1, sizes[0] or 0))), max(1, -(-self.count // LEAST_BLOCKS)))
        place = plan_blocks(np.array([s["f"] for s in some], float).reshape(len(some), len(q) + 6), self.count, wide)

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in measured(batches):
                yield pdf.assign(block=place(np.stack(pdf.f), pdf.h.to_numpy()).astype("int32") if len(pdf) else []).drop(columns="h")

        self.table = materialise(packed.mapInPandas(placed, schema + ", block int"))

        def ranges(pdf: pd.DataFrame) -> pd.DataFrame:
            f, r = np.stack(pdf.f), np.stack(pdf.r)
            return pd.DataFrame({"block": pdf.block.iloc[:1], "first": pdf.id.min(), "n": len(pdf), "least": [f.min(axis=0)], "most": [f.max(axis=0)], "far": [r.max(axis=0)]})

        of = self.table.select("id", "block", "f", "r").groupBy("block").applyInPandas(ranges, f"block int, first {self.kind}, n long, least array<double>, most array<double>, far array<double>").collect()
        self.ranges = Ranges(sorted(of, key=lambda row: row["block"]))
        self.blocks = len(of)

    def toward(self, goes: Callable[[pd.DataFrame], np.ndarray], extra: DataFrame | None = None) -> DataFrame:
        """(id, block, to): the blocks but its own that each set goes to; ``goes`` is of rows (id, f, r, ...) and all blocks in order."""
        rows = self.with_extra(self.table.drop("x", "y", "z"), extra)
        names = self.ranges.names

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yes = goes(pdf) & (pdf.block.to_numpy()[:, None] != names)
                    i, k = np.nonzero(yes)
                    yield pd.DataFrame({"id": pdf.id.to_numpy()[i], "block": pdf.block.to_numpy()[i], "to": names[k]})

        return rows.mapInPandas(choose, f"id {self.kind}, block int, to int")

    def with_extra(self, rows: DataFrame, extra: DataFrame | None) -> DataFrame:
        if extra is None:
            return rows
        return rows.join(F.broadcast(extra) if self.count <= cluster.BROADCAST_IDS else extra, "id", "left")

    def meet(self, visit: Visit, schema: str, moves: DataFrame, extra: DataFrame | None = None, own: np.ndarray | None = None, bounds: bool = True, mutual: bool = False) -> DataFrame:
        """What ``visit`` makes of each block with itself (or of the blocks ``own``), and of the sets that move to a block (id, block, to) with it.

        Visitors of a block are dealt to groups of a block's size, by the blocks that they are from. If a pair counts only if both of its sets would
        move (``mutual``), of two blocks the one with the fewer moves to the other. ``extra`` (id, ...) has a row for some sets.
        """
        moves = materialise(moves)
        counts = {(m["block"], m["to"]): m["count"] for m in moves.groupBy("block", "to").count().collect()}
        if mutual:
            counts = {(p, q): n for (p, q), n in counts.items() if (n, p) < (counts.get((q, p), 0), q)}
        # visitors from one block are like each other; few from many blocks share a group
        groups: dict[int, int] = {}
        parts: dict[tuple[int, int], tuple[int, int]] = {}
        room: dict[int, tuple[int, int]] = {}
        for (p, q), n in sorted(counts.items()):
            if n * 8 > BLOCK_SETS:
                many = -(-n // BLOCK_SETS)
                parts[p, q] = (groups.get(q, 0) + 1, many)
                groups[q] = groups.get(q, 0) + many
            else:
                part, left = room.get(q, (0, 0))
                if left < n:
                    groups[q] = groups.get(q, 0) + 1
                    part, left = groups[q], BLOCK_SETS
                parts[p, q], room[q] = (part, 1), (part, left - n)
        spark = self.table.sparkSession
        alone = {int(b) for b in (self.ranges.names if own is None else own)}
        homes = [(int(b), g) for b in self.ranges.names for g in range(int(b) not in alone, groups.get(int(b), 0) + 1)]
        table = self.with_extra(self.table if bounds else self.table.drop("f", "r"), extra)
        home = table.join(F.broadcast(spark.createDataFrame(homes, "block int, part int")), "block").select(F.col("block").alias("at"), "part", F.lit(False).alias("guest"), *table.columns)
        allowed = spark.createDataFrame([(int(p), int(q), *to) for (p, q), to in parts.items()], "block int, to int, first int, parts int")
        going = moves.join(F.broadcast(allowed), ["block", "to"]).select("id", "to", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"))
        visiting = table.join(going, "id").select(F.col("to").alias("at"), "part", F.lit(True).alias("guest"), *table.columns)

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            p, q = pdf[pdf.guest].reset_index(drop=True), pdf[~pdf.guest].reset_index(drop=True)
            return visit(q, q, True) if not key[1] else visit(p, q, False)

        both = home.unionByName(visiting) if counts else home
        return both.repartition(min(MOST_TASKS, max(1, 2 * len(homes))), "at", "part").groupBy("at", "part").applyInPandas(run, schema)


class Ranges:
    """The least and most f and the most r of each block, in the order of blocks."""

    def __init__(self, rows: list):
        self.names = np.array([r["block"] for r in rows], np.int32)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.first = [r["first"] for r in rows]
        self.least, self.most, self.far = (np.array([r[c] for r in rows], float).reshape(len(rows), -1 if rows else 0) for c in ("least", "most", "far"))

    def low(self, f: np.ndarray) -> np.ndarray:
        """Chords that the distances of sets to all sets of each block are not below."""
        out = [np.maximum(f - most, least - f).max(axis=1) for least, most in zip(self.least, self.most)]
        return np.stack(out, axis=1).clip(0) - SLACK

    def high(self, f: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Chords that they are not above."""
        k = r.shape[1]
        out = [np.maximum(r + most[:k], f[:, :k] + far).max(axis=1) for most, far in zip(self.most, self.far)]
        return np.stack(out, axis=1) + SLACK


def plan_blocks(sample: np.ndarray, count: int, wide: int, leaves: int = 256) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Places sets with f and a hash in blocks of about ``wide``: the sample is halved in the middle of a wide range, then leaves are dealt by hash.

    A cut that parts off less than a twentieth is not made, for blocks of few sets know little of their neighbours.
    """
    nodes: list[list] = [[-1, 0.0, 0, 0]]
    held, todo, done = {0: sample}, [0], 0
    share = max(1.0, len(sample) * wide / max(1, count))
    while todo and done + len(todo) < leaves:
        k = todo.pop(0)
        part = held[k]
        if len(part) > share:
            low, high = part.min(axis=0), part.max(axis=0)
            for d in np.argsort(low - high, kind="stable")[:8]:
                cut = (low[d] + high[d]) / 2
                right = part[:, d] > cut
                if min(right.sum(), (~right).sum()) * 20 >= len(part) and high[d] - low[d] > SLACK:
                    nodes[k] = [int(d), float(cut), len(nodes), len(nodes) + 1]
                    for side in (~right, right):
                        held[len(nodes)] = part[side]
                        todo.append(len(nodes))
                        nodes.append([-1, 0.0, 0, 0])
                    break
        done += nodes[k][0] < 0
    parts = np.array([0 if n[0] >= 0 else max(1, int(np.ceil(len(held[k]) / share))) for k, n in enumerate(nodes)])
    first = np.cumsum(parts) - parts

    def place(f: np.ndarray, h: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(f), np.int64)
        for k, (d, cut, left, right) in enumerate(nodes):  # children come after their parents
            if d >= 0:
                at = np.flatnonzero(leaf == k)
                leaf[at] = np.where(f[at, d] > cut, right, left)
        return first[leaf] + np.mod(h, parts[leaf])

    return place


def anchor_points(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` points of the sample: most each the farthest from those before, so that remote points have an anchor near, the others as they come."""
    if len(sample) <= n:
        return sample
    apart, chosen = np.full(len(sample), np.inf), [*range(n // 5)]
    for k in range(n):
        if k >= len(chosen):
            chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((sample - sample[chosen[k]]) ** 2).sum(axis=1))
    return sample[chosen]


def _points(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.stack([np.asarray(v, float) for v in (r.x, r.y, r.z)], axis=1) for r in pdf.itertuples()]


def lower(p: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
    """Chords that the distances of all pairs are not below."""
    out = np.zeros((len(p), len(q)))
    f, g = np.stack(p.f), np.stack(q.f)
    for k in range(f.shape[1]):
        np.maximum(out, np.abs(np.subtract.outer(f[:, k], g[:, k])), out=out)
    return out - SLACK


def upper(p: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
    """Chords that the distances of all pairs are not above."""
    r, s, f, g = np.stack(p.r), np.stack(q.r), np.stack(p.f), np.stack(q.f)
    out = np.zeros((len(p), len(q)))
    for k in range(r.shape[1]):
        np.maximum(out, np.add.outer(r[:, k], g[:, k]), out=out)
        np.maximum(out, np.add.outer(f[:, k], s[:, k]), out=out)
    return out + SLACK


def _chord(km: float) -> float:
    """The chord of an arc, or more than any if the arc is half the globe or longer."""
    return 3.0 if km >= np.pi * EARTH_KM else 2 * float(np.sin(km / EARTH_KM / 2))


def arc_of(square: np.ndarray) -> np.ndarray:
    """Kilometres of squared chords."""
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(square) / 2))


class Cells:
    """The points of two blocks in cells: which cells each set has points in, and how far each set is from the cells' middles.

    A set with a point in a cell of radius r, and another whose nearest point to the middle is f away, are at least f - r apart.
    Cells are as small as their number allows.
    """

    def __init__(self, blocks: list[list[np.ndarray]], most: int = CELLS):
        sizes = [len(s) for b in blocks for s in b]
        p = np.concatenate([s for b in blocks for s in b])
        low, extent = p.min(axis=0), float(np.ptp(p, axis=0).max())

        def cut_by(side: float) -> np.ndarray:
            key = ((p - low) / side).astype(np.int64)
            return np.unique((key[:, 0] << 42) | (key[:, 1] << 21) | key[:, 2], return_inverse=True)[1]

        side = max(extent / most, 1e-6)
        cell = cut_by(side)
        while cell.max() < most and side > 1e-6:
            side /= 2
            cell = cut_by(side)
        while cell.max() >= most:
            side *= 1.25
            cell = cut_by(side)
        n = int(cell.max()) + 1
        size = np.bincount(cell, minlength=n)
        self.middle = np.stack([np.bincount(cell, p[:, k], n) / size for k in range(3)], axis=1)
        self.radius = np.zeros(n)
        np.maximum.at(self.radius, cell, np.sqrt(((p - self.middle[cell]) ** 2).sum(axis=1)))
        of = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.zeros((len(sizes), n), np.float32)
        inside[of, cell] = 1
        apart = np.empty((len(sizes), n), np.float32)
        square = (self.middle**2).sum(axis=1)
        k = 0
        for b in blocks:
            for s in b:
                c2 = (s**2).sum(axis=1)
                apart[k] = np.sqrt(np.maximum(0, (c2[:, None] - 2 * (s @ self.middle.T)).min(axis=0) + square)) - self.radius
                k += 1
        cut = np.cumsum([0, *map(len, blocks)])
        self.inside = [inside[u:v] for u, v in zip(cut, cut[1:])]
        self.apart = [apart[u:v] for u, v in zip(cut, cut[1:])]

    def score(self) -> np.ndarray:
        """A number for each pair of sets of the two blocks that mostly is the smaller the nearer they are."""
        scale = max(1e-9, float(np.median(np.concatenate([a.max(axis=1) for a in self.apart]))))
        over = [(np.clip(a / scale, 0, 2) ** 8).astype(np.float32) for a in self.apart]
        return over[0] @ self.inside[-1].T + self.inside[0] @ over[-1].T

    def within(self, reach: np.ndarray) -> np.ndarray:
        """The pairs that may be within the chord ``reach`` of the first block's set."""
        out = np.empty((len(reach), len(self.inside[-1])), bool)
        order = np.argsort(reach, kind="stable")
        for k in range(0, len(order), STRIP):
            at = order[k : k + STRIP]
            limit = reach[at] + 2 * SLACK
            over = (self.apart[0][at] > limit[:, None]).astype(np.float32) @ self.inside[-1].T
            over += self.inside[0][at] @ (self.apart[-1] > limit[-1]).astype(np.float32).T
            out[at] = over == 0
        return out


def _nearest_of(p: pd.DataFrame, q: pd.DataFrame, same: bool, n: int) -> pd.DataFrame:
    """(a, b, ab, ba) of pairs among which are those to the ``n`` nearest of ``q`` for every set of ``p``, as far as they are within its reach."""
    if not len(p) or not len(q) or same and len(p) < 2:
        return pd.DataFrame(columns=["a", "b", "ab", "ba"])
    sets_p = _points(p)
    sets_q = sets_p if same else _points(q)
    cells = Cells([sets_p] if same else [sets_p, sets_q])
    square, there = np.full((len(p), len(q)), np.inf), {}
    reach = np.array([3.0 if x is None or np.isnan(x) else _chord(x) for x in p.reach]) if "reach" in p else np.full(len(p), 3.0)
    here = np.full(len(p), 3.0)

    def compare(wanted: np.ndarray) -> None:
        nonlocal here
        i, j, ab, ba = compare_packed(sets_p, sets_q, same, wanted | wanted.T if same else wanted)
        far = np.maximum(ab, ba)
        square[i, j] = far
        if same:
            square[j, i] = far
        there.setdefault("i", []).append(i), there.setdefault("j", []).append(j), there.setdefault("ab", []).append(ab), there.setdefault("ba", []).append(ba)
        if square.shape[1] >= n:
            here = np.minimum(here, np.sqrt(np.partition(square, n - 1, axis=1)[:, n - 1]))

    open_ = cells.within(reach) if (reach < 3.0).any() else np.ones((len(p), len(q)), bool)
    if same:
        np.fill_diagonal(open_, False)
    few = n + 4
    if open_.sum() > 8 * few * len(p):  # those that seem nearest first, for they shorten the reach
        score = np.where(open_, cells.score(), np.float32(np.inf))
        first = np.zeros_like(open_)
        np.put_along_axis(first, np.argpartition(score, few - 1, axis=1)[:, :few], True, axis=1)
        compare(first & open_)
        open_ &= cells.within(np.minimum(reach, here))
    compare(open_ & ~np.isfinite(square))
    i, j, ab, ba = (np.concatenate(there[c]) for c in ("i", "j", "ab", "ba"))
    # ties with the last of the nearest stay
    last = np.partition(square, n - 1, axis=1)[:, n - 1] if square.shape[1] >= n else np.full(len(p), np.inf)
    keep = square[i, j] <= np.maximum(last[i], last[j]) if same else square[i, j] <= last[i]
    i, j, ab, ba = i[keep], j[keep], ab[keep], ba[keep]
    return _ordered(p.id.to_numpy()[i], q.id.to_numpy()[j], ab, ba)


def _ordered(a: np.ndarray, b: np.ndarray, ab: np.ndarray, ba: np.ndarray) -> pd.DataFrame:
    turn = np.asarray(a > b, bool)
    pick = lambda u, v: np.where(turn, v, u)
    return pd.DataFrame({"a": pick(a, b), "b": pick(b, a), "ab": pick(ab, ba), "ba": pick(ba, ab)})


def _in_km(pairs: DataFrame) -> DataFrame:
    km = lambda c: arc_km(F.sqrt(c))
    return pairs.select("a", "b", km("ab").alias("directed_a_to_b_km"), km("ba").alias("directed_b_to_a_km"), km(F.greatest("ab", "ba")).alias("hausdorff_km"))


def core_pairs(sets: Sets, samples: int) -> DataFrame:
    """Distances (a, b, ...) among which are every set's ``samples`` - 1 smallest.

    The nearest sets of its own block bound each set's reach; it visits the other blocks that may have a set within it.
    """
    n, ranges = samples - 1, sets.ranges
    schema = f"a {sets.kind}, b {sets.kind}, ab double, ba double"
    visit = lambda p, q, same: _nearest_of(p, q, same, n)
    nobody = sets.table.sparkSession.createDataFrame([], f"id {sets.kind}, block int, to int")
    first = materialise(_in_km(sets.meet(visit, schema, nobody, bounds=False)))
    nth = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    reach = cluster.mirrored(first).withColumn("nth", nth).where(F.col("nth") == n).select(F.col("i").alias("id"), F.col("d").alias("reach"))
    # blocks whose sets are all within a chord, with enough sets, bound the reach as well
    known = lambda batches: (pdf[["id"]].assign(most=_enough(ranges, np.stack(pdf.f), np.stack(pdf.r), n)) for pdf in batches if len(pdf))
    plain = sets.table.select("id", "f", "r").mapInPandas(known, f"id {sets.kind}, most double")
    reach = materialise(sets.with_extra(plain, reach).select("id", F.least(F.coalesce("reach", "most"), "most").alias("reach")))
    moves = sets.toward(lambda pdf: ranges.low(np.stack(pdf.f)) <= np.array([_chord(x) for x in pdf.reach])[:, None] + SLACK, reach)
    second = materialise(_in_km(sets.meet(visit, schema, moves, reach, own=sets.ranges.names[:0], bounds=False)))
    km = [c for c in first.columns if c.endswith("_km")]
    return first.unionByName(second).groupBy("a", "b").agg(*[F.min(c).alias(c) for c in km])


def _enough(ranges: Ranges, f: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """For each set kilometres within which ``n`` other sets are for sure."""
    high = ranges.high(f, r)
    order = np.argsort(high, axis=1, kind="stable")
    sets = np.cumsum(ranges.n[order], axis=1) > n
    k = np.where(sets.any(axis=1), sets.argmax(axis=1), -1)
    at = np.take_along_axis(high, np.take_along_axis(order, np.maximum(k, 0)[:, None], 1), 1)[:, 0]
    return np.where(k < 0, np.pi * EARTH_KM, arc_of(np.minimum(at, 2.0) ** 2))


def core_distances(sets: Sets, samples: list[int]) -> DataFrame:
    """(ms, i, core) as of the whole matrix."""
    most = max(samples)
    return cluster.core_distances(materialise(core_pairs(sets, max(2, most))), samples)


def linked(sets: Sets, epsilon: float) -> DataFrame:
    """(a, b, compared): few links that join all sets which distances of at most ``epsilon`` join.

    Sets and blocks whose upper bound is within ``epsilon`` are linked unseen, and so are blocks whose first sets are near. What that
    leaves in more than one component is compared, but not two sets that others already join.
    A row without ids has the number of pairs of two blocks that were.
    """
    chord, ranges = _chord(epsilon), sets.ranges
    schema = f"a {sets.kind}, b {sets.kind}, compared long"

    def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own = np.searchsorted(ranges.names, pdf.block)
                near = ranges.high(np.stack(pdf.f), np.stack(pdf.r)) <= chord
                for k, first in enumerate(ranges.first):
                    # of another block one set is enough: all of a block's are in the block's links
                    at = np.flatnonzero(near[:, k])
                    at = np.concatenate([at[own[at] == k], [i[0] for b in np.unique(own[at]) if b != k and len(i := at[own[at] == b])]]).astype(int)
                    yield pd.DataFrame({"a": pd.Series([first] * len(at), dtype=pdf.id.dtype), "b": pdf.id.to_numpy()[at], "compared": 0})

    links = sets.table.drop("x", "y", "z").mapInPandas(unseen, schema)
    if 1 < sets.blocks <= BLOCK_SETS:
        spark, kind = sets.table.sparkSession, sets.kind
        firsts = sets.table.join(F.broadcast(spark.createDataFrame([(i,) for i in ranges.first], f"id {kind}")), "id").select("id", "x", "y", "z")

        def ends(pdf: pd.DataFrame) -> pd.DataFrame:
            points = _points(pdf)
            i, j, ab, ba = compare_packed(points, points, True)
            near = arc_of(np.maximum(ab, ba)) <= epsilon
            found = pd.DataFrame({"a": pdf.id.to_numpy()[i[near]], "b": pdf.id.to_numpy()[j[near]], "compared": 0})
            return pd.concat([found, pd.DataFrame({"a": [None], "b": [None], "compared": [len(i)]})])

        links = links.unionByName(firsts.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(ends, schema))  # one set a block
    links = materialise(links)
    comp = _components(links, sets).select(F.col("i").alias("id"), "component")
    of_blocks = sets.table.select("id", "block").join(comp, "id").groupBy("block").agg(F.min("component").alias("u"), F.max("component").alias("v")).collect()
    one = {r["block"]: r["u"] if r["u"] == r["v"] else None for r in of_blocks}
    whole = [one[int(b)] for b in ranges.names]

    def goes(pdf: pd.DataFrame) -> np.ndarray:
        new = np.array([[w is None or c != w for w in whole] for c in pdf.component.to_numpy()], bool).reshape(len(pdf), len(whole))
        return new & (ranges.low(np.stack(pdf.f)) <= chord + SLACK)

    def visit(p: pd.DataFrame, q: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=["a", "b", "compared"])
        both = p if same else pd.concat([p, q], ignore_index=True)
        shift = 0 if same else len(p)
        ids, points = both.id.to_numpy(), _points(both)
        label, names = pd.factorize(both.component)
        label = np.array([np.flatnonzero(label == k)[0] for k in range(len(names))])[label]
        start = label.copy()

        def join(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal label
            while len(i):
                a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                np.minimum.at(label, b, a)
                label = roots(label)
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]

        # pairs of the largest component with itself are no question
        main = np.bincount(label).argmax()
        left, right = np.arange(len(p)), shift + np.arange(len(q))
        mine, other = left[label[left] != main], right[label[right] != main]
        parts = [(mine, right), (left[label[left] == main], other)]
        i, j, low = [], [], []
        for u, v in parts:
            if len(u) and len(v):
                near, far = lower(both.iloc[u], both.iloc[v]), upper(both.iloc[u], both.iloc[v])
                x, y = np.nonzero(far <= chord)
                join(u[x], v[y])
                x, y = np.nonzero((near <= chord + SLACK) & (far > chord))
                i.append(u[x]), j.append(v[y]), low.append(near[x, y])
        compared = 0
        i, j, low = (np.concatenate(c) if c else np.zeros(0, int) for c in (i, j, low))
        order = np.argsort(low, kind="stable")
        i, j = i[order], j[order]
        while True:
            a, b = label[i], label[j]
            go = a != b
            i, j, a, b = i[go], j[go], a[go], b[go]
            if not len(i):
                break
            # of every two components the pair with the least bound
            first = np.sort(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)[1])
            found = np.array([max(x[0] for x in compare_packed([points[s]], [points[t]], False)[2:]) for s, t in zip(i[first], j[first])])
            compared += len(first)
            near = arc_of(found) <= epsilon
            join(i[first][near], j[first][near])
            rest = np.ones(len(i), bool)
            rest[first] = False
            i, j = i[rest], j[rest]
        loose = np.flatnonzero(label != start)
        out = pd.DataFrame({"a": ids[label[loose]], "b": ids[loose], "compared": 0})
        return pd.concat([out, pd.DataFrame({"a": [None], "b": [None], "compared": [compared]})])

    mixed = np.array([b for b, w in zip(ranges.names, whole) if w is None], np.int32)
    return links.unionByName(sets.meet(visit, schema, sets.toward(goes, comp), comp, own=mixed, mutual=True))


def _components(links: DataFrame, sets: Sets) -> DataFrame:
    pairs = links.where("a IS NOT NULL AND a <> b").select("a", "b", F.lit(0.0).alias("hausdorff_km"))
    return cluster.linkage_cut(materialise(pairs), sets.table.select(F.col("id").alias("i")), 0.0)


def linkage_cut(sets: Sets, epsilon: float) -> DataFrame:
    """(i, component) as of the whole matrix: the smallest id that distances of at most ``epsilon`` reach."""
    return _components(linked(sets, epsilon), sets)


def far_pairs(sets: Sets, n: int) -> DataFrame:
    """Distances (a, b, ...) among which are the ``n`` largest, equal ones by id.

    A set is at least as far from a whole block as their ranges are apart, which gives a floor for the n-th distance; sets
    go to the blocks that they may be as far from, and each block gives its n farthest pairs.
    """
    ranges = sets.ranges

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                low = ranges.low(np.stack(pdf.f))
                at = low.argmax(axis=1)
                yield pd.DataFrame({"low": low[np.arange(len(low)), at], "pairs": ranges.n[at] - (ranges.names[at] == pdf.block)})

    # a pair may be counted from both of its sets
    best = sets.table.select("block", "f").mapInPandas(floors, "low double, pairs long").orderBy(F.desc("low")).limit(2 * n).collect()
    enough = np.flatnonzero(np.cumsum([r["pairs"] for r in best]) >= 2 * n)
    floor = max(0.0, best[enough[0]]["low"]) if len(enough) else 0.0

    def visit(p: pd.DataFrame, q: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=["a", "b", "ab", "ba"])
        i, j, ab, ba = compare_packed(_points(p), _points(q), same, upper(p, q) >= floor)
        found = _ordered(p.id.to_numpy()[i], q.id.to_numpy()[j], ab, ba)
        return found.assign(far=np.maximum(ab, ba)).sort_values(["far", "a", "b"], ascending=[False, True, True])[: n][["a", "b", "ab", "ba"]]

    moves = sets.toward(lambda pdf: ranges.high(np.stack(pdf.f), np.stack(pdf.r)) >= floor)
    k = ranges.far.shape[1]
    inside = ranges.names[(ranges.far + ranges.most[:, :k]).max(axis=1, initial=-np.inf) + SLACK >= floor] if sets.blocks else ranges.names
    return _in_km(sets.meet(visit, f"a {sets.kind}, b {sets.kind}, ab double, ba double", moves, own=inside, mutual=True))


def top_pairs(sets: Sets, n: int = 10) -> DataFrame:
    """The ``n`` farthest pairs with their rank, as of the whole matrix."""
    return top_of(far_pairs(sets, n), n)


def medoids(sets: Sets, labels: DataFrame) -> DataFrame:
    """The clusters' medoids (i, label) as of the whole matrix: tasks give sums of distances, only those to medoids become rows."""
    members = labels.where("label >= 0").select("i", "label")

    def sums(p: pd.DataFrame, q: pd.DataFrame, i: np.ndarray, j: np.ndarray, ab: np.ndarray, ba: np.ndarray) -> pd.DataFrame:
        d, out = arc_of(np.maximum(ab, ba)), []
        for u, at in ((p, i), (q, j)):
            n = np.bincount(at, minlength=len(u))
            whole = (n > 0) & u.candidate.notna().to_numpy()
            out.append(pd.DataFrame({"i": u.id.to_numpy()[whole], "label": u.label.to_numpy()[whole].astype("int64"), "total": np.bincount(at, d, len(u))[whole], "n": n[whole]}))
        return pd.concat(out)

    found, candidates = _with_candidates(sets, labels, sums, f"i {sets.kind}, label long, total double, n long")
    own = candidates.select(F.col("id").alias("i"), "label", F.lit(0.0).alias("total"), F.lit(1).cast("long").alias("n"))
    totals = found.unionByName(own).groupBy("label", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    totals = totals.join(members.groupBy("label").agg(F.count("*").alias("n")), ["label", "n"])
    best = totals.groupBy("label").agg(F.min(F.struct(F.round("total", 9).alias("total"), "i", "n")).alias("m")).select("label", F.col("m.i").alias("medoid"), F.col("m.n").alias("flights"))
    best = materialise(best)
    near = of_pairs(sets, members.join(best, "label").select(F.col("i").alias("id"), F.col("medoid").alias("other"), "label"), "label long").select("label", "hausdorff_km")
    return best.join(near.groupBy("label").agg(F.median("hausdorff_km").alias("median_distance_to_medoid_km"), F.max("hausdorff_km").alias("max_distance_to_medoid_km")), "label")


def to_centres(sets: Sets, ids: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b, hausdorff_km) of every id (i) and every medoid of ``centres``."""
    pairs = ids.select(F.col("i").alias("id")).crossJoin(F.broadcast(centres.select(F.col("medoid").alias("other")))).where("id <> other")
    found = of_pairs(sets, pairs)
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "hausdorff_km").distinct()


def of_pairs(sets: Sets, pairs: DataFrame, more: str = "") -> DataFrame:
    """``pairs`` (id, other, ...) of which few others have many ids, with ``hausdorff_km``, exactly; ``more`` is the schema of other columns."""
    points = sets.table.select("id", "x", "y", "z")
    ends = points.join(pairs.select(F.col("other").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    both = pairs.join(points, "id").join(ends, "other")
    kept = ["id", "other", *[c for c in pairs.columns if c not in ("id", "other")]]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                others = _points(pdf[["ox", "oy", "oz"]].set_axis([*"xyz"], axis=1))
                c2 = [max(float(v[0]) for v in compare_packed([p], [q], False)[2:]) for p, q in zip(_points(pdf), others)]
                yield pdf[kept].assign(c2=c2)

    out = both.mapInPandas(measure, f"id {sets.kind}, other {sets.kind}, {more + ', ' if more else ''}c2 double")
    return out.withColumn("hausdorff_km", arc_km(F.sqrt("c2"))).drop("c2")


def medoid_pairs(sets: Sets, labels: DataFrame) -> DataFrame:
    """Distances (a, b, ...) from every set that can be its cluster's medoid to all others of the cluster (i, label)."""
    pairs = lambda p, q, i, j, ab, ba: _ordered(p.id.to_numpy()[i], q.id.to_numpy()[j], ab, ba)
    return _in_km(_with_candidates(sets, labels, pairs, f"a {sets.kind}, b {sets.kind}, ab double, ba double")[0])


def _with_candidates(sets: Sets, labels: DataFrame, make: Callable[..., pd.DataFrame], schema: str) -> tuple[DataFrame, DataFrame]:
    """What ``make`` makes of the distances between sets that can be their cluster's medoid and all others of the cluster, and the former (id, label).

    A set can't be if the sum of its lower bounds is above the least sum of upper bounds; a block's ranges bound all its sets at once.
    """
    ranges = sets.ranges
    of = materialise(labels.where("label >= 0").select(F.col("i").alias("id"), "label"))

    def per_block(rows: DataFrame) -> dict[int, np.ndarray]:
        """The number of sets of each label in every block."""
        out: dict[int, np.ndarray] = {}
        for r in sets.table.select("id", "block").join(rows, "id").groupBy("block", "label").count().collect():
            out.setdefault(r["label"], np.zeros(len(ranges.names)))[np.searchsorted(ranges.names, r["block"])] = r["count"]
        return out

    members = per_block(of)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arc = lambda c: 2 * np.arcsin(np.clip(c, 0, 2) / 2)
        for pdf in batches:
            if len(pdf):
                weight = np.stack([members[k] for k in pdf.label])
                weight[np.arange(len(pdf)), np.searchsorted(ranges.names, pdf.block)] -= 1
                f = np.stack(pdf.f)
                low, high = arc(ranges.low(f)), arc(ranges.high(f, np.stack(pdf.r)))
                yield pdf[["id", "label"]].assign(low=(low * weight).sum(axis=1), high=(high * weight).sum(axis=1))

    bounds = sets.table.select("id", "block", "f", "r").join(of, "id").mapInPandas(sums, f"id {sets.kind}, label long, low double, high double")
    least = F.min("high").over(Window.partitionBy("label"))
    candidates = materialise(bounds.withColumn("least", least).where(F.col("low") <= F.col("least") * (1 + 1e-9) + 1e-9).select("id", "label"))
    chosen = per_block(candidates)
    marked = materialise(of.join(candidates.select("id", F.lit(True).alias("candidate")), "id", "left"))
    nowhere = np.zeros(len(ranges.names))

    def goes(pdf: pd.DataFrame) -> np.ndarray:
        all_of, some_of = (np.stack([w.get(k, nowhere) for k in pdf.label.fillna(-1)]) > 0 for w in (members, chosen))
        return np.where(pdf.candidate.notna().to_numpy()[:, None], all_of, some_of)

    def visit(p: pd.DataFrame, q: pd.DataFrame, same: bool) -> pd.DataFrame:
        p, q = (v[v.label.notna()].reset_index(drop=True) for v in (p, q))
        if not len(p) or not len(q):
            return make(p, q, *[np.zeros(0, int)] * 2, *[np.zeros(0)] * 2)
        yes = lambda v: v.candidate.notna().to_numpy()
        wanted = np.equal.outer(p.label.to_numpy(float), q.label.to_numpy(float)) & np.logical_or.outer(yes(p), yes(q))
        return make(p, q, *compare_packed(_points(p), _points(q), same, wanted))

    return sets.meet(visit, schema, sets.toward(goes, marked), marked, bounds=False, mutual=True), candidates

"""Exact spherical Hausdorff distances between point sets, their statistics and their witness points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import arc_km, unit_sphere
from wayline.operators.common import materialise
from wayline.operators.quantiles import exact_quantiles
from wayline.operators.spatial import Leaves, directed_leaves, long_pairs

#: Points of a block, and of a block of long sets, whose indexes are worth more pairs; a task compares two blocks.
BLOCK_POINTS, LONG_BLOCK_POINTS = 32_768, 65_536
#: Chords that are made at a time, and squared chords so short that products of unit vectors don't tell them apart.
CACHED, CLOSE = 80_000, 1e-10
#: Tasks that pairs of blocks are dealt to at most.
MOST_TASKS = 10_000
#: Sets with more points are compared one pair at a time, through an index of each.
LONG = 1_024
#: Sets with more points are cut to pieces, and no task holds such a set.
SET_POINTS = 131_072


def _nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared chords of every row of ``a`` and every row of ``b``, from differences: exact also for close points."""
    out = np.subtract.outer(a[:, 0], b[:, 0])
    out *= out
    for k in (1, 2):
        d = np.subtract.outer(a[:, k], b[:, k])
        d *= d
        out += d
    return out


def nearest(a: np.ndarray, b: np.ndarray, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The squared chord from every point of ``a`` to its nearest in ``b``, and the first such point."""
    c2, at = np.empty(len(a)), np.empty(len(a), np.int64)
    for k in range(0, len(a), chunk):
        near = _nearest(a[k : k + chunk], b)
        at[k : k + chunk] = near.argmin(axis=1)
        c2[k : k + chunk] = near.min(axis=1)
    return c2, at


def directed(a: np.ndarray, b: np.ndarray) -> float:
    """Largest squared chord from a point of ``a`` to its nearest in ``b``."""
    return directed_leaves(Leaves(a), Leaves(b)) if len(b) > LONG else float(nearest(a, b)[0].max())


class Packed:
    """Sets end to end, so that any few of them are one array: short ones are filled with repeats of their last point."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.points = np.concatenate(sets) if sets else np.zeros((0, 3))

    def few(self, at: np.ndarray) -> np.ndarray:
        size = self.sizes[at]
        return self.points[self.starts[at][:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)]

    def flat(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All points of the sets ``at`` and where each of these sets starts."""
        size = self.sizes[at]
        start = np.cumsum(size) - size
        return self.points[np.repeat(self.starts[at] - start, size) + np.arange(size.sum())], start


def _short(a: np.ndarray, packed: Packed, at: np.ndarray, chunks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Squared directed chords between the set ``a`` and each of the sets ``at``, there and back.

    Products of unit vectors, of a few sets at a time, find the farthest points, whose chords are then taken from differences.
    Where those are so short that the products don't tell points apart, all chords are.
    """
    mine, other = np.zeros(len(packed.sizes), np.int64), np.zeros((len(packed.sizes), 3))
    for few, q in chunks:
        near = (a @ q.reshape(-1, 3).T).reshape(len(a), *q.shape[:2])
        mine[few] = near.max(axis=2).argmin(axis=0)
        other[few] = q[np.arange(len(q)), near.max(axis=0).argmin(axis=1)]
    points, start = packed.flat(at)
    d = points - a[np.repeat(mine[at], packed.sizes[at])]
    d *= d
    there = np.minimum.reduceat(d[:, 0] + d[:, 1] + d[:, 2], start)
    back = _nearest(a, other[at]).min(axis=0)
    for k in np.flatnonzero(np.minimum(there, back) < CLOSE):
        c2 = _nearest(a, packed.few(at[k : k + 1])[0])
        there[k], back[k] = c2.min(axis=1).max(), c2.min(axis=0).max()
    return there, back


def compare_packed(left: list[np.ndarray], right: list[np.ndarray], same: bool, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of left and right sets and the squared chords left to right and right to left of all pairs, or the ``wanted``; of one block, each pair once.

    A set meets few others at a time, of about one size, whose chords stay in a core's cache.
    """
    out: list[tuple] = []
    held: list[dict[int, Leaves]] = [{}, {}]
    packed = Packed(right)
    short = packed.sizes <= LONG
    order = np.argsort(packed.sizes, kind="stable")
    order = order[short[order]]
    place = np.full(len(right), -1)
    place[order] = np.arange(len(order))
    largest = max((len(a) for a in left if len(a) <= LONG), default=0)

    def cut(at: np.ndarray) -> list[np.ndarray]:
        few = max(1, CACHED // max(1, largest * int(packed.sizes[at[-1]]))) if len(at) else 1
        return [at[k : k + few] for k in range(0, len(at), few)]

    chunks = [(few, packed.few(few)) for few in cut(order)] if wanted is None else []
    width = len(chunks[0][0]) if chunks else 1

    def index(side: int, k: int) -> Leaves:
        at = held[0 if same else side]
        if k not in at:
            at[k] = Leaves((left, right)[side][k])
        return at[k]

    def add(i: int, j: np.ndarray, there: np.ndarray, back: np.ndarray) -> None:
        i = np.full(len(j), i)
        turn = (i > j) & same
        out.append((np.where(turn, j, i), np.where(turn, i, j), np.where(turn, back, there), np.where(turn, there, back)))

    for i, a in enumerate(left):
        of = np.arange(len(right)) if wanted is None else np.flatnonzero(wanted[i])
        if same:
            of = of[of > i]
        for j in (of if len(a) > LONG else of[~short[of]]).tolist():
            p, q = index(0, i), index(1, j)
            add(i, np.array([j]), np.array([directed_leaves(p, q)]), np.array([directed_leaves(q, p)]))
        if len(a) > LONG:
            continue
        if wanted is None:  # of one block each set meets those behind it by size
            first = place[i] + 1 if same else 0
            at, met = order[first:], chunks[first // width :]
        else:
            at = of[short[of]]
            at = at[np.argsort(packed.sizes[at], kind="stable")]
            met = [(few, packed.few(few)) for few in cut(at)]
        if len(at):
            add(i, at, *_short(a, packed, at, met))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), np.zeros(0)
    i, j, there, back = (np.concatenate(c) for c in zip(*out))
    return i, j, there, back


def compare_blocks(left: list[np.ndarray], right: list[np.ndarray], same: bool, wanted: np.ndarray | None = None) -> list[tuple[int, int, float, float]]:
    """(left set, right set, squared chord left to right, right to left) of all pairs, or the ``wanted``; of one block, each pair once."""
    return list(zip(*(c.tolist() for c in compare_packed(left, right, same, wanted))))


def distance_matrix(points: DataFrame, id_col: str = "flight_id", lat: str = "lat", lon: str = "lon", block_points: int | None = None, set_points: int = SET_POINTS, fresh: DataFrame | None = None) -> DataFrame:
    """The upper triangle (a < b) of directed and symmetric Hausdorff distances in km between the sets of ``id_col``.

    Sets are packed to one row each and dealt to blocks of about ``block_points`` points; each pair
    of blocks is one task, so a set is sent once a block and no pair of points is ever a row. Sets of
    over ``set_points`` points are compared piece by piece, with each other and with the rest. Rows
    with a null id or coordinate are left out; repeated points change nothing. With ``fresh`` (the id column) only pairs
    with one of these ids are compared: they have blocks of their own, and other blocks never meet each other.
    """
    x, y, z = unit_sphere(F.col(lat), F.col(lon))
    id_type = dict(points.dtypes)[id_col]
    rows = points.where(F.col(id_col).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(id_col).alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    if fresh is not None:
        new_ids = materialise(fresh.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()).withColumn("new", F.lit(True))
        mark = lambda df: df.join(new_ids, "id", "left")
    else:
        mark = lambda df: df.withColumn("new", F.lit(True))
    size = mark(sizes).agg(F.sum("n"), F.max("n"), F.sum(F.when(F.col("new"), F.col("n"))), F.avg("n")).first()
    block_points = block_points or (LONG_BLOCK_POINTS if (size[3] or 0) > LONG else BLOCK_POINTS)
    blocks = max(6, -(-(size[0] or 0) // block_points))
    of_new = blocks if fresh is None else max(1, -(-(size[2] or 0) // block_points))
    km = lambda c: arc_km(F.sqrt(c))
    result = lambda pairs: pairs.select("a", "b", km("ab").alias("directed_a_to_b_km"), km("ba").alias("directed_b_to_a_km"), km(F.greatest("ab", "ba")).alias("hausdorff_km"))
    long = None
    if (size[1] or 0) > set_points:
        ids = materialise(sizes.where(F.col("n") > set_points).select("id"))
        long = long_pairs(rows, ids, blocks)
        if fresh is not None:
            one = lambda c: new_ids.select(F.col("id").alias(c), F.lit(True).alias(f"new_{c}"))
            long = long.join(one("a"), "a", "left").join(one("b"), "b", "left").where("new_a OR new_b").select("a", "b", "ab", "ba")
        rows = rows.join(ids, "id", "left_anti")
    packed = rows.groupBy("id").agg(F.collect_list(F.struct("x", "y", "z")).alias("p")).select("id", "p.x", "p.y", "p.z")
    new, h = F.col("new").isNotNull(), F.xxhash64("id")
    others = max(1, blocks - of_new)
    own = F.when(new, F.pmod(h, F.lit(of_new))).otherwise(of_new + F.pmod(h, F.lit(others))).cast("int")
    last = F.when(new, of_new - 1 if fresh is None else of_new + others - 1).otherwise(of_new - 1)
    placed = mark(packed).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    placed = placed.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "new")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        pdf = pdf.sort_values("id")
        sets = lambda part: [np.stack([np.asarray(v, float) for v in (r.x, r.y, r.z)], axis=1) for r in part.itertuples()]
        p, q = pdf[pdf.own == low], pdf[pdf.own == high]
        i, j, there, back = compare_packed(sets(p), sets(q), low == high)
        a, b = p.id.to_numpy()[i], q.id.to_numpy()[j]
        turn = np.asarray(a > b, bool)
        pick = lambda u, v: np.where(turn, v, u)
        return pd.DataFrame({"a": pick(a, b), "b": pick(b, a), "ab": pick(there, back), "ba": pick(back, there)})

    # a task's work grows with its pairs, not with its bytes, by which Spark would join small partitions
    tasks = min(MOST_TASKS, blocks * (blocks + 1) // 2)
    pairs = placed.repartition(tasks, "low", "high").groupBy("low", "high").applyInPandas(compare, f"a {id_type}, b {id_type}, ab double, ba double")
    return result(pairs if long is None else pairs.unionByName(long))


def dense_hausdorff(a: DataFrame, b: DataFrame, keys: list[str], block_points: int = BLOCK_POINTS) -> DataFrame:
    """(keys, directed_ab_km, directed_ba_km, hausdorff_km) of sets a and b with equal, non-null keys.

    For two versions of each of many sets. Sets of up to ``block_points`` points meet in one task and
    come back as two numbers; larger ones meet block by block, each point with its nearest of the
    other block, and the least over the blocks counts. Keys that only one side has give no row.
    """
    point = lambda df, side: df.select(*keys, *[c.alias(k) for k, c in zip("xyz", unit_sphere(F.col("lat"), F.col("lon")))]).dropna().distinct().withColumn("side", F.lit(side))
    both = point(a, 0).unionByName(point(b, 1))
    blocks = lambda side: F.ceil(F.count_if(F.col("side") == side) / block_points).cast("int")
    counts = both.groupBy(*keys).agg(blocks(0).alias("na"), blocks(1).alias("nb")).where("na > 0 AND nb > 0")
    first = F.col("side") == 0
    own = F.pmod(F.xxhash64(*"xyz"), F.when(first, F.col("na")).otherwise(F.col("nb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(first, F.col("nb")).otherwise(F.col("na")) - 1))
    placed = both.join(counts, keys).withColumn("own", own).withColumn("other", other)
    placed = placed.select(*keys, "side", *"xyz", F.when(first, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("j"), ((F.col("na") == 1) & (F.col("nb") == 1)).alias("whole"))
    kinds = dict(placed.dtypes)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf.loc[pdf.side == k, [*"xyz"]].to_numpy() for k in (0, 1)]
        out = []
        for k, (p, q) in enumerate((sides, sides[::-1])):
            if pdf.whole.iloc[0]:
                out.append(pd.DataFrame({"side": [k], "x": 0.0, "y": 0.0, "z": 0.0, "c2": directed(p, q)}))
            elif len(p) and len(q):
                out.append(pd.DataFrame({"side": k, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "c2": nearest(p, q)[0]}))
        found = pd.concat(out) if out else pd.DataFrame(columns=["side", *"xyz", "c2"])
        return found.assign(**{c: pdf[c].iloc[0] for c in keys})[[*keys, "side", *"xyz", "c2"]]

    near = placed.groupBy(*keys, "i", "j").applyInPandas(compare, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", side int, x double, y double, z double, c2 double")
    far = near.groupBy(*keys, "side", *"xyz").agg(F.min("c2").alias("c2")).groupBy(*keys).agg(*[F.max(F.when(F.col("side") == k, F.col("c2"))).alias(n) for k, n in ((0, "ab"), (1, "ba"))])
    km = lambda c: arc_km(F.sqrt(c))
    return far.select(*keys, km("ab").alias("directed_ab_km"), km("ba").alias("directed_ba_km"), km(F.greatest("ab", "ba")).alias("hausdorff_km"))


def pair_statistics(matrix: DataFrame) -> DataFrame:
    """One row: number, minimum, median, 95th percentile and maximum of the distances, zeros for no pair.

    Quantiles are exact, between the two ranks around them, and no task holds or sorts all distances.
    """
    d = F.col("hausdorff_km")
    whole = matrix.agg(F.count("*").alias("pairs"), F.min(d).alias("min_km"), F.max(d).alias("max_km"))
    middle = exact_quantiles(matrix, [], {"median_km": ("hausdorff_km", 0.5), "p95_km": ("hausdorff_km", 0.95)})
    # one row each
    both = whole.withColumn("one", F.lit(1)).join(middle.withColumn("one", F.lit(1)), "one", "left")
    return both.select("pairs", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("min_km", "median_km", "p95_km", "max_km")])


def top_pairs(matrix: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` farthest pairs with their rank from 1; equal distances go by id."""
    best = matrix.orderBy(F.desc("hausdorff_km"), "a", "b").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hausdorff_km"), "a", "b")))  # n rows


def appearances(pairs: DataFrame) -> DataFrame:
    """How many of the pairs each id is in."""
    ids = pairs.select(F.col("a").alias("flight_id")).unionByName(pairs.select(F.col("b").alias("flight_id")))
    return ids.groupBy("flight_id").agg(F.count("*").alias("top_pair_appearances"))


def witnesses(pairs: DataFrame, points: DataFrame, order: str = "t") -> DataFrame:
    """The points that make the distance of each of a few pairs (a, b); the two sets of a pair meet in one task.

    Points of a set are numbered from 0 by ``order``, whose values come back as source_t and target_t. The direction with the larger directed distance
    counts, a to b on ties; its source is the first point with the largest distance to its nearest
    target, the target the first nearest.
    """
    wanted = pairs.select("a", "b").distinct()
    ids = wanted.select(F.col("a").alias("flight_id")).unionByName(wanted.select(F.col("b").alias("flight_id"))).distinct()
    rank = F.row_number().over(Window.partitionBy("flight_id").orderBy(order, "lat", "lon")) - 1
    sphere = dict(zip("xyz", unit_sphere(F.col("lat"), F.col("lon"))))
    p = points.join(ids, "flight_id", "left_semi").withColumn("idx", rank).select("flight_id", "idx", F.col(order).cast("double").alias("t"), "lat", "lon", *[c.alias(k) for k, c in sphere.items()])
    side = lambda n, k: wanted.join(p.withColumnRenamed("flight_id", n), n).withColumn("side", F.lit(k)).select("a", "b", "side", *p.columns[1:])
    kinds = dict(wanted.dtypes)
    place = [f"{s}_{c}" for s in ("source", "target") for c in ("index", "t", "lat", "lon")]

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf.side == k].sort_values("idx") for k in (0, 1)]
        if not all(map(len, sides)):
            return pd.DataFrame(columns=["a", "b", "ab", "ba", *place])
        out = []
        for s, t in (sides, sides[::-1]):
            c2, at = nearest(s[[*"xyz"]].to_numpy(), t[[*"xyz"]].to_numpy())
            k = int(c2.argmax())
            out.append((float(c2[k]), *(x for row in (s.iloc[k], t.iloc[at[k]]) for x in (row.idx, row.t, row.lat, row.lon))))
        best = out[0] if out[0][0] >= out[1][0] else out[1]
        return pd.DataFrame([(pdf.a.iloc[0], pdf.b.iloc[0], out[0][0], out[1][0], *best[1:])], columns=["a", "b", "ab", "ba", *place])

    schema = f"a {kinds['a']}, b {kinds['b']}, ab double, ba double, " + ", ".join(f"{c} {'int' if c.endswith('index') else 'double'}" for c in place)
    found = side("a", 0).unionByName(side("b", 1)).groupBy("a", "b").applyInPandas(find, schema)
    km = lambda c: arc_km(F.sqrt(c))
    return found.select(F.col("a").alias("flight_a"), F.col("b").alias("flight_b"), km("ab").alias("directed_a_to_b_km"), km("ba").alias("directed_b_to_a_km"), F.when(F.col("ab") >= F.col("ba"), "a_to_b").otherwise("b_to_a").alias("direction"), km(F.greatest("ab", "ba")).alias("hausdorff_km"), *place)


def matrix_violations(matrix: DataFrame, ids: int) -> DataFrame:
    """One row of counts that are 0 for a sound upper triangle: missing pairs, repeats, wrong order, and bad distances."""
    d = F.col("hausdorff_km")
    bad = d.isNull() | F.isnan(d) | (d < 0) | (d == F.lit(float("inf")))
    return matrix.agg((F.lit(ids * (ids - 1) // 2) - F.count("*")).alias("missing_pairs"), (F.count("*") - F.count_distinct("a", "b")).alias("repeated_pairs"), F.count_if(F.col("a") >= F.col("b")).alias("unordered_pairs"), F.count_if(bad).alias("bad_distances"), F.count_if(F.abs(d - F.greatest("directed_a_to_b_km", "directed_b_to_a_km")) > 1e-9).alias("asymmetric"))


def require_sound(matrix: DataFrame, ids: int) -> DataFrame:
    """``matrix``, if :func:`matrix_violations` finds nothing; else an error that names what it found."""
    bad = {k: v for k, v in matrix_violations(matrix, ids).first().asDict().items() if v}
    if bad:
        raise ValueError(f"unsound distance matrix: {bad}")
    return matrix

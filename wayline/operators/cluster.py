"""Density-based clustering of a long distance matrix, parameter sweeps, medoids and outlier ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.common import materialise
from wayline.operators.condense import LEAST_KM, condensed_labels
from wayline.operators.forest import forest_edges

SIZES, SAMPLES = (5, 10, 15, 20, 30), (5, 10, 15)
#: Ids whose core distances are broadcast at most, a few dozen bytes each.
BROADCAST_IDS = 500_000
#: Trees of up to so many edges are condensed in one task each; larger ones by joins.
TREE_EDGES = 1_000_000


def mirrored(matrix: DataFrame) -> DataFrame:
    """(i, j, d) in both directions, of a matrix (a, b, hausdorff_km)."""
    one = lambda x, y: matrix.select(F.col(x).alias("i"), F.col(y).alias("j"), F.col("hausdorff_km").alias("d"))
    return one("a", "b").unionByName(one("b", "a"))


def core_distances(matrix: DataFrame, samples: list[int]) -> DataFrame:
    """(ms, i, core): the ``ms``-th smallest distance of each id, its own 0 counted as the first."""
    nth = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    asked = F.array(*[F.lit(s) for s in samples if s > 1])
    # the bound on the number lets Spark drop all farther rows before the shuffle
    least = mirrored(matrix).withColumn("nth", nth).where(F.col("nth") < max(samples))
    near = least.withColumn("ms", F.col("nth") + 1).where(F.array_contains(asked, F.col("ms"))).select("ms", "i", F.col("d").alias("core"))
    if 1 in samples:
        near = near.unionByName(mirrored(matrix).select(F.lit(1).alias("ms"), "i", F.lit(0.0).alias("core")).distinct())
    return near


def mutual_reachability(matrix: DataFrame, core: DataFrame) -> DataFrame:
    """(ms, i, j, w) with i < j: the largest of the distance and the two core distances."""
    core = materialise(core)
    small = F.broadcast(core) if core.count() <= BROADCAST_IDS else core
    side = lambda n: small.select("ms", F.col("i").alias(n), F.col("core").alias(f"core_{n}"))
    pairs = matrix.select(F.col("a").alias("i"), F.col("b").alias("j"), "hausdorff_km")
    return pairs.join(side("i"), "i").join(side("j"), ["ms", "j"]).select("ms", "i", "j", F.greatest("hausdorff_km", "core_i", "core_j").alias("w"))


def spanning_edges(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of (ms, i, j, w) for every ``ms``, unique under the order (w, i, j).

    Every task first keeps only the forest of its own edges, so some (number of nodes) x (partitions) edges are
    shuffled, not all pairs. If more are left than a task may hold, Borůvka's rounds follow: each component takes its least
    edge to another one, which at least halves their number; the components that the taken edges join are found by
    pointer jumping.
    """
    edges, done = forest_edges(edges)
    if done:
        return edges
    nodes = edges.select("ms", F.col("i").alias("node")).unionByName(edges.select("ms", F.col("j").alias("node"))).distinct()
    labels = materialise(nodes.withColumn("comp", F.col("node")))
    taken = None
    while True:
        side = lambda n: labels.select("ms", F.col("node").alias(n), F.col("comp").alias(f"c_{n}"))  # noqa: B023, E731
        open_edges = materialise(edges.join(side("i"), ["ms", "i"]).join(side("j"), ["ms", "j"]).where("c_i <> c_j"))
        edges = open_edges.drop("c_i", "c_j")
        out = lambda x, y: open_edges.select("ms", F.col(x).alias("comp"), F.struct("w", "i", "j").alias("e"), F.col(y).alias("to"))  # noqa: B023, E731
        least = materialise(out("c_i", "c_j").unionByName(out("c_j", "c_i")).groupBy("ms", "comp").agg(F.min(F.struct("e", "to")).alias("m")).select("ms", "comp", "m.to", "m.e.*"))
        if not least.take(1):
            return taken if taken is not None else edges.limit(0)
        new = least.select("ms", "i", "j", "w").distinct()
        taken = materialise(taken.unionByName(new) if taken is not None else new)
        # two components that take the same edge point at each other; the smaller one is the root
        back = least.select("ms", F.col("comp").alias("to"), F.col("to").alias("back"))
        root = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to"))
        parent = materialise(least.join(back, ["ms", "to"]).select("ms", "comp", F.when(root, F.col("comp")).otherwise(F.col("to")).alias("to")))
        while True:
            up = parent.select("ms", F.col("comp").alias("to"), F.col("to").alias("up"))
            jumped = materialise(parent.join(up, ["ms", "to"]).select("ms", "comp", F.col("up").alias("to")))
            moved = jumped.join(parent.withColumnRenamed("to", "old"), ["ms", "comp"]).where("to <> old").take(1)
            parent = jumped
            if not moved:
                break
        labels = materialise(labels.join(parent, ["ms", "comp"], "left").select("ms", "node", F.coalesce("to", "comp").alias("comp")))


def condense(edges: np.ndarray, n: int, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(cluster label or -1, membership strength) of points 0..n-1.

    ``edges`` (i, j, weight) is a spanning tree in ascending order. A split counts when both sides
    have ``min_size`` points; else points leave their cluster at 1 / weight. The clusters with the
    largest excess of mass are chosen from the leaves up; the root never is.
    """
    left, right, height, size = [], [], [], [1] * n
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, j, w in edges:
        a, b = find(int(i)), find(int(j))
        top.append(len(top))
        top[a] = top[b] = len(top) - 1
        left.append(a)
        right.append(b)
        height.append(1.0 / max(w, LEAST_KM))
        size.append(size[a] + size[b])
    parent, birth, deaths, mass, leaves_at, owner = [-1], [0.0], [0.0], [0.0], np.zeros(n), np.zeros(n, np.int64)
    children: list[list[int]] = [[]]
    todo = [(len(size) - 1, 0)] if len(size) > n else []
    while todo:
        node, cluster = todo.pop()
        if node < n:
            continue
        a, b, at = left[node - n], right[node - n], height[node - n]
        if size[a] >= min_size and size[b] >= min_size:
            for side in (a, b):
                parent.append(cluster)
                birth.append(at)
                deaths.append(at)
                mass.append(0.0)
                children.append([])
                children[cluster].append(len(parent) - 1)
                mass[cluster] += (at - birth[cluster]) * size[side]
                todo.append((side, len(parent) - 1))
            deaths[cluster] = max(deaths[cluster], at)
            continue
        for side in (a, b):
            if size[side] >= min_size:
                todo.append((side, cluster))
                continue
            falling = [side]
            while falling:
                x = falling.pop()
                if x >= n:
                    falling += [left[x - n], right[x - n]]
                else:
                    leaves_at[x], owner[x] = at, cluster
                    mass[cluster] += at - birth[cluster]
                    deaths[cluster] = max(deaths[cluster], at)
    chosen = [False] * len(parent)
    best = list(mass)
    for c in range(len(parent) - 1, 0, -1):
        below = sum(best[k] for k in children[c])
        if children[c] and below > mass[c]:
            best[c] = below
        else:
            chosen[c] = True
    label, of = {}, [-1] * len(parent)
    for c in range(1, len(parent)):
        above = of[parent[c]]
        of[c] = above if above >= 0 else label.setdefault(c, c) if chosen[c] else -1
    number = {c: k for k, c in enumerate(sorted(set(of) - {-1}))}
    labels = np.array([number[of[o]] if of[o] >= 0 else -1 for o in owner], np.int64)
    strength = np.array([min(v, deaths[of[o]]) / deaths[of[o]] if of[o] >= 0 and deaths[of[o]] > 0 else 0.0 for v, o in zip(leaves_at, owner)])
    return labels, strength


def hdbscan(matrix: DataFrame, settings: list[tuple[int, int]], tree_edges: int = TREE_EDGES) -> DataFrame:
    """(mcs, ms, i, label, strength) for every setting (min_cluster_size, min_samples); label -1 is noise.

    The matrix and the spanning trees stay distributed, one tree a value of ``min_samples`` for all
    settings that share it. A tree of up to ``tree_edges`` edges is condensed in one task; of a larger one only its
    real splits meet.
    Ids with fewer than ``min_samples`` distances have no core distance and are left out.
    """
    trees = spanning_edges(mutual_reachability(matrix, core_distances(matrix, sorted({s for _, s in settings}))))
    trees = materialise(trees)
    if trees.groupBy("ms").count().where(F.col("count") > tree_edges).take(1):
        return condensed_labels(trees, settings)
    kind = dict(matrix.dtypes)["a"]
    sizes = F.array(*[F.struct(F.lit(c).alias("mcs"), F.lit(s).alias("ms")) for c, s in settings])
    per = trees.withColumn("s", F.explode(F.filter(sizes, lambda z: z["ms"] == F.col("ms")))).select("s.mcs", "ms", "i", "j", "w")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "i", "j"])
        ids = np.unique(np.concatenate([pdf.i.to_numpy(), pdf.j.to_numpy()]))
        edges = np.stack([np.searchsorted(ids, pdf.i), np.searchsorted(ids, pdf.j), pdf.w], axis=1)
        labels, strength = condense(edges, len(ids), int(key[0]))
        return pd.DataFrame({"mcs": key[0], "ms": key[1], "i": ids, "label": labels, "strength": strength})

    return per.groupBy("mcs", "ms").applyInPandas(fit, f"mcs int, ms int, i {kind}, label long, strength double")


def settings_grid(n: int, requested: tuple[int, int] | None = None, sizes: tuple[int, ...] = SIZES, samples: tuple[int, ...] = SAMPLES) -> list[tuple[int, int]]:
    """The sorted, distinct settings (min_cluster_size, min_samples) that ``n`` points allow, and always the requested one."""
    asked = {requested} if requested else set()
    return sorted({(c, s) for c in sizes for s in samples if c <= n and s <= n} | asked)


def sweep(labels: DataFrame) -> DataFrame:
    """One row per setting of (mcs, ms, i, label): clusters, noise, its share, and the sizes as JSON."""
    sized = labels.groupBy("mcs", "ms", "label").agg(F.count("*").alias("n"))
    real = F.col("label") >= 0
    sizes = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(real, F.struct(F.col("label").cast("string").alias("k"), F.col("n").alias("v")))))))
    noise = F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0))
    return sized.groupBy("mcs", "ms").agg(F.count_if(real).alias("clusters"), noise.alias("noise_flights"), (100.0 * noise / F.sum("n")).alias("noise_percent"), sizes.alias("cluster_sizes"))


def noise_fraction(labels: DataFrame) -> DataFrame:
    """(i, settings, noise_count, noise_fraction) over all settings."""
    noise = F.count_if(F.col("label") == -1)
    return labels.groupBy("i").agg(F.count("*").alias("settings"), noise.alias("noise_count"), (noise / F.count("*")).alias("noise_fraction"))


def persistent_noise(labels: DataFrame) -> DataFrame:
    """The ids that are noise in every setting, by whole counts."""
    return noise_fraction(labels).where("noise_count = settings").select("i")


def linkage_cut(matrix: DataFrame, ids: DataFrame, epsilon: float) -> DataFrame:
    """(i, component): the smallest id that distances of at most ``epsilon`` reach, by doubling paths."""
    near = materialise(mirrored(matrix).where(F.col("d") <= epsilon).select("i", "j"))
    comp = materialise(ids.select("i", F.col("i").alias("component")))
    while True:
        hop = near.join(comp.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.min("component").alias("m"))
        up = comp.select(F.col("i").alias("component"), F.col("component").alias("up"))
        new = materialise(comp.join(up, "component").join(hop, "i", "left").select("i", F.least("component", "up", "m").alias("component"), (F.least("component", "up", "m") < F.col("component")).alias("moved")))
        comp = new.drop("moved")
        if not new.where("moved").take(1):
            return comp


def medoids(matrix: DataFrame, labels: DataFrame, partial: bool = False) -> DataFrame:
    """One row per cluster of (i, label): its size, the member with the least sum of distances (the smallest id on ties), and distances to it.

    A ``partial`` matrix lacks pairs; then only members with the distances to all others count.
    """
    members = labels.where("label >= 0").select("i", "label")
    own = members.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d"), "label")
    within = mirrored(matrix).join(members, "i").join(members.select(F.col("i").alias("j"), "label"), ["j", "label"]).select("i", "j", "d", "label").unionByName(own)
    sums = within.groupBy("label", "i").agg(F.sum("d").alias("total"), F.count("*").alias("n"))
    if partial:
        sums = sums.join(members.groupBy("label").agg(F.count("*").alias("n")), ["label", "n"])
    best = sums.groupBy("label").agg(F.min(F.struct(F.round("total", 9).alias("total"), "i", "n")).alias("m")).select("label", F.col("m.i").alias("medoid"), F.col("m.n").alias("flights"))
    near = within.join(best.select("label", F.col("medoid").alias("i")), ["label", "i"])
    return best.join(near.groupBy("label").agg(F.median("d").alias("median_distance_to_medoid_km"), F.max("d").alias("max_distance_to_medoid_km")), "label")


def noise_candidates(matrix: DataFrame, labels: DataFrame, grid: DataFrame, centres: DataFrame) -> DataFrame:
    """The noise of ``labels`` (i, label), ranked by its share of noise over ``grid`` (mcs, ms, i, label), then by its distance.

    (i, noise_fraction, nearest_medoid, nearest_cluster, distance_km), both keys falling, then by i.
    Without clusters the last three are null.
    """
    noise = labels.where("label = -1").select("i").join(noise_fraction(grid), "i").select("i", "noise_count", "settings", "noise_fraction")
    out = noise.join(noise_ranking(matrix, labels, centres), "i", "left")
    return out.orderBy(F.desc("noise_fraction"), F.desc_nulls_last("distance_km"), "i").drop("noise_count", "settings")


def noise_ranking(matrix: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """(i, nearest_medoid, nearest_cluster, distance_km) of the noise, farthest from all medoids first; without clusters no rows."""
    near = mirrored(matrix).join(labels.where("label = -1").select("i"), "i").join(centres.select(F.col("medoid").alias("j"), F.col("label").alias("cluster")), "j")
    best = near.groupBy("i").agg(F.min(F.struct("d", "j", "cluster")).alias("m")).select("i", F.col("m.j").alias("nearest_medoid"), F.col("m.cluster").alias("nearest_cluster"), F.col("m.d").alias("distance_km"))
    return best.orderBy(F.desc("distance_km"), "i")

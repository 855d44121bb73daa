"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge at most, to a node without one."""
    twice = edges.groupBy("node").count().where("count > 1").select("node")
    centre = edges.select(F.col("component").alias("node")).distinct().join(edges.select("node"), "node", "left_semi")
    return not twice.unionByName(centre).take(1)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that is linked to a smaller one; component is the smallest node it reaches.

    ``links`` has two id columns; loops, repeats and either direction are allowed, null ends are not
    links. Nodes without a row are the smallest of their component. Each round is two joins and four
    small tables in the shared folder, deleted after it; rounds grow with the logarithm of the longest
    path. A node with very many links is split by adaptive execution, because both sides of each join
    are tables.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    edges = stored(links.where(F.col(a) != F.col(b)).select(big.alias("node"), small.alias("component")).distinct())
    while not _is_stars(edges):
        both = edges.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(edges.select(F.col("component").alias("u"), F.col("node").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("component")).distinct())
        smallest = stored(large.groupBy("node").agg(F.min("component").alias("m")))
        near = large.join(smallest, "node")
        before = edges
        edges = stored(near.select("node", F.col("m").alias("component")).unionByName(near.where("component <> m").select(F.col("component").alias("node"), F.col("m").alias("component"))).distinct())
        drop(before, least, large, smallest)
    return edges


def smallest_reachable(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` points of one task the smallest point that the links (arrays of points) reach."""
    root = np.arange(n)
    while links:
        before = root.copy()
        for a, b in links:
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    return root

"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations and joins; a round's links are a written table. The minimum of a node's
neighbours is combined before the shuffle, and the join back may be split by key, so a node with very
many links stays cheap. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, written


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node of its component) equal in connectivity to the links (a, b) of one task."""
    if not len(a):
        return a[:0], b[:0]
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook larger roots on smaller ones, then jump
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if not (low < high).any():
            break
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _nearest(edges: DataFrame) -> DataFrame:
    """Per node u of both directions: the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): for links (a, b), each linked node with the smallest node it can reach.

    Links may repeat, run in either direction or join a node with itself; nulls are ignored.
    No links give no rows. Rounds go on until one changes nothing, which the stars reach for any links; the table
    of a round is deleted once the next one is written.
    """
    spark = links.sparkSession
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = written(edges, "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: links run from a node to smaller ones
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges, newer = written(small.where("u <> v").distinct(), "links")
        drop_path(spark, path)
        path = newer
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))

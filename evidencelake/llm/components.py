"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, least node of its component) that join what the given links join, fewer than there are nodes."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        pa, pb = parent[a], parent[b]
        apart = pa != pb
        if not apart.any():
            break
        a, b, pa, pb = a[apart], b[apart], pa[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    inner = parent != np.arange(len(nodes))
    return nodes[inner], nodes[parent[inner]]


def connected_components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) but the roots; root is the least node of the component.

    Nulls and self-links are ignored, repeated links are one. A round costs two small shuffles on node numbers; minima are
    pre-aggregated, so the centre of a large star is no hot group. The number of rounds grows with the logarithm of the size.
    """
    edges = scratch.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links-0")
    for turn in range(1, 100):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = scratch.keep(small.select("e.u", "e.v").where("u <> v").distinct(), f"links-{turn}")
        scratch.drop(edges)
        edges = new
        more = edges.groupBy("u").count().where("count > 1").select("u")
        if more.union(edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")).isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

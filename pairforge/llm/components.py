"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris and others, 2014).

Edges lie in partitions of bounded size. Before the steps every partition turns the edges that it holds into stars around the least node of each part that they
form, which keeps the components; where all edges fit into one such partition, that is all there is to do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


#: Edges of a partition, at most: 16 MB.
EDGES = 1_000_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges: each node with the least node that they lead to."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:  # least neighbour, then shortcut, until nothing changes; nodes are in order, so a smaller number is a smaller node
        least = root.copy()
        for to, value in ((x, root[y]), (y, root[x]), (root[x], root[y]), (root[y], root[x])):
            np.minimum.at(least, to, value)
        least = least[least]
        if np.array_equal(least, root):
            break
        root = least
    other = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, least: DataFrame) -> DataFrame:
    return links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node long, comp long): each node of an edge with the smallest node it can reach.

    Both steps take minima before they shuffle rows and join on the node, so Spark can split a hot node. Nulls and loops
    are dropped; repeated edges do no harm; no edges give an empty result. Every step ends in a checkpoint.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    n = max(1, math.ceil(edges.count() / EDGES))
    now = cut(edges.coalesce(n).mapInArrow(_local_stars, "a long, b long"))
    state = _state(now) if n > 1 else (0,)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = cut(_star(both.where("b > a"), least).where("a <> b").distinct().coalesce(n))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _star(large, least).union(least.select("a", F.col("m").alias("b"))).where("a <> b")
        now = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(n))
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))

"""Distributed connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import written

#: A graph that has been contracted to so many edges is finished in one task (about 100 MB there); larger ones go on.
SMALL = 1_000_000


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node and to (its component's smallest node) of all edges (a, b) of a bounded graph."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    edges = pd.concat(parts)
    nodes, ends = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    up = list(range(len(nodes)))
    for a, b in ends.reshape(-1, 2).tolist():
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
    for k, u in enumerate(up):
        up[k] = up[u]  # smaller ones are settled already
    yield pd.DataFrame({"node": nodes, "to": nodes[up]})


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of edges (a, b).

    In each round every node moves to its least neighbour (or stays), and the graph is contracted: least by id in even
    rounds, which settles stars, by a hash that differs by round in odd ones, so the rounds grow with the logarithm of
    the graph. Once at most SMALL edges are left, one task joins them. Nothing but counts reaches the driver.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, k = None, 0
    while left := edges.count():
        if left <= SMALL:
            moves = edges.coalesce(1).mapInPandas(_united, "node long, to long")
            edges = edges.limit(0)
        else:
            rank = lambda c, k=k: F.struct((F.xxhash64(c, F.lit(k)) if k % 2 else F.col(c)).alias("h"), F.col(c).alias("to"))
            both = edges.select(F.col("a").alias("node"), rank("b").alias("r")).union(edges.select(F.col("b"), rank("a")))
            moves = both.groupBy("node").agg(F.min("r").alias("r")).select("node", F.least("r", rank("node"))["to"].alias("to"))
            moves = written(moves)
            ma, mb = moves.select(F.col("node").alias("a"), F.col("to").alias("x")), moves.select(F.col("node").alias("b"), F.col("to").alias("y"))
            moved = edges.join(ma, "a").join(mb, "b").where("x <> y")
            edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if labels is None:
            labels = moves.withColumnRenamed("to", "label")
        else:
            m = moves.select(F.col("node").alias("label"), "to")
            labels = written(labels.join(m, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        k += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if k == 1:
        return labels.withColumnRenamed("label", "component")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")

"""Connected components by contraction, for link tables of any size.

Each round every node points at the least node of its closed neighbourhood, pointers are
jumped until every node points at the root of its tree, and the edges are rewritten between
roots. Every tree that isn't a whole component joins at least two nodes, so a round at least
halves the nodes that still have edges, and a tree of depth n takes log2(n) jumps: both counts
are logarithmic, for chains too. The maps of the rounds shrink with the nodes and are applied
one to another at the end, from the last to the first. Minima combine before the shuffle, so a
hub costs one row per task; the joins have one row per node on their right side, and a hot node
on their left side can be split by adaptive execution. Every step is a table in the shared
folder, whose size the planner knows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, nodes 0 to n - 1, in memory."""
    root = np.arange(n)
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, hi, lo)
        while True:
            nxt = root[root]
            if np.array_equal(nxt, root):
                break
            root = nxt
        a, b = root[a], root[b]
        keep = a != b
        a, b = a[keep], b[keep]
    return root


def forest(batches):
    """Links of a batch to a spanning forest: what they connect, in fewer rows."""
    for batch in batches:
        a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[own]], pa.int64()), pa.array(nodes[own], pa.int64())], ["a", "b"])


def components(links: DataFrame, log: list[int] | None = None) -> DataFrame:
    """(node, component) for every node of links (a long, b long): component is the least node reachable.
    log: gets the number of jumps of every round."""
    edges = R.cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").mapInArrow(forest, "a long, b long").distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = R.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p"), F.lit(True).alias("moved")))
        jumps = 0
        while not up.where("moved").isEmpty():
            to = up.select(F.col("node").alias("p"), F.col("p").alias("q"))
            up, jumps = R.cut(up.join(to, "p").select("node", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))), jumps + 1
        up = up.select("node", "p")
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        edges = R.cut(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).mapInArrow(forest, "a long, b long").distinct())
        maps.append(up)
        if log is not None:
            log.append(jumps)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    last = maps.pop().withColumnRenamed("p", "component")
    for up in reversed(maps):
        last = R.cut(up.join(last.withColumnRenamed("node", "p"), "p", "left").select("node", F.coalesce("component", "p").alias("component")))
    return last

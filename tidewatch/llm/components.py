"""Connected components of large graphs, without gathering the links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, release_memory

#: Links that one executor's task joins at once (16 bytes each); more go through rounds of stars.
TASK_LINKS = 1_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each): roots hook to smaller ones across links, and paths are halved, until nothing moves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as links of each node to its root, reduced whenever TASK_LINKS of them are held.

    A forest that fills more than half of what may be held is given out, and another one is begun.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return roots(np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]))

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > TASK_LINKS:
            node, root = reduced()
            held, size = [(node, root)], len(node)
            if 2 * size > TASK_LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])
                held, size = [], 0
    if size:
        node, root = reduced()
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])
    release_memory()


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The roots of all links that one task reads (TASK_LINKS at most)."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if sum(len(u) for u, _ in held):
        node, root = roots(np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])
    release_memory()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node that each node of a link can reach. links: two columns u, v of longs.

    Every partition first reduces its links to a forest. What remains goes through one executor's task while it
    is at most TASK_LINKS links. Beyond, large stars and small stars take turns: every node links its larger
    neighbours, then itself and its smaller ones, to the smallest it knows; rounds grow with the logarithm of
    the nodes, and minima are aggregated before they are joined back, so a node with any number of links is no
    single task's work. An empty table gives an empty result; self-links give their node.
    """
    edges = scratch.keep(links.select("u", "v").mapInArrow(_forest, "u long, v long"), "links")
    if edges.count() <= TASK_LINKS:
        return edges.coalesce(1).mapInArrow(_whole_forest, "u long, v long").toDF("node", "root")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(edges.filter("u = v")).distinct()
        large = scratch.keep(large, "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest).filter("u > v or (u = v)").distinct()
        roots = small.filter("u = v").select("u").join(small.filter("u > v").select("u").distinct(), "u", "left_anti")
        after = scratch.keep(small.filter("u > v").union(roots.select("u", F.col("u").alias("v"))), "small")
        scratch.drop(edges, large)
        edges = after
    return edges.filter("u > v").select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

"""Connected components of an edge table, by hooking and pointer jumping over tables in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that one task makes into stars; more of them are dealt over several, whose stars are then joined.
EDGES = 1 << 20


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of their component, by these edges alone; roots are left out."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ix[: len(a)], ix[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars around the smallest nodes: the same connections in fewer rows."""

    def run(batches):
        # folded batch by batch: what is held is a forest of this partition's nodes
        v, r = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            v, r = _forest(np.concatenate([v, x]), np.concatenate([r, y]))
        for i in range(0, len(v), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + (1 << 16)]), pa.array(r[i : i + (1 << 16)])], names=["v", "r"])

    return edges.mapInArrow(run, "v long, r long")


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node"), F.col("r").alias("root"))
    return roots.unionByName(stars.select(F.col("r").alias("node"), F.col("r").alias("root")).distinct())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node of its component) for every node with an edge; edges: two long columns without nulls.

    Tasks of up to EDGES edges make them into stars; those of a single task are the result. Else, in each round a node keeps its smallest root, and its roots are chained to one another; then each node
    takes its root's root. Every table is written to the shared folder; nothing but two counts a round
    reaches the driver. Rounds grow with the logarithm of the longest chain of stars.
    """
    a, b = edges.columns
    tasks = edges.count() // EDGES + 1
    stars = scratch.table(_contracted(edges.select(F.col(a).alias("v"), F.col(b).alias("r")).where("v <> r").coalesce(tasks)), "stars")
    if tasks == 1:
        return _with_roots(stars)
    while True:
        # the roots of a node are few: at most one for each partition of the last contraction
        w = Window.partitionBy("v").orderBy("r")
        linked = stars.distinct().withColumn("lower", F.lag("r").over(w))
        hooked = linked.select(F.when(F.col("lower").isNull(), F.col("v")).otherwise(F.col("r")).alias("v"), F.coalesce("lower", "r").alias("r"))
        hooked = scratch.table(hooked.distinct(), "hooked")
        up = scratch.table(hooked.groupBy(F.col("v").alias("at")).agg(F.min("r").alias("up")), "up")
        # a root with many nodes is a hot key; both sides are plain scans, so adaptive execution splits it
        jumped = hooked.join(up, hooked["r"] == up["at"], "left").select("v", F.coalesce("up", "r").alias("r"), F.col("up").isNotNull().alias("moved"))
        jumped = scratch.table(jumped, "jumped")
        moved, rows, nodes = jumped.agg(F.count_if("moved"), F.count("*"), F.count_distinct("v")).first()
        if not moved and rows == nodes:
            return _with_roots(jumped)
        stars = jumped.select("v", "r")

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Cut


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that is reachable) for each node of the edges (two columns).

    Each node takes the smallest root among its own and its neighbours', then its root's root, until
    nothing changes; each round is a table in the shared folder, and the one before it goes.
    """
    cut = Cut(edges.sparkSession)
    a, b = edges.columns
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    last = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("root")))
    while True:
        roots = last.select("node", "root")
        near = both.join(roots.select(F.col("node").alias("y"), F.col("root").alias("near")), "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        low = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        up = roots.select(F.col("node").alias("low"), F.col("root").alias("up"))
        new = cut(low.join(up, "low", "left").select("node", F.col("root").alias("was"), F.least("low", F.coalesce("up", "low")).alias("root")))
        cut.drop(last)
        if new.where("was <> root").isEmpty():
            cut.drop(both)
            return new.select("node", "root")
        last = new

"""Connected components of an edge table by hooking to the smallest neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm._common import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label) for the nodes of the edges (a, b): label is the smallest node that can be reached.

    Each round hooks every root to its smallest neighbour, shortens the chains and replaces the edges by edges
    between the new roots, so the edge table shrinks to nothing in about log(n) rounds. Every round is written to
    the shared folder: both sides of each join are plain scans, so that Spark can split the partition of a hot
    root. No link ever reaches the driver, only the count of those left. Null ends and loops are ignored.
    """
    live = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-edges-0")
    labels, used, k = None, [f"{tag}-edges-0"], 0
    while True:
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        parent = scratch.write(both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), f"{tag}-parent-{k}-0")
        used.append(f"{tag}-parent-{k}-0")
        for jump in (1, 2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            parent = scratch.write(parent.join(up, "parent").select("node", F.col("grand").alias("parent")), f"{tag}-parent-{k}-{jump}")
            used.append(f"{tag}-parent-{k}-{jump}")
        up = parent.select(F.col("node").alias("label"), F.col("parent").alias("root"))
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("label"))
        else:
            labels = scratch.write(labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label")), f"{tag}-labels-{k}")
            used.append(f"{tag}-labels-{k}")
        k += 1
        a, b = (parent.select(F.col("node").alias(x), F.col("parent").alias(f"r{x}")) for x in "ab")
        half = scratch.write(live.join(a, "a").select("ra", "b").distinct(), f"{tag}-half-{k}")
        moved = half.join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        live = scratch.write(moved, f"{tag}-edges-{k}")
        used += [f"{tag}-half-{k}", f"{tag}-edges-{k}"]
        if live.isEmpty():
            out = scratch.write(labels, f"{tag}-components")
            scratch.drop(*used)
            return out

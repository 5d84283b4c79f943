"""Connected components of a table of links, as DataFrame joins (no link ever goes to the driver)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import Scratch

ROUNDS = 60
#: Links (16 bytes each) that one task may hold to settle them at once; more are settled by rounds of joins.
TASK_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some links that isn't the smallest it reaches, and that smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            other = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[other], nodes[label[other]]
        label = new


def spanning_forest(links: DataFrame, whole: bool = False) -> DataFrame:
    """Replace links by as few that connect the same nodes, each node to its smallest.

    Batch by batch, or (whole) all links of a partition at once.
    """

    @kernel.tidy
    def settle(batches):
        pairs = ((batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches)
        if whole:
            none = np.zeros(0, np.int64)
            pairs = [tuple(np.concatenate(x) for x in zip((none, none), *pairs, strict=True))]
        for a, b in pairs:
            node, low = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], names=["a", "b"])

    return links.mapInArrow(settle, "a long, b long")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, component`` for each node that has a link: the smallest node that it reaches.

    Each round every node takes the smallest label among its neighbours' and its own, then its
    label's label; labels halve their distance to the smallest node each round.
    """
    scratch = scratch or Scratch(links.sparkSession)
    links = scratch.keep(spanning_forest(links.select("a", "b").where("a <> b")), "links")
    if links.count() <= TASK_LINKS:
        tree = scratch.keep(spanning_forest(links.coalesce(1), whole=True), "labels")
        # Each tree's smallest node stands for itself.
        roots = tree.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return tree.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    links = links.distinct()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        stepped = scratch.keep(low.join(up, "low").select("node", F.least("low", "up").alias("component"), "was"), "labels")
        labels = stepped.select("node", "component")
        if not stepped.where("component <> was").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")

"""Connected components of a graph whose edges are a table, without collecting any of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize

#: Edges (of 16 bytes) that one task joins up, at most.
SMALL = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges, and the smallest one it is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while ((up := label[label]) != label).any():
            label = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return nodes, nodes[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(*(table.column(c).to_numpy() for c in ("a", "b")))], names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node long, component long): the smallest node reachable from each.

    Up to SMALL distinct edges are joined up in one task. Beyond that: rounds of hooking (the tree of each end's root goes below the smaller root of a neighbour) and pointer
    jumping; the number of rounds grows with the logarithm of the number of nodes. Each round's labels are
    written to the shared folder. Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if edges.count() <= SMALL:
        return _in_one_task(edges)
    both = materialize(edges.union(edges.select("b", "a")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = materialize(both.join(la, "a").join(lb, "b").filter("la <> lb").select("la", "lb").distinct())
        hooks = between.filter("lb < la").groupBy(F.col("la").alias("node")).agg(F.min("lb").alias("hook"))
        hooked = materialize(labels.join(hooks, "node", "left").select("node", F.least("label", "hook").alias("label")))
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(above, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved"))
        jumped = materialize(jumped)
        labels = jumped.drop("moved")
        if between.isEmpty() and jumped.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")

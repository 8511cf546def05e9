"""Connected components of links, by minimum labels and pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: So many links the driver joins itself (a few MB): rounds over tables take
#: far more of its memory, by their plans.
FEW_LINKS = 200_000


def _labelled(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(node, label) of the links: roots join smaller roots until none is left."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while (label[a] != label[b]).any():
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
    return pa.table({"node": node.astype("i8"), "label": node[label].astype("i8")})


def connected_components(scratch: Scratch, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): label is the smallest
    node that can be reached.  Above ``FEW_LINKS`` everything stays in tables and
    the driver sees one count per round; rounds grow with the logarithm of the
    longest chain."""
    links = links.select("a", "b").where("a <> b")
    if links.count() <= FEW_LINKS:
        few = links.toArrow()
        labels = scratch.spark.createDataFrame(_labelled(*(few.column(c).to_numpy() for c in ("a", "b"))))
        return scratch.save(labels.select("node", "label"), f"{name}-few")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = scratch.save(both, f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        lower = scratch.save(lower, f"{name}-low{k}")
        # Jump to the label of the label.
        jump = lower.select(F.col("node").alias("at"), F.col("next").alias("jump"))
        jumped = lower.join(jump, F.col("next") == F.col("at")).select("node", F.least("next", "jump").alias("label"), (F.col("label") != F.least("next", "jump")).alias("changed"))
        fresh = scratch.save(jumped, f"{name}-{k}")
        changed = fresh.where("changed").limit(1).count()
        labels = fresh.drop("changed")
        scratch.drop(f"{name}-low{k}", f"{name}-{k - 1}")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels

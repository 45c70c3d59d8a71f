"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop, stored

_LABELS = "node long, root long"


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, the least node of each one's component) of a few edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        # the larger root of each edge goes under the least that it meets, then all look through
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            far = root[root]
            if (far == root).all():
                break
            root = far
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def components(edges: DataFrame, few: int = 1 << 20) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Up to ``few`` edges between numbers, which are counted first, are settled by one task. Others go through rounds: each
    takes the least label among neighbours and then the label's label, until nothing
    changes: about log2(longest path) rounds. Labels live in written tables; nothing but the
    number of changes reaches the driver.
    """
    spark = edges.sparkSession
    own, own_path = stored(edges.select("a", "b"), "edges")
    if {kind for _, kind in own.dtypes} == {"bigint"} and own.count() <= few:

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides = [np.zeros((2, 0), dtype=np.int64)]
            sides += [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
            found = _roots(*np.concatenate(sides, axis=1))
            for at in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(v[at : at + (1 << 16)]) for v in found], ["node", "root"])

        labels, _ = stored(own.coalesce(1).mapInArrow(settle, _LABELS), "labels")
        drop(spark, own_path)
        return labels
    both, both_path = stored(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    drop(spark, own_path)
    labels, path = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_node")).agg(F.min("root").alias("_near"))
        low = labels.join(near, F.col("node") == F.col("_node")).select("node", F.least("root", "_near").alias("_low"), F.col("root").alias("_old"))
        jump = labels.select(F.col("node").alias("_hop"), F.col("root").alias("_far"))
        after = low.join(jump, F.col("_low") == F.col("_hop"), "left").select(
            "node", F.least("_low", F.coalesce("_far", "_low")).alias("root"), "_old"
        )
        new, new_path = stored(after, "labels")
        changed = new.where(F.col("root") != F.col("_old")).limit(1).count()
        drop(spark, path)
        labels, path = new.select("node", "root"), new_path
        if not changed:
            drop(spark, both_path)
            return labels

"""Connected components of an edge table, by the smallest node id."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adcorpus.llm.common import map_arrow, written


def roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of the index pairs (a, b) and return every index's root; smaller wins."""
    parent = parent.copy()
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch as stars around the smallest node of each local component."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        if len(a):
            nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = roots(np.arange(len(nodes)), index[: len(a)], index[len(a) :])
            far = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[root[far]]), pa.array(nodes[far])], names=["a", "b"]
            )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a bigint, b bigint); component is the smallest
    id reachable. No edges give no rows.

    Edges are first contracted batch by batch; then labels move to neighbours and are followed
    one step further, until none changes. Rounds grow with the logarithm of a component's size.
    """
    near = map_arrow(edges.select("a", "b").where("a <> b"), _local, "a bigint, b bigint")
    both = written(near.union(near.select("b", "a")).distinct(), "edges")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("label")
        ),
        "labels",
    )
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        least = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("m"))
        hop = labels.join(least, "node").select("node", "label", F.least("label", "m").alias("to"))
        ends = labels.select(F.col("node").alias("to"), F.col("label").alias("end"))
        moved = written(
            hop.join(ends, "to").select("node", F.col("label").alias("was"), F.least("to", "end").alias("label")),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")

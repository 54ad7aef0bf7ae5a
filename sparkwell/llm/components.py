"""Connected components of an edge table: spanning forests within tasks, then one task, or minimum labels in rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import cut

#: Edges that one task holds.
MOST = 2_000_000
#: Edges after which a partition's forest is made anew, so that the others need little memory.
PIECE = 250_000


def solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the edges, ascending, and for each the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[x], label[y]
        differ = x != y
        x, y = x[differ], y[differ]
        if not len(x):
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := label[label], label):
            label = further


def _edges(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A partition's edges, as forests, in pieces that are no larger than `most` edges and a batch."""
    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held > most:
            nodes, label = solved(np.concatenate(a), np.concatenate(b))
            own = nodes != label
            a, b, held = [nodes[own]], [label[own]], int(own.sum())
            if 2 * held > most:
                yield a[0], b[0]
                a, b, held = [], [], 0
    if held:
        nodes, label = solved(np.concatenate(a), np.concatenate(b))
        own = nodes != label
        yield nodes[own], label[own]


def _forest(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _edges(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches]
    if held:
        nodes, label = solved(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])


def components(edges: DataFrame, most: int = MOST) -> DataFrame:
    """(node, label) for every node of `edges` (a, b: long): label is the smallest node reachable.

    Each partition keeps a spanning forest of its edges. Up to `most` edges of all forests go to one task: rounds over so
    few are jobs that cost the driver more than the executors. More take rounds. Rows with null ends are ignored.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    forest = cut(ends.mapInArrow(_forest(min(most, PIECE)), "a long, b long"))
    if forest.count() <= most:
        return cut(forest.coalesce(1).mapInArrow(_labels, "node long, label long"))
    return _in_rounds(forest)


def _in_rounds(edges: DataFrame) -> DataFrame:
    """The components' labels of any number of edges between different nodes.

    Each round takes the smallest label among a node's neighbours and then that label's own label; minima are
    combined before the shuffle, joins are plain equi-joins that adaptive execution splits where a node has very many
    edges. Rounds end when no label changes.
    """
    ends = edges.distinct()
    both = cut(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", "label", F.least("label", F.coalesce("near", "label")).alias("lower")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        following = cut(
            lower.join(jump, lower["lower"] == jump["via"], "left").select(
                "node",
                F.least("lower", F.coalesce("beyond", "lower")).alias("label"),
                F.col("label").alias("before"),
            )
        )
        done = following.where("label <> before").isEmpty()
        labels = following.select("node", "label")
        if done:
            return labels

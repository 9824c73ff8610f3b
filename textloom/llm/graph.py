"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Graphs of no more edges are done in one task, which takes 16 bytes an edge and as much again while it runs.
SMALL = 1 << 20


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the edges a-b, but for roots."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = merged(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels (each the least member's number of its set) once the sets that the edges x-y connect are one."""
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return label
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(nearer := label[label], label):
            label = nearer


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b), of any type that has an order; a component is named by its least node.

    Edges with a null, and those from a node to itself, don't count; repeated edges count once; without edges there are no rows.
    Graphs of more than `small` edges take large-star and small-star steps in turn, until nothing changes; each round's
    edges are written to the checkpoint folder. The least neighbour of a node is found with partial aggregates and joined back, so a node with very
    many neighbours is nobody's work alone: its aggregate is small, and adaptive execution splits its part of the join."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size, state = _state(now)
    if size <= small and dict(now.dtypes)["u"] == "bigint":
        return now.coalesce(1).mapInArrow(_one_task, "node long, component long")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the greater neighbours of a node go to its least neighbour
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the lesser neighbours and the node itself go to the least of them
        small_ = large.join(_least(large), "u")
        now = durable(small_.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, (size, state) = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if len(b)]
    if held:
        node, root = rooted(*(np.concatenate(c) for c in zip(*held, strict=True)))
        roots = np.unique(root)
        yield pa.RecordBatch.from_pydict({"node": np.concatenate([node, roots]), "component": np.concatenate([root, roots])})


def _state(edges: DataFrame) -> tuple:
    n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, (n, mark)

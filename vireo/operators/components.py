"""Distributed union-find: connected components of an edge table by alternating large and small stars (Kiveris et al., SoCC 2014).

Every round is two joins and two aggregations with map-side minima, written to the shared folder, so no task or driver ever
holds a component and a lost executor costs one round at most. A table of up to ONE_TASK pairs (counted first: 32 MB) is
small enough for one executor task, and takes one pass there instead of rounds of shuffles. Both ways give the same rows.
Of larger tables, each task first puts as many links as its rows have nodes in place of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.plans.tables import materialize

ONE_TASK = 2_000_000
PORTION = 1_000_000  # pairs that a task holds at most before it thins them out
MAX_ROUNDS = 64  # the rounds needed grow with the square of the logarithm of the longest path, in theory


def _oriented(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("b"), F.least("u", "v").alias("m"))
    return edges.join(least, "b").select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs, and the least node of each one's component: minima spread over pairs, with pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        p, q = parent[x], parent[y]
        open_ = p != q
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return nodes, nodes[parent]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        node, root = roots_of(*(np.concatenate(c) for c in zip(*held)))
        for lo in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + (1 << 16)]), pa.array(root[lo : lo + (1 << 16)])], names=["node", "root"])


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs join: each node with its least one."""
    node, root = roots_of(a, b)
    return node[node != root], root[node != root]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > PORTION:
            a, b = _stars(*(np.concatenate(c) for c in zip(*held)))
            held, n = [(a, b)], len(a)
            if n > PORTION // 2:  # little is joined here
                yield out(a, b)
                held, n = [], 0
    if held:
        yield out(*_stars(*(np.concatenate(c) for c in zip(*held))))


def connected_components(pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node and root (the component's least node) of every node in the pairs a, b of a written table (longs, any order, repeats allowed)."""
    pairs = pairs.filter("a <> b")
    if pairs.limit(one_task + 1).count() <= one_task:
        return pairs.select("a", "b").coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    pairs = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = materialize(pairs.mapInArrow(_thinned, "a long, b long"))
    if pairs.limit(one_task + 1).count() <= one_task:
        return pairs.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    edges = materialize(_oriented(pairs))
    for _ in range(MAX_ROUNDS):
        edges = materialize(_oriented(_small_star(_oriented(_large_star(edges)))))
        # done when each node hangs on one root, and no root hangs on another
        deeper = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not deeper and not edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
    raise RuntimeError("components did not settle")

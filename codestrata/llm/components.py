"""Connected components by union-find within partitions and alternating stars across them; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def find(parent: dict[int, int], x: int) -> int:
    """The root of x, halving the path."""
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = x = parent[p]
    return x


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a batch of edges: an edge from each node to its root, so cycles and repeats go before any shuffle."""
    for batch in batches:
        parent: dict[int, int] = {}
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = np.array([x for x in parent if find(parent, x) != x], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.array([find(parent, int(x)) for x in nodes], np.int64))], ["u", "v"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a task: every node with its root."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [*parent]
    for k in range(0, len(nodes), 1 << 17):
        part = nodes[k : k + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(parent, x) for x in part], pa.int64())], ["node", "root"])


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours (for small, those not above it) to the least of them and it. Groups are reduced by min, never listed."""
    near = edges.select("u", "v") if small else edges.select("u", "v").union(edges.select("v", "u"))
    if small:
        near = near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


#: What union-find within partitions leaves may be finished by one task up to so many edges (some 200 MB); beyond, stars do it.
ONE_TASK = 1_000_000


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for each node of edges (u, v: bigint); root is the least node of its component, itself included.

    Every round of stars is a table in the shared folder. They end when a round changes nothing, after about log2 of the longest path; an
    error is raised if rounds don't suffice. No edges: no rows. The result is the same with one task and with stars.
    """
    now = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_forest, "u bigint, v bigint"), "cc", narrow=True)
    if now.limit(one_task + 1).count() <= one_task:
        return stored(now.repartition(1).mapInArrow(_finish, "node bigint, root bigint"), "cc")
    mark = None
    for _ in range(rounds):
        now = stored(_stars(_stars(now, small=False), small=True), "cc", narrow=True)
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            # Every edge now points at its root.
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
    raise RuntimeError("components: too few rounds")

"""Connected components of a graph of links (64-bit nodes).

First every task replaces the links it reads, of which there are at most ``PER_TASK``, by stars of their own components.
If one task can read them all, that is the result. Else alternating large-star and small-star rounds follow: every round is a handful of aggregations and joins on the whole edge table; a hub only costs rows, which adaptive
execution splits, and each round's edges go to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.storage import discard, materialize, ship

PER_TASK = 500_000  # links, 16 bytes each


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of one task as (node, least node of its component among these links)."""
    parts = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches if batch.num_rows]
    if not parts:
        return
    links = np.concatenate(parts, axis=1)
    nodes, at = np.unique(links, return_inverse=True)
    root = list(range(len(nodes)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in at.reshape(2, -1).T.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    least = np.array([find(k) for k in range(len(nodes))])
    moved = least != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["a", "b"])


def _star(edges: DataFrame, both: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each node to the least of the node and its neighbours."""
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    near = both.join(least, "a")
    if larger:
        return near.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the least of its component; root is the least node.

    edges is read twice, so it should be a written table.
    """
    ship(edges.sparkSession)
    tasks = -(-edges.count() // PER_TASK)
    contracted = materialize(edges.select("a", "b").coalesce(max(1, tasks)).mapInArrow(stars, "a long, b long"), "links")
    if tasks <= 1:
        return contracted.select(F.col("a").alias("node"), F.col("b").alias("root"))
    now, held, mark = contracted.distinct(), contracted, None
    for _ in range(max_rounds):
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.crc32(F.concat_ws(",", F.col("a").cast("string"), F.col("b").cast("string")))).alias("s")).first()
        if tuple(found) == mark or not found.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(found)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(now, both, larger=True)
        now = materialize(_star(large, large, larger=False), "links")
        discard(held)
        held = now
    raise RuntimeError(f"the components did not settle within {max_rounds} rounds")

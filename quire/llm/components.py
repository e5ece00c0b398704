"""Connected components by alternating large and small stars.

Edge cases: loops, repeated edges and edges in either direction count once; an end that is
null has no edge; no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

#: Labels up to this number are broadcast to the edges; more are joined by a shuffle that Spark may split.
BROADCAST_ROWS = 500_000
#: Edges that one file of a round holds, and that a task hangs together at a time.
FILE_EDGES = 100_000


def hung(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of each task, so many at a time, as edges from each node to the smallest that they join it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        n = 0

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        def stars() -> pa.RecordBatch:
            nodes = [v for v in root if root[v] != v]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(v) for v in nodes], pa.int64())], names=["a", "b"])

        for batch in batches:
            if n + len(batch) > FILE_EDGES and root:
                yield stars()
                root.clear()
                n = 0
            for u, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                p, q = find(u), find(v)
                if p != q:
                    root[max(p, q)] = min(p, q)
            n += len(batch)
        yield stars()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); the component is its smallest node.

    First each task hangs together the edges that it has, so rounds start from short trees;
    edges that one task holds need no round. Each round hangs nodes on the smallest
    neighbour they know. Minima per node are summed
    up before the shuffle, and go to the edges by broadcast while a count of the edges
    bounds them; beyond, they are stored, and the join is one of two plain exchanges, which
    Spark splits where it is skewed: a hub's edges never have to meet in one task. Rounds
    grow with the logarithm of the longest chain; what a round leaves is written and read
    again.
    """
    edges = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    whole = (n := edges.count()) <= FILE_EDGES
    edges = stored(hung(edges.coalesce(1 + n // (FILE_EDGES + 1))), "hung")
    n = 0 if whole else edges.count()
    while n:
        few = 2 * n <= BROADCAST_ROWS
        put = F.broadcast if few else lambda least: stored(least, "least")
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(put(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large if few else stored(large.distinct(), "large")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(put(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(least.select("a", F.col("m").alias("b")))
        after = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        after = stored(after.coalesce(1 + n // FILE_EDGES), "edges")  # rounds never add edges, so small ones stay in few files
        same = after.count() == n and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges, n = after, after.count()
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

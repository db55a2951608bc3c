"""Connected components of a graph given by its links, as joins and aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cut

LINKS = "`a` long, `b` long"


def _forest(batches):
    """The links of a task, replaced by a link from each node to the least one of its tree; rows (greater, smaller)."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def links():
        found = [(x, top(x)) for x in parent]
        found = [(x, t) for x, t in found if x != t]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(a), top(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:  # memory stays bounded; links between what was sent and what comes stay in the graph
            yield links()
            parent.clear()
    yield links()


def connected(links: DataFrame) -> DataFrame:
    """For links (a, b): each node that has a link to another one, with the smallest node it reaches (node, component).

    Tasks first replace their links by trees.  Then each node's links are moved to its smallest
    neighbour, from larger and from smaller neighbours in turn, until nothing changes; the
    number of rounds grows with the logarithm of the longest path.  Each round is stored.
    """
    now = cut(links.where("a <> b").select("a", "b").mapInArrow(_forest, LINKS).distinct())
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every link now goes from a larger to a smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.a", "l.b").where("a <> b").distinct()
        now = cut(small)
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if state == tuple(seen):
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = tuple(seen)

"""Connected components over an edge table, by alternating large-star and small-star steps.

Labels and edges stay in tables of the shared folder; the driver only sees whether they are stars yet. Edges are dealt
by their upper node and contracted to stars in their tasks, neighbourhoods are reduced with aggregates, and edges of a hub
get its least neighbour by broadcast, so a hub with very many neighbours never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regtext.llm.support import join_hot, map_batches, materialise

#: Rounds after which a graph that still changes is an error: the number needed grows with the log of its longest path.
ROUNDS = 60


#: Nodes whose labels a task keeps while it contracts its edges.
HELD = 1_000_000


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: what they join stays joined, over paths that are shorter."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(root(x), x) for x in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["lo", "hi"])

    for b in batches:
        for lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(lo), root(hi)
            up[max(x, y)] = min(x, y)
        if len(up) > HELD:
            yield stars()
            up.clear()
    yield stars()


def _stars(edges: DataFrame) -> DataFrame:
    """Each edge once, and contracted where all edges of their upper node meet: a node sends one edge for each lower group at most."""
    once = edges.groupBy("lo", "hi").agg(F.lit(1).alias("one")).select("lo", "hi")
    return map_batches(once.repartition("hi"), _contract, "lo long, hi long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node of its component) of every node in edges (of longs); loops and repeated edges may occur."""
    now = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi")
    alone = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    now = materialise(_stars(now), "edges")
    for _ in range(ROUNDS):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).select("lo", F.least("lo", "m").alias("m"))
        # large star: every larger neighbour of n moves to the least of n's neighbourhood
        large = join_hot(now, least, "lo").select(F.col("m").alias("lo"), "hi").where("lo < hi")
        # small star: n and its smaller neighbours move to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.withColumnRenamed("hi", "n").join(low.withColumnRenamed("hi", "k"), F.col("n") == F.col("k"))
        moved = joined.where("m < lo").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        now = materialise(_stars(moved.unionByName(low.select(F.col("m").alias("lo"), "hi"))), "edges")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    selves = now.select(F.col("lo").alias("node")).union(alone).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.unionByName(selves)


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: an upper node has one edge and is no lower node."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("low").alias("low")).where("up > 1 or (up > 0 and low > 0)").isEmpty()

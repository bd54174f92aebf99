"""Connected components of a table of links.

Links are counted first.  Up to ``ONE_TASK_LINKS``, a few megabytes, are merged by one task; more go through alternating
large-star and small-star steps, an aggregation of minima and a join each, and every round is written to the shared
folder, so that a lost executor costs one round.  Nothing is collected but a count and a checksum a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, written


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)


#: Links that one task merges.
ONE_TASK_LINKS = 400_000
#: Links a task should hold at least: few links are not dealt over many partitions.
TASK_LINKS = 100_000


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links of one task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(links: DataFrame, u: str = "u", v: str = "v", one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """node, component (the smallest node reachable) for every node of a link other than the smallest of each."""
    spark = links.sparkSession
    path = scratch(spark, "links")
    edges = written(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").distinct(), path)
    n = edges.count()
    if n <= one_task:
        return written(edges.coalesce(1).mapInArrow(_merged, "node long, component long"), scratch(spark, "components"))
    tasks = 4 + n // TASK_LINKS
    state = None
    while True:
        step = scratch(spark, "links")
        after = written(_small_star(_large_star(edges.coalesce(tasks), tasks), tasks), step)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        path, edges = step, after
        if tuple(now) == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(now)

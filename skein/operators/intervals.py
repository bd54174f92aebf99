"""Joins of points and intervals within files, without comparing all pairs of a file.

Points meet the smallest interval around them in one sweep over each file.  For all pairs, an interval is filed under the
bins of its own scale: with 2**level at least its length, it meets one or two bins of that width.  A point looks into one
bin for each scale that occurs, at most 63 of them, so the join is an equi-join on (file, level, bin) and every candidate
is close by, whatever the number of intervals in a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import bounded_batches

CONTAINERS = ("Class", "Interface", "Struct", "Enum", "Trait", "Module")


def _level(start: Column, end: Column) -> Column:
    return F.ceil(F.log2(end - start + 1)).cast("int")


def _binned(intervals: DataFrame) -> DataFrame:
    level = _level(F.col("start_line"), F.col("end_line"))
    rows = intervals.withColumn("_level", level)
    first, last = (F.expr(f"shiftright(cast({c} as bigint), _level)") for c in ("start_line", "end_line"))
    return rows.withColumn("_bin", F.explode(F.sequence(first, last)))


def _probing(points: DataFrame, at: str, levels: list[int]) -> DataFrame:
    rows = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))) if levels else points.withColumn("_level", F.lit(0))
    return rows.withColumn("_bin", F.expr(f"shiftright(cast({at} as bigint), _level)"))


def levels_of(intervals: DataFrame) -> list[int]:
    """The scales that occur: at most 63 numbers."""
    rows = intervals.select(_level(F.col("start_line"), F.col("end_line")).alias("l")).distinct().collect()
    return sorted(r["l"] for r in rows)


def enclosing(points: DataFrame, intervals: DataFrame, at: str = "line", least_lines: int = 1) -> DataFrame:
    """Each point with the smallest interval around it: ties go to the earlier start, then name.  Points outside all
    intervals are left out.  points: file_id, ``at``; intervals: file_id, name, kind, start_line, end_line.

    A sweep over each file's starts and points in order, with a heap of the intervals begun, smallest first: one that has
    ended when it comes to the top has ended for all later points.  No pair of a point and an interval is made into a row."""
    usable = intervals.filter(F.col("end_line") - F.col("start_line") + 1 >= least_lines)
    found = ["name", "kind", "start_line", "end_line"]
    begun = usable.select("file_id", F.col("start_line").cast("bigint").alias("_at"), F.lit(False).alias("_point"), *found)
    asked = points.select("file_id", F.col(at).cast("bigint").alias("_at"), F.lit(True).alias("_point"), *(F.lit(None).cast(usable.schema[c].dataType).alias(c) for c in found))
    rows = begun.unionByName(asked.filter("_at IS NOT NULL")).filter("file_id IS NOT NULL")
    keys = ["file_id", "_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, last, heap = None, None, []
        for batch in batches:
            out = []
            for file_id, line, point, name, kind, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file_id != file:
                    file, last, heap = file_id, None, []
                if not point:
                    heappush(heap, (end - start, start, name is not None, name or "", kind is not None, kind or "", end))
                elif line != last:
                    last = line
                    while heap and heap[0][-1] < line:
                        heappop(heap)
                    if heap:
                        _, start, named, name, kinded, kind, end = heap[0]
                        out.append((file_id, line, name if named else None, kind if kinded else None, start, end))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(n).type) for c, n in zip(zip(*out, strict=True), keys + found, strict=True)], names=keys + found)

    bounded_batches(intervals.sparkSession)
    swept = rows.repartition("file_id").sortWithinPartitions("file_id", "_at", "_point")
    met = swept.mapInArrow(run, StructType([rows.schema[c] for c in keys + found]))
    return points.join(met.withColumn("_at", F.col("_at").cast(points.schema[at].dataType)).withColumnRenamed("_at", at), ["file_id", at]).select(*points.columns, *found)


def strictly_contains(a: str, b: str) -> Column:
    """Interval a has b inside: a larger range, or an equal one of a container around none."""
    c = lambda side, name: F.col(f"{side}.{name}")
    around = (c(a, "start_line") <= c(b, "start_line")) & (c(a, "end_line") >= c(b, "end_line"))
    equal = (c(a, "start_line") == c(b, "start_line")) & (c(a, "end_line") == c(b, "end_line"))
    return around & (~equal | (c(a, "kind").isin(*CONTAINERS) & ~c(b, "kind").isin(*CONTAINERS)))


def containment(intervals: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """All pairs (outer, inner) of one file where outer strictly contains inner; ``inside``: the inner ones asked for."""
    outer = _binned(intervals).alias("o")
    inner = _probing(intervals if inside is None else inside, "start_line", levels_of(intervals)).alias("i")
    same = (F.col("o.file_id") == F.col("i.file_id")) & (F.col("o._level") == F.col("i._level")) & (F.col("o._bin") == F.col("i._bin"))
    pick = lambda side: F.struct(*[F.col(f"{side}.{n}") for n in ("name", "kind", "start_line", "end_line")])
    return outer.join(inner, same & strictly_contains("o", "i")).select(F.col("i.file_id").alias("file_id"), pick("o").alias("outer"), pick("i").alias("inner"))


def parents(intervals: DataFrame) -> DataFrame:
    """file_id, name, kind, start_line, end_line, parent, depth: the innermost strict container of each interval (null
    and 0 without one) and the number of containers.

    A sweep over each file's intervals in order, outer ones first, with a stack of those that are still open: what is held
    is as deep as the nesting, and no pair of an interval and a container is ever made into a row.
    """
    columns = ["file_id", "name", "kind", "start_line", "end_line"]
    rows = intervals.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []
        for batch in batches:
            parent, depth = [], []
            for file_id, name, kind, start, end in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if file_id != file:
                    file, open_ = file_id, []
                open_ = [o for o in open_ if o[1] >= start]
                holder = kind in CONTAINERS
                around = [o for o in open_ if o[1] >= end and ((o[0], o[1]) != (start, end) or (o[3] and not holder))]
                parent.append(min(around, key=lambda o: (o[1] - o[0], -o[0], o[2]))[2] if around else None)
                depth.append(len(around))
                open_.append((start, end, name, holder))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parent, pa.string()), pa.array(depth, pa.int64())], names=[*columns, "parent", "depth"])

    swept = rows.repartition("file_id").sortWithinPartitions("file_id", "start_line", F.desc("end_line"), F.desc(F.col("kind").isin(*CONTAINERS)), "name")
    schema = StructType([*rows.schema.fields, StructField("parent", StringType()), StructField("depth", LongType())])
    bounded_batches(intervals.sparkSession)
    return swept.mapInArrow(run, schema)


def name_path(intervals: DataFrame, pattern: str, substring: bool = False) -> DataFrame:
    """Intervals whose chain of containers has the pattern's names in order, gaps allowed; the last name is the
    interval's own.  A leading slash wants the first name at the top; a trailing one wants a container."""
    anchored, wants_container = pattern.startswith("/"), pattern.endswith("/") and len(pattern) > 1
    *above, last = [p.lower() for p in pattern.strip("/").split("/")]
    own = F.lower("name")
    rows = intervals.filter(own.contains(last) if substring else own == last)
    if wants_container:
        rows = rows.filter(F.col("kind").isin(*CONTAINERS))
    keys = ["file_id", "name", "kind", "start_line", "end_line"]
    chains = containment(intervals, rows).filter(F.col("inner.name").isNotNull()).groupBy("file_id", "inner").agg(F.array_sort(F.collect_list(F.struct((F.col("outer.start_line") - F.col("outer.end_line")).alias("s"), F.lower("outer.name").alias("n")))).alias("c"))
    chains = chains.select("file_id", "inner.*", F.transform("c", lambda x: x["n"]).alias("chain"))
    out = rows.select(*keys).join(chains, keys, "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<string>")))
    if not above:
        return (out.filter(F.size("chain") == 0) if anchored else out).select(*keys)
    if anchored:
        out = out.filter(F.element_at("chain", 1) == above[0])
    wanted = F.array(*map(F.lit, above))
    matched = F.aggregate("chain", F.lit(0), lambda n, x: n + F.when(F.get(wanted, n) == x, 1).otherwise(0))
    return out.filter(matched == len(above)).select(*keys)

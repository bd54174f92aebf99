"""Results shaped for readers: merged bodies, caller lists, suggestions, call graphs, paired differences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .intervals import enclosing
from .joins import MAX_TARGETS, capped_join, fold_edges
from .search import top_per_group

# Fixed values.
LONG_BODY, CALLERS = 160, 12


def merged_bodies(hits: DataFrame, bodies: DataFrame, at: str = "line", least_lines: int = 3, longest: int = LONG_BODY) -> DataFrame:
    """Hits grouped by the smallest body around them: file_id, name, start_line, end_line, hits, first, shown.

    Bodies of ``longest`` lines or more are only labelled: shown is false."""
    inside = enclosing(hits, bodies, at=at, least_lines=least_lines)
    rows = inside.groupBy("file_id", "name", "start_line", "end_line").agg(F.count("*").alias("hits"), F.min(at).alias("first"))
    return rows.withColumn("shown", F.col("end_line") - F.col("start_line") + 1 < longest)


def call_graph(calls: DataFrame, symbols: DataFrame, cap: int = MAX_TARGETS) -> DataFrame:
    """calls: file_id, callee, line; symbols: file_id, name, kind, start_line, end_line.  Edges from the smallest symbol
    around a call to all symbols of the callee's name, unless the name has more than ``cap``; weights are numbers of
    calls."""
    key = lambda file, name, start: F.concat_ws(":", F.col(file).cast("string"), F.col(name), F.col(start).cast("string"))
    callers = enclosing(calls, symbols).select("callee", key("file_id", "name", "start_line").alias("src"))
    targets = symbols.select(F.col("name").alias("callee"), key("file_id", "name", "start_line").alias("dst"))
    return fold_edges(capped_join(callers, targets, "callee", cap))


def callers(references: DataFrame, test: Column, most: int = CALLERS) -> DataFrame:
    """references: path, name (caller), line.  The first callers outside tests as one text ``name@path×n(lines)`` each, if
    tests outnumber the others, with their rank."""
    n = references.agg(F.count_if(test).alias("_t"), F.count_if(~test).alias("_p"))
    rows = references.filter(~test).groupBy("path", "name").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("line")).alias("lines"))
    text = F.concat("name", F.lit("@"), "path", F.lit("×"), F.col("n").cast("string"), F.lit("("), F.array_join(F.transform("lines", lambda x: x.cast("string")), ","), F.lit(")"))
    kept = rows.crossJoin(F.broadcast(n)).filter("_t > _p").select("path", "name", "n", text.alias("text")).orderBy(F.desc("n"), "path", "name").limit(most)
    return top_per_group(kept.withColumn("_g", F.lit(0)), ["_g"], [F.desc("n"), F.col("path"), F.col("name")], most).select("rank", "text")


def implementors(found: DataFrame, group: str, owner: str, shown: int = 10) -> DataFrame:
    """One row a group: the number of owners and the first ``shown`` of them, in order."""
    first = top_per_group(found, [group], [F.col(owner)], shown).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(owner)), lambda x: x.cast("string")), ",").alias("first"))
    return found.groupBy(group).agg(F.count("*").alias("n")).join(first, group)


def path_suggestions(files: DataFrame, given: str, k: int = 5) -> DataFrame:
    """Directories and files nearest to a path filter that matched nothing: most of its segments contained, then the
    fewest edits of the last segment, then the shortest, then by name."""
    wanted = [s for s in given.lower().strip("/").split("/") if s]
    paths = files.select("path").union(files.select(F.explode(T.ancestors(T.dir_of("path"))))).filter("path != ''").distinct()
    segments = F.split(F.lower("path"), "/")
    shared = sum((F.array_contains(segments, s).cast("int") for s in wanted), F.lit(0))
    edits = F.levenshtein(F.element_at(segments, -1), F.lit(wanted[-1] if wanted else ""))
    return paths.select("path", shared.alias("shared"), edits.alias("edits")).orderBy(F.desc("shared"), "edits", F.length("path"), "path").limit(k)


def directed_diff(before: DataFrame, after: DataFrame, suspects: DataFrame, key: str, stamp: list[str], storm: int = 5_000) -> DataFrame:
    """The differences of the suspect paths and of all paths below suspect directories; of everything in a storm."""
    from .changes import snapshot_diff

    full = snapshot_diff(before, after, key, stamp)
    if suspects.limit(storm + 1).count() > storm:
        return full
    s = suspects.select(F.col(key).alias("_s")).distinct()
    parts = full.select(key, F.explode(F.array_append(T.ancestors(T.dir_of(key)), F.col(key))).alias("_s"))
    return full.join(parts.join(s, "_s", "left_semi").select(key).distinct(), key, "left_semi")


def changeset_filter(changes: DataFrame, language: Column, admitted: Column) -> DataFrame:
    """Changes that matter to the index: removals always; a file that lost its language goes as a removal."""
    kind = F.when(F.col("change") == "Removed", "Removed").when(language.isNotNull() | admitted, F.col("change")).when(F.col("change") == "Modified", "Removed")
    return changes.withColumn("change", kind).filter("change IS NOT NULL")


def reused(imports: DataFrame, before: DataFrame, key: list[str], value: str) -> DataFrame:
    """Imports with the result of the batch before, if their key is unchanged; ``fresh`` marks those to resolve."""
    return imports.join(before.select(*key, value).withColumn("_had", F.lit(True)), key, "left").withColumn("fresh", F.col("_had").isNull()).drop("_had")


#: Least draws of 0 to 1 that give a weight of 1, 2, ...: the distribution function of a Poisson variable of mean 1.
POISSON = [round(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)), 12) for k in range(8)]


def bootstrap(values: DataFrame, value: str, id_: str, resamples: int = 20_000, salt: str = "") -> DataFrame:
    """n, mean, low, high: the mean of paired differences and the 2.5 and 97.5 percentiles of resampled means.

    A Poisson bootstrap: in each resample a pair has a weight drawn by a digest of its id and the resample's number, so
    the same pairs give the same interval on any cluster, and no task holds more than its own pairs.  Null values are
    left out; with no pair, or none drawn, there is no interval."""
    rows = values.filter(F.col(value).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(value).cast("double").alias("x"))
    drawn = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.conv(F.substring(F.md5(F.concat("id", F.lit(f"{salt}:"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = sum(((F.col("u") >= x).cast("int") for x in POISSON), F.lit(0))
    sums = drawn.withColumn("u", u).withColumn("w", weight).groupBy("k").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("s")).filter("w > 0")
    ends = sums.agg(F.percentile(F.col("s") / F.col("w"), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    whole = rows.agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return whole.crossJoin(F.broadcast(ends)).select("n", "mean", F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))

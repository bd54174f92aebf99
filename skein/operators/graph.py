"""Ranking and reachability over weighted edges (src, dst, weight).

Rank runs a fixed number of rounds.  A graph of at most ``SMALL_EDGES`` edges, counted first, is ranked by one task in a
fixed order of sums; a larger one by a join and an aggregation a round, checkpointed to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

DAMPING, ROUNDS = 0.85, 40
CONTEXT_WEIGHT, STEM_BOOST, MENTION_BOOST = 50, 10.0, 50.0
SMALL_EDGES = 500_000
CHECKPOINT_EVERY = 5


def adjacency(edges: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """src, dst, weight summed; edges out of context nodes count fifty times.  Only import edges belong here."""
    w = F.col("weight")
    rows = edges.filter("src != dst")
    if context is not None:
        rows = rows.join(context.select(F.col("node").alias("src")).distinct().withColumn("_c", F.lit(True)), "src", "left")
        w = F.when(F.col("_c"), w * CONTEXT_WEIGHT).otherwise(w)
    return rows.groupBy("src", "dst").agg(F.sum(w).alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, restart: DataFrame | None = None, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """node, score.  ``restart`` (node, mass) is where walks start, and where jumps and dangling mass go."""
    r = nodes.select("node").distinct()
    r = r.withColumn("mass", F.lit(1.0)) if restart is None else r.join(restart.select("node", "mass"), "node", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    n = edges.count()
    if n <= SMALL_EDGES and nodes.count() <= SMALL_EDGES:
        return _rank_in_one_task(r, edges, rounds, damping)
    return _rank_by_joins(r, edges, rounds, damping)


def _rank_in_one_task(restart: DataFrame, edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    rows = restart.select("node", F.lit(None).cast("bigint").alias("dst"), F.col("mass").alias("w")).unionByName(edges.select(F.col("src").cast("bigint").alias("node"), F.col("dst").cast("bigint").alias("dst"), F.col("weight").cast("double").alias("w")))

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["dst"].isna()].sort_values("node")
        ids = own["node"].to_numpy()
        links = pdf[pdf["dst"].notna()].sort_values(["node", "dst"])
        a, b = np.searchsorted(ids, links["node"].to_numpy()), np.searchsorted(ids, links["dst"].to_numpy(dtype="int64"))
        w = links["w"].to_numpy(float)
        out = np.bincount(a, w, len(ids))
        restart = own["w"].to_numpy(float) / own["w"].sum()
        score = restart.copy()
        for _ in range(rounds):
            flow = np.bincount(b, score[a] * w / out[a], len(ids))
            score = (1 - damping) * restart + damping * (flow + score[out == 0].sum() * restart)
        return pd.DataFrame({"node": ids, "score": score})

    return rows.withColumn("node", F.col("node").cast("bigint")).groupBy().applyInPandas(rank, "node long, score double")


def _rank_by_joins(restart: DataFrame, edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    total = restart.agg(F.sum("mass")).first()[0]
    base = checkpointed(restart.select("node", (F.col("mass") / total).alias("restart")))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    links = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    score = base.select("node", "restart", F.col("restart").alias("score"))
    dangling = checkpointed(base.join(out, base["node"] == out["src"], "left_anti").select("node"))
    for k in range(rounds):
        flow = links.join(score, links["src"] == score["node"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        lost = score.join(dangling, "node", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        joined = base.join(flow, base["node"] == flow["dst"], "left").crossJoin(F.broadcast(lost))
        score = joined.select("node", "restart", ((1 - damping) * F.col("restart") + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("restart"))).alias("score"))
        if k % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            score = checkpointed(score)
    return score.select("node", "score")


def boost(strength: Column, hits: Column, stem_match: Column, mentioned: Column) -> Column:
    """What a node's share of the restart is multiplied by."""
    by_hits = F.when(hits > 0, F.pow(F.lit(10.0), strength) * (1 + F.log(hits))).otherwise(1.0)
    return by_hits * F.when(mentioned, MENTION_BOOST).when(stem_match, STEM_BOOST).otherwise(1.0)


def personalised(nodes: DataFrame, edges: DataFrame, signals: DataFrame) -> DataFrame:
    """signals: node, strength, hits, stem_match, mentioned.  Rank with the boosted plain rank as restart."""
    base = pagerank(nodes, adjacency(edges))
    s = base.join(signals, "node", "left")
    restart = s.select("node", (F.col("score") * boost(F.coalesce("strength", F.lit(0)), F.coalesce("hits", F.lit(0)), F.coalesce("stem_match", F.lit(False)), F.coalesce("mentioned", F.lit(False)))).alias("mass"))
    return pagerank(nodes, adjacency(edges, signals.filter("mentioned")), restart)


def closure(edges: DataFrame, start: DataFrame, reverse: bool = False, most_rounds: int = 10_000) -> DataFrame:
    """node, distance of all nodes reachable from ``start`` (node), without the start itself.

    Rounds follow the frontier: new nodes are joined, known ones taken off.  Each frontier is written once; the known
    nodes are their union, which is written anew only every ``CHECKPOINT_EVERY`` rounds, to bound the plan.  ``reverse``:
    who reaches the start.  A graph deeper than ``most_rounds`` is an error, never a shorter answer.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    known = frontier = start.select("node", F.lit(0).alias("distance")).distinct()
    for k in range(1, most_rounds + 1):
        fresh = frontier.join(steps, "node").select(F.col("next").alias("node")).distinct().join(known, "node", "left_anti")
        fresh = checkpointed(fresh.withColumn("distance", F.lit(k)))
        if fresh.isEmpty():
            return known.filter("distance > 0")
        known, frontier = known.unionByName(fresh), fresh
        if k % CHECKPOINT_EVERY == 0:
            known = checkpointed(known)
    raise RuntimeError(f"the graph is deeper than {most_rounds} rounds")


def carried_closure(reexports: DataFrame, start: DataFrame, depth: int = 8) -> DataFrame:
    """node, name reachable over re-exports (src imports from dst; renamed: the new name, or null for the same one).

    Rounds carry (node, name) backwards along the edges, at most ``depth``; pairs seen before are not followed again.
    """
    known = start.select("node", "name").distinct()
    frontier = known
    for _ in range(depth):
        moved = frontier.join(reexports, (F.col("node") == F.col("dst")) & (F.col("original").isNull() | (F.col("original") == F.col("name"))))
        fresh = checkpointed(moved.select(F.col("src").alias("node"), F.coalesce("renamed", "name").alias("name")).distinct().join(known, ["node", "name"], "left_anti"))
        if fresh.isEmpty():
            break
        known, frontier = checkpointed(known.unionByName(fresh)), fresh
    return known


def pairs_both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").union(pairs.select("dst", "src")).distinct()


def near(edges: DataFrame, origin: DataFrame) -> DataFrame:
    """Neighbours, either way, of the origin nodes, with the weight between."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("near"), "weight").union(edges.select("dst", "src", "weight"))
    return both.join(origin.select("node").distinct(), "node", "left_semi").groupBy("near").agg(F.sum("weight").alias("weight"))


def ranked_closure(reached: DataFrame, scores: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """reached: node.  By score, then path, then the line of the file's first symbol, then id, with their ``rank``."""
    from .search import total_rank

    first = symbols.groupBy(F.col("file_id").alias("node")).agg(F.min("start_line").alias("first_line"))
    rows = reached.select("node").join(scores.select("node", "score"), "node", "left").join(files.select(F.col("file_id").alias("node"), "path"), "node").join(first, "node", "left")
    rows = rows.select("node", "path", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("first_line", F.lit(0)).alias("first_line"))
    return total_rank(rows, [F.round("score", 12).desc(), F.col("path"), F.col("first_line"), F.col("node")])


def fingerprint(files: DataFrame, edges: DataFrame) -> str:
    """What rank depends on: ids and paths of files, and import edges, in any order."""
    f = files.agg(F.count("*"), F.sum(F.xxhash64("file_id", "path").cast("decimal(38,0)"))).first()
    e = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst", "weight").cast("decimal(38,0)"))).first()
    return "-".join(str(x or 0) for x in (*f, *e)).replace("--", "-n")


def cached_rank(folder: str, files: DataFrame, edges: DataFrame, keep: int = 4) -> DataFrame:
    """``pagerank`` of the import edges, kept in the folder under the graph's fingerprint; the newest ``keep`` stay."""
    spark = files.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    own = f"{folder.rstrip('/')}/{fingerprint(files, edges)}"
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(f"{own}/_SUCCESS")):
        pagerank(files.select(F.col("file_id").cast("bigint").alias("node")), adjacency(edges)).write.mode("overwrite").parquet(own)
        held = sorted(fs.listStatus(path(folder)), key=lambda s: (s.getModificationTime(), s.getPath().getName()))
        for old in held[:-keep]:
            fs.delete(old.getPath(), True)
    return spark.read.parquet(own)

"""Queries over the trade graph: nations as files, trade as imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import search as S
from ..sources.tables import file_graph, table
from .registry import TRADE, query

def thin(edges):
    """The two heaviest edges out of each node: a sparse graph."""
    return S.top_per_group(edges, ["src"], [F.desc("weight"), F.col("dst")], 2).select("src", "dst", "weight")


THIN = TRADE + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rk FROM trade), thin AS (SELECT src, dst, weight FROM ranked WHERE rk <= 2)"
NODES = "nodes AS (SELECT n_nationkey AS id, count(*) OVER () AS n FROM nation)"


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


query("edge_fold", f"WITH {TRADE} SELECT src, dst, weight FROM trade")(lambda spark, sf_dir: file_graph(spark, sf_dir))


def rank_sql(edges: str, graph: str, restart: str = "1.0 / n") -> str:
    return f"""WITH RECURSIVE {edges}, {NODES},
base AS (SELECT id, {restart} AS restart FROM nodes),
{RANK.format(r="r", base="base", graph=graph, links="links", dangling="dangling")}
SELECT node, round(score, 9) AS score FROM r_done"""


RANK = """{links} AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM {graph}),
{dangling} AS (SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM {links})),
{r} AS (
  SELECT 0 AS k, id, restart::DOUBLE AS score FROM {base}
  UNION ALL
  SELECT (SELECT max(k) FROM {r}) + 1 AS k, b.id, 0.15 * b.restart + 0.85 * (coalesce(f.flow, 0) + coalesce((SELECT sum(score) FROM {r} WHERE id IN (SELECT id FROM {dangling})), 0) * b.restart)
  FROM {base} b LEFT JOIN (SELECT l.dst, sum({r}.score * l.share) AS flow FROM {r} JOIN {links} l ON l.src = {r}.id GROUP BY 1) f ON f.dst = b.id
  WHERE (SELECT max(k) FROM {r}) < 40
),
{r}_done AS (SELECT id AS node, score FROM {r} WHERE k = 40)"""


@query("pagerank", rank_sql(TRADE, "trade"))
def pagerank(spark, sf_dir):
    return G.pagerank(nodes(spark, sf_dir), G.adjacency(file_graph(spark, sf_dir))).select("node", F.round("score", 9).alias("score"))


@query("pagerank_sparse", rank_sql(THIN, "thin"))
def pagerank_sparse(spark, sf_dir):
    return G.pagerank(nodes(spark, sf_dir), G.adjacency(thin(file_graph(spark, sf_dir)))).select("node", F.round("score", 9).alias("score"))


SIGNALS = "CASE WHEN node IN (3, 7) THEN 50.0 WHEN node = 5 THEN 10.0 ELSE 1.0 END * CASE WHEN node % 4 = 1 THEN 100.0 * (1 + ln(2.0)) ELSE 1.0 END"
PERSONAL = f"""WITH RECURSIVE {THIN}, {NODES}, base AS (SELECT id, 1.0 / n AS restart FROM nodes),
{RANK.format(r="r", base="base", graph="thin", links="links", dangling="dangling")},
boosted AS (SELECT src, dst, weight * CASE WHEN src IN (3, 7) THEN 50 ELSE 1 END AS weight FROM thin),
masses AS (SELECT node AS id, score * {SIGNALS} AS mass FROM r_done), own AS (SELECT id, mass / sum(mass) OVER () AS restart FROM masses),
{RANK.format(r="p", base="own", graph="boosted", links="plinks", dangling="pdangling")}
SELECT node, round(score, 9) AS score FROM p_done"""


@query("personalised_rank", PERSONAL)
def personalised_rank(spark, sf_dir):
    n = F.col("node")
    hit = n % 4 == 1
    signals = nodes(spark, sf_dir).select("node", F.when(hit, 2).otherwise(0).alias("strength"), F.when(hit, 2).otherwise(0).alias("hits"), (n == 5).alias("stem_match"), n.isin(3, 7).alias("mentioned"))
    return G.personalised(nodes(spark, sf_dir), thin(file_graph(spark, sf_dir)), signals).select("node", F.round("score", 9).alias("score"))


FIRST = "(SELECT min(dst) FROM thin WHERE src = 0)"


def first_target(edges):
    """The smallest target of node 0: a node that others import."""
    return edges.filter("src = 0").agg(F.min("dst").alias("node"))


def closure_sql(a: str, b: str, start: str) -> str:
    return f"WITH RECURSIVE {THIN}, c AS (SELECT {start} AS node UNION SELECT t.{b} FROM c JOIN thin t ON t.{a} = c.node) SELECT node FROM c WHERE node <> {start}"


@query("dependencies", closure_sql("src", "dst", "0"))
def dependencies(spark, sf_dir):
    return G.closure(thin(file_graph(spark, sf_dir)), nodes(spark, sf_dir).filter("node = 0")).select("node")


@query("dependents", closure_sql("dst", "src", FIRST))
def dependents(spark, sf_dir):
    edges = thin(file_graph(spark, sf_dir))
    return G.closure(edges, first_target(edges), reverse=True).select("node")


@query("paired_files", f"WITH {THIN} SELECT src, dst FROM thin UNION SELECT dst, src FROM thin")
def paired_files(spark, sf_dir):
    return G.pairs_both_ways(thin(file_graph(spark, sf_dir)))


@query("near_files", f"WITH {THIN}, b AS (SELECT src AS node, dst AS near, weight FROM thin UNION ALL SELECT dst, src, weight FROM thin) SELECT near, sum(weight)::BIGINT AS weight FROM b WHERE node IN (1, 2) GROUP BY 1")
def near_files(spark, sf_dir):
    return G.near(thin(file_graph(spark, sf_dir)), nodes(spark, sf_dir).filter("node IN (1, 2)"))


@query("reexport_closure", f"WITH RECURSIVE {THIN}, c AS (SELECT 0 AS k, {FIRST} AS node, 'x' AS name UNION SELECT k + 1, t.src, CASE WHEN t.weight % 3 = 0 THEN 'n' || t.src ELSE c.name END FROM c JOIN thin t ON t.dst = c.node WHERE k < 4) SELECT DISTINCT node, name FROM c")
def reexport_closure(spark, sf_dir):
    graph = thin(file_graph(spark, sf_dir))
    edges = graph.select("src", "dst", F.lit(None).cast("string").alias("original"), F.when(F.col("weight") % 3 == 0, F.concat(F.lit("n"), F.col("src").cast("string"))).alias("renamed"))
    start = first_target(graph).withColumn("name", F.lit("x"))
    return G.carried_closure(edges, start, depth=4)


@query("boosts", "SELECT n_nationkey AS node, round((CASE WHEN n_nationkey % 4 > 0 THEN pow(10.0, n_nationkey % 4) * (1 + ln(1 + n_nationkey % 5)) ELSE 1.0 END) * CASE WHEN n_nationkey % 7 = 0 THEN 50.0 WHEN n_nationkey % 3 = 0 THEN 10.0 ELSE 1.0 END, 6) AS boost FROM nation")
def boosts(spark, sf_dir):
    n = F.col("node")
    hits = F.when(n % 4 > 0, 1 + n % 5).otherwise(0)
    return nodes(spark, sf_dir).select("node", F.round(G.boost(n % 4, hits, n % 3 == 0, n % 7 == 0), 6).alias("boost"))


@query("tier_order", f"WITH {THIN}, m AS (SELECT dst AS node, 0 AS tier FROM thin WHERE src = 0 UNION ALL SELECT src, 1 FROM thin WHERE dst = 0 UNION ALL SELECT n_nationkey, 3 FROM nation), t AS (SELECT node, min(tier) AS tier FROM m GROUP BY 1) SELECT node, tier, row_number() OVER (ORDER BY tier, node) AS rank FROM t")
def tier_order(spark, sf_dir):
    e = thin(file_graph(spark, sf_dir))
    tiers = e.filter("src = 0").select(F.col("dst").alias("node"), F.lit(0).alias("tier")).union(e.filter("dst = 0").select("src", F.lit(1))).union(nodes(spark, sf_dir).select("node", F.lit(3)))
    best = tiers.groupBy("node").agg(F.min("tier").alias("tier"))
    return S.total_rank(best, [F.col("tier"), F.col("node")]).select("node", "tier", "rank")

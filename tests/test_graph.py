from pyspark.sql import functions as F

from skein.operators import graph as G


def frames(spark, n, edges):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    return nodes, spark.createDataFrame(edges, "src long, dst long, weight long")


def ranks(df):
    return {r["node"]: r["score"] for r in df.collect()}


def test_sinks_rank_highest_and_mass_is_kept(spark):
    nodes, edges = frames(spark, 3, [(0, 1, 1), (1, 2, 1)])
    r = ranks(G.pagerank(nodes, G.adjacency(edges)))
    assert sorted(r, key=r.get, reverse=True) == [2, 1, 0]
    assert abs(sum(r.values()) - 1) < 1e-12


def test_both_ways_of_ranking_agree(spark, monkeypatch):
    nodes, edges = frames(spark, 8, [(i, (i * 3 + 1) % 8, i + 1) for i in range(7)] + [(2, 5, 4), (6, 6, 9)])
    adjacency = G.adjacency(edges)
    restart = nodes.withColumn("mass", F.when(F.col("node") == 3, 5.0).otherwise(1.0))
    small = ranks(G.pagerank(nodes, adjacency, restart))
    monkeypatch.setattr(G, "SMALL_EDGES", -1)
    large = ranks(G.pagerank(nodes, adjacency, restart))
    assert small.keys() == large.keys()
    assert all(abs(small[k] - large[k]) < 1e-12 for k in small)


def test_closures_leave_out_the_start(spark):
    _, edges = frames(spark, 4, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (3, 2, 1)])
    start = spark.createDataFrame([(0,)], "node long")
    assert {(r["node"], r["distance"]) for r in G.closure(edges, start).collect()} == {(1, 1), (2, 2)}
    assert {r["node"] for r in G.closure(edges, start, reverse=True).collect()} == {1, 2, 3}


def test_context_nodes_push_their_targets(spark):
    nodes, edges = frames(spark, 4, [(0, 1, 1), (0, 2, 1), (3, 2, 1)])
    signals = spark.createDataFrame([(0, 4, 1, False, True)], "node long, strength int, hits int, stem_match boolean, mentioned boolean")
    r = ranks(G.personalised(nodes, edges, signals))
    assert max(r, key=r.get) == 0
    assert r[1] > r[3]


def test_renamed_reexports_stop_the_old_name(spark):
    edges = spark.createDataFrame([(1, 0, "f", "g"), (2, 1, "g", None), (3, 1, "f", None), (4, 0, None, None)], "src long, dst long, original string, renamed string")
    start = spark.createDataFrame([(0, "f")], "node long, name string")
    got = {(r["node"], r["name"]) for r in G.carried_closure(edges, start).collect()}
    assert got == {(0, "f"), (1, "g"), (2, "g"), (4, "f")}

"""Queries that read all of their input."""

import duckdb

from skein import plans

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return plans.QUERIES[name](spark, SF).collect()


def test_words_of_whole_texts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["id"]: r["words"].split(" ") for r in rows(spark, "words_of")}
    assert got.keys() == docs.keys() and max(map(len, got.values())) > 200


def test_call_graph_of_every_file(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.01/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = plans.QUERIES["call_graph"](spark, str(tmp_path)).collect()
    assert got and sorted((r["src"], r["dst"], r["weight"]) for r in got) == sorted(c.sql(plans.ORACLE_SQL["call_graph"]).fetchall())


def test_every_input_row_is_looked_up(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert len({r["path"] for r in rows(spark, "resolve_packages")}) == part.count()
    assert rows(spark, "resolve_types") and rows(spark, "resolve_namespaces")
    assert {r["given"] for r in rows(spark, "user_path")} and len(rows(spark, "user_path")) == spark.read.parquet(f"{SF}/documents.parquet").count()
    names = [r["p_name"].lower() for r in part.collect()]
    assert len(rows(spark, "exact_fold")) == (sum(n == "red ring" for n in names) or sum("red ring" in n for n in names))

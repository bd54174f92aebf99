"""Entry points on small repositories."""

import pytest
from pyspark.sql import functions as F

from skein.operators import ask as A
from skein.operators import graph as G
from skein.operators import search as S
from skein.operators import symbols as Y

CODE = {
    0: ("src/a.py", "Python", "def parse_config(x):\n    return x\n\ndef other():\n    pass\n"),
    1: ("src/b.py", "Python", "from a import parse_config\n# parse_config in a comment\ny = parse_config(1)\n"),
    2: ("tests/test_a.py", "Python", "from a import parse_config\nassert parse_config(2) == 2\n"),
    3: ("src/a_test.py", "Python", "x = 'parse_config'\n"),
    4: ("src/far.py", "Python", "parse_config = 3\n"),
}


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame([(i, *v) for i, v in CODE.items()], "file_id long, path string, language string, text string")
    symbols = spark.createDataFrame([(10, 0, "parse_config", "Function", 1), (11, 0, "other", "Function", 4), (12, 1, "run", "Function", 1)], "symbol_id long, file_id long, name string, kind string, start_line int")
    edges = spark.createDataFrame([(1, 0, "Import", 1), (2, 0, "Import", 1), (12, 10, "Call", 1)], "src long, dst long, kind string, weight long")
    return files, symbols, edges


def test_references_are_in_scope_and_outside_comments(repo):
    files, _, edges = repo
    got = [(r["path"], r["line_no"], r["column"], r["role"], r["test"], r["declaration"]) for r in A.find_refs(files, edges, "parse_config", 0, 1).collect()]
    assert got == [("src/a.py", 1, 5, "def", False, True), ("src/b.py", 1, 15, "load", False, False), ("src/b.py", 3, 5, "load", False, False), ("tests/test_a.py", 1, 15, "ref", True, False), ("tests/test_a.py", 2, 8, "assert", True, False)]
    renamed = A.find_refs(files, edges, "other", 0, reexported=files.filter("file_id = 4").select("file_id", F.lit("parse_config").alias("name"))).collect()
    assert [(r["path"], r["line_no"]) for r in renamed] == [("src/a.py", 4), ("src/far.py", 1)]


def test_task_context_by_tier(repo):
    files, symbols, edges = repo
    hits = Y.task_hits(symbols, "where is parse_config called")
    tiers = {r["file_id"]: r["tier"] for r in A.task_tiers(files, symbols, edges, hits).collect()}
    assert tiers == {0: 0, 1: 1, 3: 1}
    answer = A.resolve_context(files, symbols, edges, "where is parse_config called")
    ids = [r["file_id"] for r in answer.rows.collect()]
    assert (answer.shape, answer.total) == ("context", 3) and ids[0] == 0 and set(ids[1:3]) == {1, 3} and len(ids) == 5
    assert A.resolve_context(files, symbols, edges, "nothing here", path_filter="src/").shape == "unmatched"


def test_search_shapes(repo):
    files = repo[0]
    assert A.search_code(files, S.Search("zzz")).shape == "none"
    few = A.search_code(files, S.Search("other"))
    assert few.shape == "bodies" and [tuple(r) for r in few.rows.collect()] == [("src/a.py", 1, 5, 1)]
    grouped = A.search_code(files, S.Search("parse_config"))
    assert (grouped.shape, grouped.total) == ("grouped", 8)
    assert A.search_code(files, S.Search("parse_config"), offset=2, size=3).rows.count() == 3
    assert A.search_code(files, S.Search("parse_config"), count_only=True).rows.first()["hits"] == 8
    outside = A.search_code(files, S.Search("other", path_filter="tests/"))
    assert outside.shape == "none" and outside.rows.first()["key"] == "src/a.py"
    assert A.shape_of(61, 1) == "broad" and A.shape_of(61, 1, paged=True) == "lines" and A.shape_of(2, 1, group=True) == "grouped"


def test_symbols_fold_or_are_suggested(repo):
    symbols = repo[1].withColumn("container", F.lit(""))
    order = [F.col("symbol_id")]
    assert A.find_symbol(symbols, "parse_config", order).shape == "exact"
    assert A.find_symbol(symbols, "pars", order).shape == "matches"
    assert A.find_symbol(symbols, "config of parse", order).shape == "words"
    assert A.find_symbol(symbols, "othre", order).shape == "suggestions"


def test_page_sizes():
    assert [A.page_size(0, 9, 2500), A.page_size(3, 9, 2500), A.page_size(9, 9, 2500), A.page_size(9, 9, 700), A.page_size(9, 9, 99_000), A.page_size(9, 9, 2500, True)] == [5, 9, 25, 10, 80, 10]


def test_rank_is_kept_by_fingerprint(spark, repo, tmp_path):
    files, _, edges = repo
    imports = edges.filter("kind = 'Import'")
    folder = f"file:{tmp_path}"
    first = {tuple(r) for r in G.cached_rank(folder, files, imports).collect()}
    held = {p.name for p in tmp_path.iterdir()}
    assert {tuple(r) for r in G.cached_rank(folder, files.repartition(3), imports).collect()} == first and {p.name for p in tmp_path.iterdir()} == held
    for n in range(2, 7):
        G.cached_rank(folder, files, imports.withColumn("weight", F.col("dst") + n * F.col("src")))
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 4


def test_a_graph_too_deep_is_an_error(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(6)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert G.closure(edges, start).count() == 6
    with pytest.raises(RuntimeError):
        G.closure(edges, start, most_rounds=3)

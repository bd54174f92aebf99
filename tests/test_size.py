"""Plans and operators at sizes: nothing large goes through the driver or one task."""

import random
import re

import pytest

from skein import plans
from skein.operators import intervals as I
from skein.session import estimated_joins, measured_joins

SF = "/root/testdata/sf0.001"


def planned(df):
    """The plan before any stage has run: its broadcasts rest on estimates."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["enclosing_min", "enclosing_long", "merged_bodies", "resolve_c_family"])
def test_no_broadcast_on_an_estimate(spark, name):
    assert "Broadcast" not in planned(plans.QUERIES[name](spark, SF))


def test_estimates_hold_again(spark):
    estimated_joins(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    measured_joins(spark)
    measured_joins(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    estimated_joins(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_smallest_enclosing_against_brute_force(spark):
    r = random.Random(7)
    spans = [(r.randrange(3), f"n{r.randrange(40)}", r.choice(["Class", "Method"]), s, s + r.choice([0, 1, 3, 9, 60])) for s in (r.randrange(100) for _ in range(300))]
    points = [(n, r.randrange(4), r.randrange(-5, 170)) for n in range(500)]
    want = set()
    for n, f, at in points:
        if around := [x for x in spans if x[0] == f and x[3] <= at <= x[4]]:
            best = min(around, key=lambda x: (x[4] - x[3], x[3], x[1], x[2]))
            want.add((n, *best[1:]))
    got = I.enclosing(spark.createDataFrame(points, "id int, file_id int, line int"), spark.createDataFrame(spans, "file_id int, name string, kind string, start_line int, end_line int"))
    assert got.columns == ["id", "file_id", "line", "name", "kind", "start_line", "end_line"]
    assert {tuple(x) for x in got.select("id", "name", "kind", "start_line", "end_line").collect()} == want


@pytest.mark.parametrize("name", ["extract_csharp", "extract_vue", "extract_typescript", "extract_rust", "extract_kotlin", "extract_lua", "extract_swift", "extract_cpp", "extract_dart", "extract_symbols", "extract_visualbasic", "extract_proto", "extract_imports", "extract_shell", "extract_php", "extract_java", "extract_objc", "extract_go"])
def test_parsing_is_spread(spark, name):
    """One row group of keys is parsed by many tasks."""
    assert plans.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_rate_over_dense_windows_and_nulls(spark):
    from skein.operators import changes as C

    r = random.Random(3)
    rows = [(n, r.choice([None, r.randrange(-50, 4000), 77])) for n in range(3000)]
    times = [t for _, t in rows]
    want = {n: sum(x is None for x in times) if t is None else sum(x is not None and t - 99 <= x < t for x in times) for n, t in rows}
    got = C.rate_guard(spark.createDataFrame(rows, "id long, us long"), "us", "id", most=12, window_us=100)
    assert "WindowExec" not in planned(got) and "Window [" not in planned(got)
    assert {x["id"]: (x["us"], x["prior"], x["warned"]) for x in got.collect()} == {n: (t, want[n], want[n] >= 12) for n, t in rows}


CACHED = {
    "languages": [(3, "a", "en"), (4, "a", "de"), (5, "b", "en"), (6, "c", "fr"), (7, None, "en")],
    "null_cached": [(3, None, "en"), (4, "a", "de"), (6, "b", "en")],
    "null_alone": [(1, None, "en"), (2, "a", "en")],
}


@pytest.mark.parametrize("name", ["cache_misses", "cache_prune"])
@pytest.mark.parametrize("case", CACHED)
def test_caches_match_their_sql(spark, tmp_path, name, case):
    """Equal texts in several languages, and null texts, on either side."""
    import duckdb

    spark.createDataFrame(CACHED[case], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = plans.QUERIES[name](spark, str(tmp_path))
    want = duck.sql(plans.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["resolve_packages", "resolve_namespaces"])
def test_pairs_of_few_keys_are_dealt_over_all_cores(spark, name):
    rdd = plans.QUERIES[name](spark, SF).rdd
    assert rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_pairs_over_several_blocks(spark, monkeypatch):
    from skein.operators import resolve as R

    monkeypatch.setattr(R, "BLOCK", 7)
    imports = [(f"p{n}", f"s{n % 3}") for n in range(60)] + [("p1", "s1"), (None, "s1"), ("q", None)]
    declared = [(f"s{n % 4}", f"p{n}") for n in range(50)] + [("s1", None), (None, "p1")]
    got = R.resolve_namespaces(spark.createDataFrame(imports, "path string, spec string"), spark.createDataFrame(declared, "spec string, target string"))
    want = [(p, s, t) for p, s in imports for k, t in declared if s is not None and s == k and None not in (p, t) and p != t]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rows_of_two_blocks_are_not_held(spark):
    """One compiled stage that opens both blocks of a pair would hold all their rows."""
    from skein.operators import resolve as R

    got = R.resolve_namespaces(spark.createDataFrame([("p", "s"), ("q", "s")], "path string, spec string"), spark.createDataFrame([("s", "t"), ("s", "u")], "spec string, target string"))
    assert len(got.collect()) == 4
    final = planned(got).split("Initial Plan")[0]
    assert final.count("Generate explode") == 2 and len(re.findall(r"\*\(\d+\) Generate explode", final)) == 1


def test_tries_that_differ_in_their_ending_are_one_row(spark):
    from skein.operators import resolve as R

    imports = [("a/t/x.py", "Python", "k.m"), ("a/t/x.ts", "TypeScript", "./y"), ("a/t/x.ts", "TypeScript", "./y.js")]
    got = R.candidates(spark.createDataFrame(imports, "path string, language string, spec string")).groupBy("path", "spec").count().collect()
    assert {(r["path"], r["spec"]): r["count"] for r in got} == {("a/t/x.py", "k.m"): 3, ("a/t/x.ts", "./y"): 1, ("a/t/x.ts", "./y.js"): 2}


def test_first_try_against_brute_force(spark):
    """Names that end in endings, importers that name themselves, files twice."""
    from skein.operators import resolve as R

    assert 2 < len(R.ENDS) < R._STEP and [n for n, e in enumerate(R.ENDS) if e == ""] == [0]
    r = random.Random(5)
    names = ["a", "b", "index", "mod", "lib", "init", "__init__", "a.d", "b.js", "c\n", "index.ts\n", "é"]
    paths = ["/".join([*r.choices(names[:4], k=r.randrange(3)), r.choice(names) + r.choice([*R.ENDS, ".json", ".x", ".d.ts.ts"])]) for _ in range(900)]
    specs = {"Python": ["a", "a.b", ".a", "..", ".", "mod.index", "b.__init__"], "TypeScript": ["./a", "./b.js", "../index", "./a.d", "./index", "a/b", "/a", "./index.ts"], "Rust": ["mod a", "mod q = a.rs", "crate::a::b", "super::mod", "self::index"], "Lua": ["a", "a.init", "b.lua"], "Ruby": ["relative:a", "b"], "Java": ["a.b", "a.b.C.*"], "Shell": ["$D/a", "a.x"], "Go": ["a"]}
    imports = [(r.choice(paths), language, r.choice(specs[language])) for language in r.choices(list(specs), k=900)] + [(None, "Python", "a"), ("a.py", "Python", None), ("a.py", None, "a")]
    roots = {"Python": ["a", ""], "Java": ["", "mod"]}
    want = {}
    for p, language, s in imports:
        tries = R.RULES[language](p, s, roots.get(language, [""])) if language in R.RULES and p and s else []
        if found := [t for t in tries if t and t != p and t in set(paths)]:
            want[p, language, s] = found[0]
    got = R.resolve(spark.createDataFrame(imports, "path string, language string, spec string"), spark.createDataFrame([(p,) for p in [*paths, *paths[:50], None]], "path string"), roots).collect()
    assert len(want) > 200 and len(got) == len(want)
    assert {(x["path"], x["language"], x["spec"]): x["target"] for x in got} == want


@pytest.mark.parametrize("name", ["resolve_swift", "resolve_dotnet", "resolve_rust", "resolve_jvm", "resolve_dart_php_go"])
def test_only_languages_that_import_have_joins(spark, name):
    """A plan with the joins of every language is run and held by the driver, whatever languages there are."""
    assert planned(plans.QUERIES[name](spark, SF)).count("Join") <= 10


def test_steps_of_embedding_are_made_once(spark):
    from skein.operators import implement as I

    rows = [("d", "type", f"E{n}", True, None, None, None) for n in range(7)] + [("d", "embed", f"E{n}", True, f"E{n + 1}", None, None) for n in range(6)]
    sets, partial = I.method_sets(spark.createDataFrame(rows, I.MEMBERS))
    assert planned(partial).count("Join") <= 4
    assert sorted(r["name"] for r in partial.collect()) == ["E0", "E1"] and sets.collect() == []

import random

from skein.operators import intervals as I
from skein.operators import symbols as Y

NESTED = [("Parser", "Class", 10, 200), ("parse", "Method", 20, 80), ("getValue", "Method", 90, 120), ("Node", "Class", 130, 160), ("serialize", "Method", 140, 150), ("top_fn", "Function", 1, 5), ("parse", "Function", 300, 340), ("count", "Field", 15, 15)]


def nested(spark):
    return spark.createDataFrame([(1, *r) for r in NESTED], "file_id int, name string, kind string, start_line int, end_line int")


def test_parents_of_nested_symbols(spark):
    got = {(r["name"], r["start_line"]): (r["parent"], r["depth"]) for r in I.parents(nested(spark)).collect()}
    assert got[("parse", 20)] == ("Parser", 1)
    assert got[("serialize", 140)] == ("Node", 2)
    assert got[("parse", 300)] == (None, 0)
    assert got[("count", 15)] == ("Parser", 1)


def test_parents_equal_brute_force_where_intervals_cross(spark):
    rnd = random.Random(8)
    rows = sorted({(rnd.randrange(4), f"s{n}", rnd.choice(["Class", "Method"]), a := rnd.randrange(1, 60), a + rnd.choice([0, 2, 9, 30])) for n in range(160)})
    got = {(r["file_id"], r["name"]): (r["parent"], r["depth"]) for r in I.parents(spark.createDataFrame(rows, "file_id int, name string, kind string, start_line int, end_line int")).collect()}
    for f, name, kind, s, e in rows:
        around = [(b - a, -a, n) for g, n, k, a, b in rows if g == f and a <= s and b >= e and ((a, b) != (s, e) or (k == "Class" and kind == "Method"))]
        assert got[f, name] == (min(around)[2] if around else None, len(around))


def test_name_paths(spark):
    find = lambda p, **k: {(r["name"], r["start_line"]) for r in I.name_path(nested(spark), p, **k).collect()}
    assert find("parser") == {("Parser", 10)}
    assert find("get") == set()
    assert find("get", substring=True) == {("getValue", 90)}
    assert find("parse", substring=True) == {("Parser", 10), ("parse", 20), ("parse", 300)}
    assert find("Parser/serialize") == {("serialize", 140)}
    assert find("/parse") == {("parse", 300)}
    assert find("/Parser/parse") == {("parse", 20)}
    assert find("/Node/serialize") == set()
    assert find("Node/") == {("Node", 130)}


def test_enclosing_equals_brute_force(spark):
    rnd = random.Random(5)
    spans = [(rnd.randrange(3), f"s{n}", "Class", a := rnd.randrange(1, 400), a + rnd.choice([0, 1, 5, 60, 300])) for n in range(150)]
    points = [(rnd.randrange(3), rnd.randrange(1, 700)) for _ in range(300)]
    df = spark.createDataFrame(spans, "file_id int, name string, kind string, start_line int, end_line int")
    got = {(r["file_id"], r["line"], r["name"]) for r in I.enclosing(spark.createDataFrame(points, "file_id int, line int"), df).collect()}
    want = set()
    for f, x in points:
        inside = [(e - s, s, n) for g, n, _, s, e in spans if g == f and s <= x <= e]
        if inside:
            want.add((f, x, min(inside)[2]))
    assert got == want


def test_word_search_prefers_own_names(spark):
    rows = [(0, "CloudClient", "Struct", ""), (1, "Update", "Method", "CloudClient"), (2, "Delete", "Method", "CloudClient"), (3, "updateStore", "Function", ""), (4, "clientCount", "Variable", ""), (5, "update", "Function", "")]
    df = spark.createDataFrame(rows, "symbol_id int, name string, kind string, container string")
    got = [r["symbol_id"] for r in Y.word_search(df, ["client", "cloud", "update"]).collect()]
    assert got[0] == 1 and set(got) == {0, 1, 2}


def test_task_hits_need_an_identifier_for_the_top_strength(spark):
    names = ["processChannelError", "call", "loadConfig", *(f"channel{n}Thing" for n in range(60))]
    df = spark.createDataFrame(list(enumerate(names)), "symbol_id int, name string")
    got = {r["symbol_id"]: r["strength"] for r in Y.task_hits(df, "where is the call to loadConfig").collect()}
    assert got[2] == Y.EXACT and got.get(1) != Y.EXACT
    got = {r["symbol_id"]: r["strength"] for r in Y.task_hits(df, "find call sites of processChannelError").collect()}
    assert got[0] == Y.EXACT and not any(3 <= k for k in got)

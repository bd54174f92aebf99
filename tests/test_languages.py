"""Manifests, pre-processors, nearest files and implementors, in cases beside the registered queries."""

import random

import pytest

from skein.operators import extract as X
from skein.operators import facts as K
from skein.operators import implement as I
from skein.operators import joins as J
from skein.operators import prepare as P
from skein.operators import resolve as R


def test_manifests_that_cannot_be_read_have_no_facts():
    assert K.facts_of("a/package.json", "{not json") == []
    assert K.facts_of("a/package.json", "[1, 2]") == [] and K.facts_of("a/tsconfig.json", "") == []
    assert K.facts_of("a/pyproject.toml", "x = [") == [] and K.facts_of("a/Cargo.toml", "[workspace]\n") == []
    assert K.facts_of("a/other.json", "{}") == []


def test_comments_and_commas_in_json_strings_stay():
    text = '{"compilerOptions": {"paths": {"@/*": ["src//x/*", "a,}/*",], /* no */ }, "baseUrl": "web/"}} // end'
    assert [(k, v, at) for _, _, _, _, k, v, at in K.facts_of("p/tsconfig.base.json", text)] == [("@/*", "web/src//x/*", "p/web/src/x/*"), ("@/*", "web/a,}/*", "p/web/a,}/*"), ("*", "web/*", "p/web/*")]


def test_a_value_that_leaves_the_root_has_no_place():
    assert [f[-1] for f in K.facts_of("composer.json", '{"autoload": {"psr-4": {"A\\\\": ["../x", "y"]}}}')] == [None, "y"]


def test_rooted_takes_the_nearest_directory(spark):
    facts = spark.createDataFrame([f for p in ("pyproject.toml", "a/b/setup.py") for f in K.facts_of(p, "")], K.FACTS)
    imports = spark.createDataFrame([("a/b/c/x.py", "m"), ("a/y.py", "m")], "path string, spec string")
    assert {r["path"]: r["roots"] for r in K.rooted(imports, facts).collect()} == {"a/b/c/x.py": ["a/b/src", "a/b"], "a/y.py": ["src", ""]}


@pytest.mark.parametrize("text", ["", "\n", "#", "#if\n", "#else\n#endif\n", "@code {", "<script>", "<<EOF\n", "a\r\n#if x\r\nb\r\n#endif\r\n", "x" * 100_000])
def test_lines_stay_where_they_are(text):
    for language, path in (("CSharp", "a.cs"), ("CSharp", "a.razor"), ("VisualBasic", "a.vb"), ("Cpp", "a.cpp"), ("ObjC", "a.m"), ("Shell", "a.sh"), ("Vue", "a.vue"), ("Go", "a.go"), ("None", "a")):
        for _, out in P.prepared(path, language, text):
            assert out.count("\n") == text.count("\n")
        X.parse(path, language, text)
        P.diagnosis(language, text)


def test_nested_branches():
    text = "#if A\na\n#if 0\nb\n#else\nc\n#endif\n#elif false\nd\n#else\ne\n#endif\nf\n"
    first, last = ("".join(t.split()) for t in P.branches(text))
    assert (first, last) == ("acf", "ef")
    assert P.branches("x\n") == ["x\n"] and "".join(P.branches("#if false\na\n#endif\nb\n")).split() == ["b"]


def test_use_trees():
    assert X.use_paths("a::{b, c::{d, self}, e as f, g::*}") == ["a::b", "a::c::d", "a::c", "a::e", "a::g"]
    assert X.use_paths("a::b as c") == ["a::b"] and X.use_paths("a::{}") == [] and X.use_paths("a::{b") == []


def test_nearest_equals_brute_force(spark):
    draw = random.Random(5)
    paths = sorted({"/".join([*draw.choices("abc", k=draw.randint(0, 4)), draw.choice(["x.h", "y.h", "longer.h"])]) for _ in range(120)})
    have = spark.createDataFrame([(p.split("/")[-1], p) for p in paths], "key string, target string")
    asked = [(p, k) for p in paths for k in ("x.h", "y.h", "none.h")]

    def shared(a, b):
        x, y = a.split("/")[:-1], b.split("/")[:-1]
        return next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    want = {(p, k): min((-shared(p, t), len(t), t) for t in paths if t.split("/")[-1] == k and t != p)[-1] for p, k in asked if k != "none.h"}
    got = J.nearest_of(spark.createDataFrame(asked, "path string, key string"), have).collect()
    assert {(r["path"], r["key"]): r["target"] for r in got} == want and len(got) == len(want)


def test_names_in_angles_need_an_include_directory(spark):
    files = spark.createDataFrame([("a/include/z.h",), ("b/z.h",), ("b/m.c",)], "path string")
    imports = spark.createDataFrame([("b/m.c", "<z.h>"), ("b/m.c", '"z.h"'), ("b/m.c", "<no.h>")], "path string, spec string")
    assert {(r["spec"], r["target"]) for r in R.resolve_suffix(imports, files).collect()} == {("<z.h>", "a/include/z.h"), ('"z.h"', "b/z.h")}


def test_an_empty_repository(spark):
    none = spark.createDataFrame([], "path string, language string, text string")
    assert R.resolve_repository(none).collect() == []


def test_implementors_depth_cycles_and_cap(spark):
    def kind(name, interface):
        return ("d", "type", name, interface, None, None, None)

    rows = [kind(f"E{n}", True) for n in range(7)] + [("d", "embed", f"E{n}", True, f"E{n + 1}", None, None) for n in range(6)]
    rows += [("d", "method", "E6", True, "Go", 0, 0), ("d", "method", "E1", True, "Go", None, None), ("d", "method", "E5", True, "Go", 0, 0)]
    rows += [kind("A", True), kind("B", True), ("d", "embed", "A", True, "B", None, None), ("d", "embed", "B", True, "A", None, None), ("d", "method", "A", True, "Go", 0, 0)]
    rows += [kind(f"T{n}", False) for n in range(3)] + [("d", "method", f"T{n}", False, "Go", 0, 0) for n in range(3)]
    found, near = spark.createDataFrame(rows, I.MEMBERS), spark.createDataFrame([], "dir string, user string")
    by = {}
    for r in I.implementing(found, near).collect():
        by.setdefault(r["interface"], set()).add(r["type"])
    every = {"T0", "T1", "T2"}
    assert by == {n: every for n in ("E2", "E3", "E4", "E5", "E6", "A", "B")}
    assert I.implementing(found, near, cap=2).collect() == []

import re

import pytest

from skein.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f("x")).collect()]


def test_split_words(spark):
    assert one(spark, T.split_words, "getUserName parse_http_URL", "HTTPServer2Go", None) == [["get", "http", "name", "parse", "url", "user"], ["go", "http", "server2"], None]


def test_words_of(spark):
    assert one(spark, T.words_of, "update the cloudClients", "list_entries", "class") == [["client", "cloud", "update"], ["entry", "list"], ["class"]]


def test_mentions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("edit a.rs now",), ("edit data.rs now",), ("edit a.rs2",), ("(A.RS)",)], "t string")
    assert [r[0] for r in df.select(T.mentions_path("t", F.lit("a.rs"))).collect()] == [True, False, False, True]


@pytest.mark.parametrize(
    ("glob", "exclude", "path", "hit"),
    [
        ("*.rs", False, "a/b.rs", True),
        ("*.{ts,tsx}", False, "a/b.tsx", True),
        ("src/**", False, "x/src/a.c", True),
        ("docs", False, "a/docs/b.md", True),
        ("docs", False, "a/docs2/b.md", False),
        ("_test.go", True, "a/b_test.go", True),
        ("build", True, "a/build/x", True),
        ("build", True, "a/rebuild/x", False),
    ],
)
def test_globs(glob, exclude, path, hit):
    assert bool(re.search(T.glob_regex(glob, exclude), path)) is hit


def test_smart_case():
    assert T.smart_case("Abc") and not T.smart_case("abc") and T.smart_case("abc", regex=True) and not T.smart_case("Abc", case_sensitive=False)
    with pytest.raises(ValueError):
        T.line_matcher("a\\nb", regex=True)


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.tar.gz",), ("x.py",), (".profile",), ("a/b",)], "p string")
    got = [tuple(r) for r in df.select(T.dir_of("p"), T.base_of("p"), T.ext_of("p"), T.top_of("p"), T.ancestors(T.dir_of("p"))).collect()]
    assert got == [("a/b", "c.tar.gz", "gz", "a", ["a/b", "a", ""]), ("", "x.py", "py", ".", [""]), ("", ".profile", "", ".", [""]), ("a", "b", "", "a", ["a", ""])]


def test_lines(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a\r\n\r\n",), ("",), ("x",)], "t string")
    assert [r[0] for r in df.select(T.loc("t")).collect()] == [2, 2, 0, 1]

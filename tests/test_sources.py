from skein.operators import extract as X
from skein.operators import resolve as R
from skein.sources import scan as S


def test_tree_admission_and_language(spark, tmp_path):
    for name, data in {"a/x.py": b"import os\n", "a/b.bin": b"\0\1", "node_modules/y.js": b"1", "run": b"#!/usr/bin/env python3\nprint(1)\n", "w.h": b"class A {\n};\n", "target/gen.rs": b"x", "Cargo.toml": b"[package]\n", "deep/build/k.go": b"package k\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    t = S.tree(spark, f"file:{tmp_path}")
    rows = {r["path"]: r for r in t.withColumn("reason", S.skip_reason("path", "length", "content")).withColumn("text", S.decoded("content")).withColumn("language", S.language_by_content("path", "text")).collect()}
    assert rows["a/x.py"]["reason"] is None and rows["a/x.py"]["language"] == "Python"
    assert rows["a/b.bin"]["reason"] == "Binary" and rows["node_modules/y.js"]["reason"] == "Excluded"
    assert rows["run"]["language"] == "Python" and rows["w.h"]["language"] == "Cpp"
    assert {r["path"] for r in S.without_build_output(t).collect()} == {"a/x.py", "a/b.bin", "node_modules/y.js", "run", "w.h", "Cargo.toml", "deep/build/k.go"}


def test_decoding(spark):
    data = [b"\xef\xbb\xbfa\rb", "é".encode("utf-16"), "é".encode("latin-1"), "é".encode()]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "c binary")
    assert [r[0] for r in df.select(S.decoded("c")).collect()] == ["a\nb", "é", "é", "é"]


def test_decoding_of_other_character_sets(spark):
    texts = {
        "gbk": "# 读取文件并返回所有的行\nx = 1  # 如果没有找到就返回空值\n",
        "big5": "# 讀取檔案並傳回所有的內容\nx = 1  # 如果沒有找到就結束程式\n",
        "cp932": "# ファイルを読み込んで行を返します\nx = 1  # 見つからない場合は終了\n",
        "euc_jp": "# ファイルを読み込んで行を返します\nx = 1  # 見つからない場合は終了\n",
        "euc_kr": "# 파일을 읽어서 모든 줄을 반환합니다\nx = 1  # 찾지 못하면 종료\n",
        "cp1251": "# Читает файл и возвращает все строки\nx = 1  # Если не найдено\n",
        "koi8_r": "# Читает файл и возвращает все строки\nx = 1  # Если не найдено\n",
        "latin-1": "# Données lues à l'été, größer für Élan et Ãlgo\nx = 1  # señor niño año\n",
    }
    df = spark.createDataFrame([(k, bytearray(t.encode(k))) for k, t in texts.items()], "k string, c binary")
    assert {r["k"]: r["t"] for r in df.select("k", S.decoded("c").alias("t")).collect()} == texts


def test_masks():
    assert X.blanked('x = "a # b"  # c\ny', "Python") == 'x = "     "     \ny'
    assert X.blanked("a /* b\n c */ d // e", "Go") == "a     \n      d     "
    assert X.blanked(r'"a\" // b" c', "Java") == '"        " c'
    assert X.blanked("text # not code", "Unknown") == "text # not code"


def test_extraction_by_language():
    go = "package a\n\nimport (\n\t\"fmt\"\n)\n\ntype S struct {\n\tx int\n}\n\nfunc (s *S) Get(a, b int) (int, error) {\n\treturn helper(a)\n}\n"
    assert [(n, k, a, b, e) for n, k, _, a, b, e in X.symbols_of("Go", go)] == [("S", "Struct", 7, 9, True), ("Get", "Method", 11, 13, True)]
    assert X.imports_of("Go", go) == ["fmt"] and X.calls_of("Go", go) == [("helper", 12)]
    rb = "require 'json'\nrequire_relative 'x/y'\nmodule A\n  class B\n    def c?\n      d(1)\n    end\n  end\nend\n"
    assert X.imports_of("Ruby", rb) == ["json", "relative:x/y"]
    assert [(n, k, a, b) for n, k, _, a, b, _ in X.symbols_of("Ruby", rb)] == [("A", "Module", 3, 9), ("B", "Class", 4, 8), ("c?", "Method", 5, 7)]
    ts = "import {a} from './a';\nexport class K {\n  m() { return f(1); }\n}\nexport const g = (x: number) => x;\n"
    assert X.imports_of("TypeScript", ts) == ["./a"]
    assert [(n, k) for n, k, *_ in X.symbols_of("TypeScript", ts)] == [("K", "Class"), ("g", "Function")]


def test_method_keys():
    assert X.method_key("Get", "func (s *S) Get(a, b int) (int, error) {") == ("Get", 2, 2)
    assert X.method_key("Get", "Get(f func(a, b int) int)") == ("Get", 1, 0)
    assert X.method_key("Get", "Get(a int…") == ("Get", None, None)


def test_resolution(spark):
    files = ["app/__init__.py", "app/a.py", "app/b/c.py", "web/x.ts", "web/y/index.ts", "src/lib.rs", "src/k/mod.rs", "src/k/v.rs", "inc/h.h", "c/m.c", "c/h.h", "lib/w.rb", "s/run.sh", "s/lib.sh", "p/Foo/Bar.php", "lua/m/init.lua"]
    have = spark.createDataFrame([(f,) for f in files], "path string")
    cases = [("app/a.py", "Python", ".b.c", "app/b/c.py"), ("app/b/c.py", "Python", "app.a", "app/a.py"), ("app/b/c.py", "Python", "..", "app/__init__.py"), ("web/x.ts", "TypeScript", "./y", "web/y/index.ts"), ("src/lib.rs", "Rust", "mod k", "src/k/mod.rs"), ("src/lib.rs", "Rust", "crate::k::v::T", "src/k/v.rs"), ("c/m.c", "C", '"h.h"', "c/h.h"), ("c/m.c", "C", "<h.h>", "inc/h.h"), ("s/run.sh", "Shell", "$DIR/lib.sh", "s/lib.sh"), ("z.php", "Php", "App\\Foo\\Bar", "p/Foo/Bar.php"), ("lua/q.lua", "Lua", "m", "lua/m/init.lua"), ("app/a.py", "Python", "os", None)]
    imports = spark.createDataFrame([c[:3] for c in cases], "path string, language string, spec string")
    roots = {"C": ["inc"], "Php": ["App\\=p"], "Lua": ["lua"]}
    got = {(r["path"], r["spec"]): r["target"] for r in R.resolve(imports, have, roots).collect()}
    assert got == {(p, s): t for p, _, s, t in cases if t}


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, path string")
    S.write_snapshot(spark, str(tmp_path / "s"), 3, files=df)
    assert S.read_snapshot(spark, str(tmp_path / "s"), 3, "files").collect() == df.collect()


def test_snapshots_are_read_whole_or_not_at_all(spark, tmp_path):
    import pytest

    root, df = f"file:{tmp_path}/s", spark.range(3)
    S.write_snapshot(spark, root, 1, files=df, edges=df.limit(1))
    assert S.read_snapshot(spark, root, 1, "files").count() == 3
    df.write.parquet(f"{root}/version=2/files")  # a writer that died
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, root, 2, "files")
    with pytest.raises(KeyError):
        S.read_snapshot(spark, root, 1, "symbols")


def test_report_is_one_file_replaced_in_one_step(spark, tmp_path):
    gaps = spark.createDataFrame([("TooLarge", 2)], "reason string, n long")
    languages = spark.createDataFrame([("Go", 3, 10), (None, 1, 1)], "language string, files long, loc long")
    for _ in range(2):
        S.write_report(S.report_lines(gaps, languages), f"{tmp_path}/report.md")
    assert (tmp_path / "report.md").read_text().split("\n")[:6] == ["# Coverage", "", "| language | files | lines |", "|-|-|-|", "| Go | 3 | 10 |", "| - | 1 | 1 |"]
    assert not (tmp_path / "report.md.part").exists()


def test_declared_excludes_are_directories(spark):
    df = spark.createDataFrame([("gen/a.py",), ("gen2/a.py",), ("x/gen/a.py",), ("gen",)], "path string")
    assert {r["path"] for r in S.without_declared(df, ["./gen/"]).filter("reason = 'Ignored'").collect()} == {"gen/a.py", "gen"}

"""Queries over sources of every language: what is extracted from them, where their imports lead, where they cannot be read.

The tables hold no code, so each row of ``part`` stands for a small repository: the texts below with its key for ``{k}``.
What must come out is written by hand beside each text, and the SQL is those values for every row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators import implement as I
from ..operators import resolve as R
from ..session import spread
from ..sources.tables import table
from .registry import query

#: language -> (path, text, rows of what, name, kind, first line, last line).
SOURCES = {
    "Go": [("g{k}.go", 'package g\n\nimport (\n\t"fmt"\n\tx "example.com/x{k}"\n)\n\ntype S{k} struct {\n\ta int\n}\n\ntype I{k} interface {\n\tDo() error\n}\n\nfunc (s *S{k}) Do() error {\n\treturn x.Run(`no(`)\n}\n', [("import", "fmt", "", 0, 0), ("import", "example.com/x{k}", "", 0, 0), ("symbol", "S{k}", "Struct", 8, 10), ("symbol", "I{k}", "Interface", 12, 14), ("symbol", "Do", "Method", 16, 18), ("call", "Do", "", 13, 13), ("call", "Run", "", 17, 17)])],
    "Java": [("J{k}.java", "package a.b;\n\nimport a.c.D{k};\nimport static a.c.E.f;\nimport a.d.*;\n\npublic class J{k} {\n    // class No\n    public int run(int x) {\n        return go{k}(x);\n    }\n}\n", [("import", "a.c.D{k}", "", 0, 0), ("import", "a.c.E.f", "", 0, 0), ("import", "a.d.*", "", 0, 0), ("symbol", "J{k}", "Class", 7, 12), ("symbol", "run", "Method", 9, 11), ("call", "go{k}", "", 10, 10)])],
    "Kotlin": [("K{k}.kt", "package a\n\nimport b.C{k}\n\ninterface I{k}\n\nclass K{k} {\n    fun run(x: Int): Int {\n        return go(x)\n    }\n}\n", [("import", "b.C{k}", "", 0, 0), ("symbol", "I{k}", "Interface", 5, 5), ("symbol", "K{k}", "Class", 7, 11), ("symbol", "run", "Method", 8, 10), ("call", "go", "", 9, 9)])],
    "Rust": [("r{k}.rs", 'use crate::a::{b{k}, c::{self, D}};\nuse std::fmt as f;\n#[path = "other/z{k}.rs"]\nmod z;\n\npub struct S{k} {\n    a: u32,\n}\n\nimpl S{k} {\n    pub fn run(&self) -> u32 {\n        go{k}(self.a)\n    }\n}\n', [("import", "crate::a::b{k}", "", 0, 0), ("import", "crate::a::c", "", 0, 0), ("import", "crate::a::c::D", "", 0, 0), ("import", "std::fmt", "", 0, 0), ("import", "mod z = other/z{k}.rs", "", 0, 0), ("symbol", "S{k}", "Struct", 6, 8), ("symbol", "run", "Method", 11, 13), ("call", "go{k}", "", 12, 12)])],
    "CSharp": [
        ("C{k}.cs", "using A.B{k};\nnamespace N {\n#if DEBUG\n  public class D{k} {\n  }\n#else\n  public class R{k} {\n  }\n#endif\n#if false\n  public class Z { }\n#endif\n}\n", [("import", "A.B{k}", "", 0, 0), ("symbol", "N", "Module", 2, 13), ("symbol", "D{k}", "Class", 4, 5), ("symbol", "R{k}", "Class", 7, 8)]),
        ("P{k}.razor", "@using My.Space{k}\n<p>@(x)</p>\n@code {\n  public int Run(int a) {\n    return Go{k}(a);\n  }\n}\n<b>class No</b>\n", [("import", "My.Space{k}", "", 0, 0), ("symbol", "Run", "Method", 4, 6), ("call", "Go{k}", "", 5, 5)]),
    ],
    "VisualBasic": [("v{k}.vb", "Imports A.B{k}\n#If DEBUG Then\nPublic Class D{k}\nEnd Class\n#Else\nPublic Class R{k}\nEnd Class\n#End If\n", [("import", "A.B{k}", "", 0, 0), ("symbol", "D{k}", "Class", 3, 4), ("symbol", "R{k}", "Class", 6, 7)])],
    "Cpp": [("c{k}.cpp", '#include "a/b{k}.h"\n#include <vector>\n#define X(y) \\\n  class y {}\nclass FOO_API Bar{k} {\n};\n#if 0\nclass No {\n};\n#endif\nTEST_CASE("adds") {\n  go();\n}\nint f{k}(int a) {\n  return g(a);\n}\n', [("import", '"a/b{k}.h"', "", 0, 0), ("import", "<vector>", "", 0, 0), ("symbol", "Bar{k}", "Class", 5, 6), ("symbol", "TEST_CASE", "Function", 11, 13), ("call", "go", "", 12, 12), ("symbol", "f{k}", "Function", 14, 16), ("call", "g", "", 15, 15)])],
    "ObjC": [("o{k}.m", '#import "O{k}.h"\nNS_ASSUME_NONNULL_BEGIN\n@interface O{k} : NSObject\n- (void)go:(int)x NS_UNAVAILABLE;\n@end\ntypedef NS_ENUM(NSInteger, Kind{k}) {\n  K1,\n};\nNS_ASSUME_NONNULL_END\n', [("import", '"O{k}.h"', "", 0, 0), ("symbol", "O{k}", "Class", 3, 4), ("symbol", "go", "Method", 4, 4), ("symbol", "Kind{k}", "Enum", 6, 8)])],
    "TypeScript": [("t{k}.ts", "import { a } from './a{k}';\nexport * from \"./b\";\n\nexport interface Box{k}<in out T> {\n  [key: string]: T;\n}\nexport const view = (a: A & B) => {\n  go(a, 'no()');\n};\nenum E{k} { X }\n", [("import", "./a{k}", "", 0, 0), ("import", "./b", "", 0, 0), ("symbol", "Box{k}", "Interface", 4, 6), ("symbol", "view", "Function", 7, 9), ("call", "go", "", 8, 8), ("symbol", "E{k}", "Enum", 10, 10)])],
    "Vue": [("x/My{k}.vue", '<template>\n  <Child @click="go" :a="fmt(b)"/>{{ show{k}(x) }}\n</template>\n<script setup lang="ts">\nimport Child from "./Child{k}.vue"\nfunction go(): void {\n  run()\n}\n</script>\n<!-- <script>function no(){}</script> -->\n', [("symbol", "My{k}", "Module", 1, 10), ("import", "./Child{k}.vue", "", 0, 0), ("symbol", "go", "Function", 6, 8), ("call", "Child", "", 2, 2), ("call", "go", "", 2, 2), ("call", "fmt", "", 2, 2), ("call", "show{k}", "", 2, 2), ("call", "run", "", 7, 7)])],
    "Shell": [("s{k}.bats", 'cat <<EOF\nno() {\nEOF\n@test "adds {k}" {\n  run x\n}\nsource ./lib{k}.sh\n', [("symbol", "adds {k}", "Function", 4, 6), ("import", "./lib{k}.sh", "", 0, 0)]), ("z{k}.zsh", "function one{k} two {\n  echo\n}\nload() {\n  :\n}\n", [("symbol", "one{k}", "Function", 1, 3), ("symbol", "load", "Function", 4, 6)])],
    "Ruby": [("r{k}.rb", "require 'json'\nrequire_relative 'x{k}'\nmodule A{k}\n  class B\n    def c?(d)\n      e(d)\n    end\n  end\nend\n", [("import", "json", "", 0, 0), ("import", "relative:x{k}", "", 0, 0), ("symbol", "A{k}", "Module", 3, 9), ("symbol", "B", "Class", 4, 8), ("symbol", "c?", "Method", 5, 7), ("call", "e", "", 6, 6)])],
    "Lua": [("l{k}.lua", "local m = require('a.b{k}')\nlocal function f{k}(x)\n  return g(x) -- no(x)\nend\n", [("import", "a.b{k}", "", 0, 0), ("call", "require", "", 1, 1), ("symbol", "f{k}", "Function", 2, 4), ("call", "g", "", 3, 3)])],
    "Php": [("p{k}.php", "<?php\nuse App\\M{k};\nrequire 'lib/x{k}.php';\nclass P{k} extends M{k} {\n  public function run($a) {\n    return go($a); # no($a)\n  }\n}\n", [("import", "App\\M{k}", "", 0, 0), ("import", "lib/x{k}.php", "", 0, 0), ("symbol", "P{k}", "Class", 4, 8), ("symbol", "run", "Method", 5, 7), ("call", "go", "", 6, 6)])],
    "Dart": [("d{k}.dart", "import 'package:a/b{k}.dart';\nclass D{k} {\n}\nint f{k}(int x) {\n  return g(x);\n}\n", [("import", "package:a/b{k}.dart", "", 0, 0), ("symbol", "D{k}", "Class", 2, 3), ("symbol", "f{k}", "Function", 4, 6), ("call", "g", "", 5, 5)])],
    "Proto": [("m{k}.proto", 'import "a/b{k}.proto";\nmessage M{k} {\n  int32 a = 1;\n}\nservice S{k} {\n}\n', [("import", "a/b{k}.proto", "", 0, 0), ("symbol", "M{k}", "Struct", 2, 4), ("symbol", "S{k}", "Interface", 5, 6)])],
    "Swift": [("s{k}.swift", "import Core{k}\nprotocol P{k} {\n}\nstruct S{k} {\n  func run(a: Int) -> Int {\n    return go(a)\n  }\n}\n", [("import", "Core{k}", "", 0, 0), ("symbol", "P{k}", "Interface", 2, 3), ("symbol", "S{k}", "Struct", 4, 8), ("symbol", "run", "Method", 5, 7), ("call", "go", "", 6, 6)])],
}

#: name -> (path, language, text) of a repository's files, and (path, spec, target) of the imports that lead somewhere.  Names
#: without {k} stand in every repository, so the nearest must be found among all.
REPOSITORIES = {
    "typescript": (
        [("w{k}/tsconfig.json", "Json", '{ // paths\n  "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"], "@lib/deep/*": ["deep/*"], "only": ["lib/one.ts"],}}}'), ("w{k}/packages/ui/package.json", "Json", '{"name": "@acme{k}/ui", "main": "./main.js"}'), ("w{k}/packages/ui/main.ts", "TypeScript", ""), ("w{k}/packages/ui/src/button.ts", "TypeScript", ""), ("w{k}/lib/one.ts", "TypeScript", ""), ("w{k}/deep/two.tsx", "Tsx", ""), ("w{k}/app/side/index.ts", "TypeScript", ""),
         ("w{k}/app/main.ts", "TypeScript", "import a from '@lib/one';\nimport b from '@lib/deep/two';\nimport c from 'only';\nimport d from '@acme{k}/ui';\nimport e from '@acme{k}/ui/button';\nimport f from './side';\nimport g from 'react';\nimport h from '@lib/none';\n")],
        [("w{k}/app/main.ts", "@lib/one", "w{k}/lib/one.ts"), ("w{k}/app/main.ts", "@lib/deep/two", "w{k}/deep/two.tsx"), ("w{k}/app/main.ts", "only", "w{k}/lib/one.ts"), ("w{k}/app/main.ts", "@acme{k}/ui", "w{k}/packages/ui/main.ts"), ("w{k}/app/main.ts", "@acme{k}/ui/button", "w{k}/packages/ui/src/button.ts"), ("w{k}/app/main.ts", "./side", "w{k}/app/side/index.ts")],
    ),
    "python_roots": (
        [("y{k}/pyproject.toml", "Toml", '[tool.setuptools.packages.find]\nwhere = ["py"]\n'), ("y{k}/py/core/__init__.py", "Python", ""), ("y{k}/py/core/util.py", "Python", ""), ("y{k}/src/extra.py", "Python", ""), ("y{k}/tests/test_a.py", "Python", "import core.util\nimport extra\nfrom core import x\nimport os\n")],
        [("y{k}/tests/test_a.py", "core.util", "y{k}/py/core/util.py"), ("y{k}/tests/test_a.py", "extra", "y{k}/src/extra.py"), ("y{k}/tests/test_a.py", "core", "y{k}/py/core/__init__.py")],
    ),
    "jvm": (
        [("j{k}/src/main/java/a{k}/b/C.java", "Java", "package a{k}.b;\npublic class C {\n}\n"), ("j{k}/src/main/java/a{k}/b/D.java", "Java", "package a{k}.b;\npublic class D {\n}\n"), ("j{k}/src/main/kotlin/Ext.kt", "Kotlin", "package a{k}.x\n\nfun help(x: Int) {\n}\n"), ("j{k}/src/main/kotlin/More.kt", "Kotlin", "package a{k}.x\n\nfun help(x: String) {\n}\n"),
         ("j{k}/src/test/java/T.java", "Java", "import a{k}.b.*;\nimport a{k}.b.C.Inner;\nimport java.util.List;\n"), ("j{k}/src/test/kotlin/T.kt", "Kotlin", "import a{k}.x.help\n")],
        [("j{k}/src/test/java/T.java", "a{k}.b.*", "j{k}/src/main/java/a{k}/b/C.java"), ("j{k}/src/test/java/T.java", "a{k}.b.*", "j{k}/src/main/java/a{k}/b/D.java"), ("j{k}/src/test/java/T.java", "a{k}.b.C.Inner", "j{k}/src/main/java/a{k}/b/C.java"), ("j{k}/src/test/kotlin/T.kt", "a{k}.x.help", "j{k}/src/main/kotlin/Ext.kt"), ("j{k}/src/test/kotlin/T.kt", "a{k}.x.help", "j{k}/src/main/kotlin/More.kt")],
    ),
    "rust": (
        [("u{k}/tools/my-kit/Cargo.toml", "Toml", '[package]\nname = "kit-{k}"\n'), ("u{k}/tools/my-kit/src/lib.rs", "Rust", "pub mod part;\n"), ("u{k}/tools/my-kit/src/part.rs", "Rust", ""), ("u{k}/app/src/far/z.rs", "Rust", ""), ("u{k}/app/src/a/mod.rs", "Rust", ""), ("u{k}/app/src/a/b.rs", "Rust", ""),
         ("u{k}/app/src/main.rs", "Rust", 'use crate::a::{b::X, Y};\nuse kit_{k}::part::Z;\n#[path = "far/z.rs"]\nmod q;\nuse std::fmt;\n')],
        [("u{k}/tools/my-kit/src/lib.rs", "mod part", "u{k}/tools/my-kit/src/part.rs"), ("u{k}/app/src/main.rs", "crate::a::b::X", "u{k}/app/src/a/b.rs"), ("u{k}/app/src/main.rs", "crate::a::Y", "u{k}/app/src/a/mod.rs"), ("u{k}/app/src/main.rs", "kit_{k}::part::Z", "u{k}/tools/my-kit/src/part.rs"), ("u{k}/app/src/main.rs", "mod q = far/z.rs", "u{k}/app/src/far/z.rs")],
    ),
    "c_family": (
        [("c{k}/include/net/sock.h", "C", ""), ("c{k}/deps/x/include/zip.h", "C", ""), ("c{k}/deps/deeper/private/zip.h", "C", ""), ("c{k}/src/near.h", "C", ""), ("c{k}/src/main.c", "C", '#include "near.h"\n#include <net/sock.h>\n#include "zip.h"\n#include <stdio.h>\n'), ("c{k}/deps/deeper/main.m", "ObjC", '#import <zip.h>\n#import "private/zip.h"\n')],
        [("c{k}/src/main.c", '"near.h"', "c{k}/src/near.h"), ("c{k}/src/main.c", "<net/sock.h>", "c{k}/include/net/sock.h"), ("c{k}/src/main.c", '"zip.h"', "c{k}/deps/x/include/zip.h"), ("c{k}/deps/deeper/main.m", "<zip.h>", "c{k}/deps/x/include/zip.h"), ("c{k}/deps/deeper/main.m", '"private/zip.h"', "c{k}/deps/deeper/private/zip.h")],
    ),
    "dotnet": (
        [("n{k}/A.cs", "CSharp", "namespace Acme{k}.Core {\n  public class A {\n  }\n}\n"), ("n{k}/B.vb", "VisualBasic", "Namespace Acme{k}.Core\nPublic Class B\nEnd Class\nEnd Namespace\n"), ("n{k}/Use.vb", "VisualBasic", "Imports Acme{k}.Core\nImports System\n"), ("n{k}/Use.cs", "CSharp", "using static Acme{k}.Core.A;\n")],
        [("n{k}/Use.vb", "Acme{k}.Core", "n{k}/A.cs"), ("n{k}/Use.vb", "Acme{k}.Core", "n{k}/B.vb"), ("n{k}/Use.cs", "Acme{k}.Core.A", "n{k}/A.cs")],
    ),
    "swift": (
        [("s{k}/Package.swift", "Swift", 'let p = Package(targets: [.target(name: "Core", path: "Code/Core"), .target(name: "App", dependencies: ["Core"])])\n'), ("s{k}/Code/Core/Zed.swift", "Swift", ""), ("s{k}/Code/Core/Sub/Abc.swift", "Swift", ""), ("s{k}/Sources/App/App.swift", "Swift", "import Core\nimport Foundation\n"), ("s{k}/Tests/T.swift", "Swift", "import App\n")],
        [("s{k}/Sources/App/App.swift", "Core", "s{k}/Code/Core/Zed.swift"), ("s{k}/Tests/T.swift", "App", "s{k}/Sources/App/App.swift")],
    ),
    "dart_php_go": (
        [("d{k}/pkg/pubspec.yaml", "Yaml", "name: kit{k}\n"), ("d{k}/pkg/lib/a.dart", "Dart", ""), ("d{k}/app/main.dart", "Dart", "import 'package:kit{k}/a.dart';\nimport 'dart:io';\n"),
         ("h{k}/composer.json", "Json", '{"autoload": {"psr-4": {"App\\\\": "app/", "App\\\\Deep\\\\": "deep/"}}}'), ("h{k}/app/M.php", "Php", ""), ("h{k}/deep/N.php", "Php", ""), ("h{k}/web/x.php", "Php", "<?php\nuse App\\M;\nuse App\\Deep\\N;\n"),
         ("o{k}/go.mod", "Go", "module example.com/m{k}\n"), ("o{k}/kit/a.go", "Go", ""), ("o{k}/kit/a_test.go", "Go", ""), ("o{k}/main.go", "Go", 'package main\n\nimport "example.com/m{k}/kit"\n')],
        [("d{k}/app/main.dart", "package:kit{k}/a.dart", "d{k}/pkg/lib/a.dart"), ("h{k}/web/x.php", "App\\M", "h{k}/app/M.php"), ("h{k}/web/x.php", "App\\Deep\\N", "h{k}/deep/N.php"), ("o{k}/main.go", "example.com/m{k}/kit", "o{k}/kit/a.go")],
    ),
}

#: (path, language, text) and (line, what, class) of the first place of error, None if there is none.
BROKEN = [("a{k}.cpp", "Cpp", "int f() {\n  FOO_BEGIN(x\n}\n", (3, "unexpected }", "macro")), ("b{k}.java", "Java", "class A {\n void f() {\n }\n", (1, "{ is not closed", "other")), ("c{k}.py", "Python", "a = '('\nb = (1]\n", (2, "unexpected ]", "other")), ("d{k}.go", "Go", "func a() {}\n", None), ("e{k}.txt", "Text", "(((", None)]


def _literal(value: object) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") t({columns})"


def _filled(column: str) -> str:
    return f"replace({column}, '{{k}}', p_partkey::VARCHAR) AS {column}"


def texts(spark, sf_dir, files: list[tuple[str, str, str]]):
    """Every file of every repository."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(n).alias("language"), F.lit(t).alias("text")) for p, n, t in files)))
    keys = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("_k")), "_k")
    rows = keys.select("_k", each.alias("f"))
    return rows.select(*(F.replace(f"f.{c}", F.lit("{k}"), "_k").alias(c) for c in ("path", "language", "text")))


def _extraction(language: str) -> None:
    rows = [(path, *r) for path, _, found in SOURCES[language] for r in found]

    @query(f"extract_{language.lower()}", f"SELECT {_filled('path')}, what, {_filled('name')}, kind, first_line, last_line FROM part, {_values(rows, 'path, what, name, kind, first_line, last_line')}")
    def extraction(spark, sf_dir):
        parsed = X.parsed(texts(spark, sf_dir, [(p, language, t) for p, t, _ in SOURCES[language]]))
        shape = "array<struct<what:string,name:string,kind:string,first_line:int,last_line:int>>"
        symbols = F.transform("symbols", lambda s: F.struct(F.lit("symbol"), s["name"], s["kind"], s["start_line"], s["end_line"])).cast(shape)
        imports = F.transform("imports", lambda i: F.struct(F.lit("import"), i, F.lit(""), F.lit(0), F.lit(0))).cast(shape)
        calls = F.transform("calls", lambda c: F.struct(F.lit("call"), c["callee"], F.lit(""), c["line"], c["line"])).cast(shape)
        return parsed.select("path", F.inline(F.concat(symbols, imports, calls)))


def _resolution(name: str) -> None:
    files, found = REPOSITORIES[name]

    @query(f"resolve_{name}", f"SELECT {_filled('path')}, {_filled('spec')}, {_filled('target')} FROM part, {_values(found, 'path, spec, target')}")
    def resolution(spark, sf_dir):
        return R.resolve_repository(texts(spark, sf_dir, files)).select("path", "spec", "target")


for _language in SOURCES:
    _extraction(_language)
for _name in REPOSITORIES:
    _resolution(_name)


@query("syntax_errors", f"SELECT {_filled('path')}, line, what, class FROM part, {_values([(p, *d) for p, _, _, d in BROKEN if d], 'path, line, what, class')}")
def syntax_errors(spark, sf_dir):
    return X.diagnosed(texts(spark, sf_dir, [b[:3] for b in BROKEN]))


GO = [
    ("i{k}/go.mod", "Go", "module example.com/i{k}\n"),
    ("i{k}/p/iface.go", "Go", "package p\n\ntype Closer interface {\n\tClose() error\n}\n\ntype Store interface {\n\tCloser\n\tGet(key string, n int) (string, error)\n}\n\ntype Odd interface {\n\tio.Reader\n\tClose() error\n}\n\ntype Own struct {\n}\n\nfunc (o Own) Close() error {\n\treturn nil\n}\n"),
    ("i{k}/q/types.go", "Go", 'package q\n\nimport "example.com/i{k}/p"\n\ntype base struct {\n}\n\nfunc (b *base) Close() error {\n\treturn nil\n}\n\ntype Disk struct {\n\t*base\n\tn int\n}\n\nfunc (d *Disk) Get(key string, n int) (string, error) {\n\treturn key, nil\n}\n\ntype Bad struct {\n\tbase\n}\n\nfunc (b *Bad) Get(key string) (string, error) {\n\treturn key, nil\n}\n'),
    ("i{k}/far/types.go", "Go", "package far\n\ntype Far struct {\n}\n\nfunc (f Far) Close() error {\n\treturn nil\n}\n"),
]
IMPLEMENT = [("i{k}/p", "Closer", "i{k}/p", "Own"), ("i{k}/p", "Closer", "i{k}/q", "base"), ("i{k}/p", "Closer", "i{k}/q", "Disk"), ("i{k}/p", "Closer", "i{k}/q", "Bad"), ("i{k}/p", "Store", "i{k}/q", "Disk")]


@query("implementing", f"SELECT {_filled('dir')}, interface, {_filled('type_dir')}, type FROM part, {_values(IMPLEMENT, 'dir, interface, type_dir, type')}")
def implementing(spark, sf_dir):
    files = texts(spark, sf_dir, GO)
    near = R.resolve_repository(files).select(T.dir_of("target").alias("dir"), T.dir_of("path").alias("user")).distinct()
    return I.implementing(I.members(files), near)


@query(
    "reparsed",
    """WITH p AS (SELECT p_partkey AS k FROM part)
SELECT 'm' || k || '.py' AS path, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'old' END || k AS name FROM p WHERE k % 3 <> 1
UNION ALL SELECT 'n' || k || '.py', 'made' || k FROM p WHERE k % 3 = 1""",
)
def reparsed(spark, sf_dir):
    """Of the files before, one in three is modified, one removed, and one made beside the removed one."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    code = "concat({0}, k, '.py') AS path", "'Python' AS language", "concat('def ', {1}, k, '():\\n    pass\\n') AS text"
    old = k.selectExpr(*(c.format("'m'", "'old'") for c in code))
    now = k.filter("k % 3 != 1").selectExpr(*(c.format("'m'", "if(k % 3 = 0, 'new', 'old')") for c in code)).union(k.filter("k % 3 = 1").selectExpr(*(c.format("'n'", "'made'") for c in code)))
    changes = k.filter("k % 3 < 2").selectExpr("concat('m', k, '.py') AS path", "if(k % 3 = 0, 'modified', 'removed') AS kind").union(k.filter("k % 3 = 1").selectExpr("concat('n', k, '.py')", "'created'"))
    return X.reparsed(X.parsed(old), now, changes).select("path", F.explode("symbols").alias("s")).select("path", F.col("s.name").alias("name"))

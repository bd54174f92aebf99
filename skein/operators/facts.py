"""What manifests and declarations say about a repository, as tables that import resolution joins.

``manifests`` reads project files (pyproject, package.json, tsconfig, pubspec, composer, Cargo, Package.swift, go.mod) into
rows ``language, dir, kind, ord, key, value, at``; ``dir`` is the manifest's own directory, ``at`` the value seen from the
root, null where it leaves it.  ``declared`` gives the packages and
the full names of what sources declare.  Nothing here is collected: importers meet their facts by joins on directories.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from posixpath import basename, dirname

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import bounded_batches
from .resolve import join_rel

FACTS = "language string, dir string, kind string, ord int, key string, value string, at string"
_MANIFEST = r"(^|/)(pyproject\.toml|setup\.py|setup\.cfg|package\.json|[tj]sconfig(\.[\w-]+)?\.json|pubspec\.yaml|composer\.json|Cargo\.toml|Package\.swift|go\.mod)$"


def _json(text: str) -> dict:
    """JSON that may hold comments and commas before a closing bracket; strings stay as they are."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.DOTALL)
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept)
    out = json.loads(kept)
    return out if isinstance(out, dict) else {}


def _at(value: object, *keys: str) -> object:
    """The value under nested keys, None where a step is missing or no table."""
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _texts(value: object) -> list[str]:
    return [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, str)]


def _python(text: str) -> list[tuple[str, str, str]]:
    doc = tomllib.loads(text)
    found = [*_texts(_at(doc, "tool", "setuptools", "packages", "find", "where")), *_texts(_at(doc, "tool", "setuptools", "package-dir", ""))]
    packages = _at(doc, "tool", "poetry", "packages")
    found += [p["from"] for p in packages if isinstance(p, dict) and isinstance(p.get("from"), str)] if isinstance(packages, list) else []
    return [("root", "", v) for v in [*found, "src", ""]]


def _script(text: str) -> list[tuple[str, str, str]]:
    doc = _json(text)
    paths, base = _at(doc, "compilerOptions", "paths"), _texts(_at(doc, "compilerOptions", "baseUrl"))
    start = base[0].rstrip("/") + "/" if base else ""
    out = [("alias", key, start + v) for key, values in (paths.items() if isinstance(paths, dict) else ()) for v in _texts(values)]
    return out + [("alias", "*", start + "*")] * bool(base)


def _package(text: str) -> list[tuple[str, str, str]]:
    doc = _json(text)
    name = _texts(doc.get("name"))
    entries = [re.sub(r"^\./", "", v) for k in ("types", "module", "main") for v in _texts(doc.get(k))]
    return [("package", n, v) for n in name for v in [*entries, "src/index", "index"]]


def _swift(text: str) -> list[tuple[str, str, str]]:
    out = []
    for m in re.finditer(r'\.(target|testTarget|executableTarget)\s*\(\s*name:\s*"([^"]+)"((?:[^()]|\([^()]*\))*)\)', text):
        path = re.search(r'\bpath:\s*"([^"]+)"', m[3])
        out.append(("target", m[2], path[1].rstrip("/") if path else f"{'Tests' if m[1] == 'testTarget' else 'Sources'}/{m[2]}"))
    return out


def facts_of(path: str, text: str) -> list[tuple[str, str, str, int, str, str, str | None]]:
    """The facts of one manifest in its own order; one that cannot be read has none."""
    name, found, language = basename(path), [], ""
    try:
        if name in ("pyproject.toml", "setup.py", "setup.cfg"):
            language, found = "Python", _python(text) if name == "pyproject.toml" else [("root", "", v) for v in ("src", "")]
        elif name == "package.json":
            language, found = "TypeScript", _package(text)
        elif "config." in name:
            language, found = "TypeScript", _script(text)
        elif name == "pubspec.yaml":
            language, found = "Dart", [("package", m[1], "lib") for m in re.finditer(r"(?m)^name:\s*['\"]?(\w+)", text)]
        elif name == "composer.json":
            doc, language = _json(text), "Php"
            for part in ("autoload", "autoload-dev"):
                spaces = _at(doc, part, "psr-4")
                found += [("namespace", k, v) for k, vs in (spaces.items() if isinstance(spaces, dict) else ()) for v in _texts(vs)]
        elif name == "Cargo.toml":
            crate = _texts(_at(tomllib.loads(text), "package", "name"))
            language, found = "Rust", [("package", c.replace("-", "_"), "src") for c in crate]
        elif name == "Package.swift":
            language, found = "Swift", _swift(text)
        elif name == "go.mod":
            language, found = "Go", [("module", m[1], "") for m in re.finditer(r"(?m)^module\s+\"?([^\s\"]+)", text)]
    except (ValueError, RecursionError):
        return []
    return [(language, dirname(path), kind, n, key, value, join_rel(dirname(path), value)) for n, (kind, key, value) in enumerate(found)]


def manifests(files: DataFrame) -> DataFrame:
    """files: path, text.  The facts of all manifests; only their files reach Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [f for path, text in zip(batch["path"], batch["text"], strict=True) for f in facts_of(path, text or "")]
            yield pd.DataFrame(rows, columns=["language", "dir", "kind", "ord", "key", "value", "at"])

    bounded_batches(files.sparkSession)
    return files.filter(F.col("path").rlike(_MANIFEST)).select("path", "text").mapInPandas(run, FACTS)


def rooted(imports: DataFrame, facts: DataFrame, kind: str = "root") -> DataFrame:
    """imports with ``roots``: the values of the nearest directory above the importer that has such facts, in their order;
    imports without any have null.  facts: those of one language.  Of namespaces a root is prefix=directory."""
    at = F.concat("key", F.lit("="), "at") if kind == "namespace" else F.col("at")
    roots = facts.filter((F.col("kind") == kind) & F.col("at").isNotNull()).withColumn("at", at).groupBy(F.col("dir").alias("_d")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "at"))), lambda x: x["at"]).alias("_roots"))
    up = imports.select("path").distinct().select("path", F.explode(T.ancestors(T.dir_of("path"))).alias("_d"))
    best = up.join(roots, "_d").groupBy("path").agg(F.max_by("_roots", F.length("_d")).alias("roots"))
    return imports.join(best, "path", "left")


def keyed(imports: DataFrame, facts: DataFrame, key: Column) -> DataFrame:
    """imports with ``roots``: name=directory of the packages that the specifier names by ``key``, the nearest to the importer
    first; imports of other names have null.  facts: packages of one language."""
    asked = imports.select("path", "spec", key.alias("key")).distinct()
    near = F.struct((-T.shared_segments("path", F.concat("dir", F.lit("/x")))).alias("a"), F.length("at").alias("b"), F.concat("key", F.lit("="), "at").alias("c"))
    best = asked.join(facts.filter("kind = 'package' AND at IS NOT NULL").select("key", "dir", "at"), "key").groupBy("path", "spec").agg(F.array(F.min(near)["c"]).alias("roots"))
    return imports.join(best, ["path", "spec"], "left")


def script_bases(imports: DataFrame, facts: DataFrame) -> DataFrame:
    """imports with ``bases``, paths to try for a bare specifier: aliases from the importer's directory upward (the equal key,
    then the longest literal prefix, then their order), then packages of the repository by name: their entries, or the
    rest of the specifier below their directory and its src."""
    bare = imports.filter(~F.col("spec").rlike(r"^[./]")).select("path", "spec").distinct()
    alias = facts.filter("kind = 'alias' AND at IS NOT NULL").select(F.col("dir").alias("_d"), "ord", "key", F.col("at").alias("_value"), F.substring_index("key", "*", 1).alias("_a"), F.when(F.contains("key", F.lit("*")), F.substring_index("key", "*", -1)).alias("_b"))
    up = bare.select("path", "spec", F.explode(T.ancestors(T.dir_of("path"))).alias("_d"))
    equal = F.col("spec") == F.col("key")
    fits = F.col("_b").isNotNull() & F.col("spec").startswith(F.col("_a")) & F.col("spec").endswith(F.col("_b")) & (F.length("spec") >= F.length("_a") + F.length("_b"))
    middle = F.expr("substr(spec, length(_a) + 1, length(spec) - length(_a) - length(_b))")
    filled = F.when(F.col("_b").isNull(), F.col("_value")).otherwise(F.replace("_value", F.lit("*"), middle))
    by_alias = up.join(alias, "_d").filter(equal | fits).select("path", "spec", F.struct(F.lit(0).alias("a"), (-F.length("_d")).alias("b"), (~equal).alias("c"), (-F.length("_a")).alias("d"), F.col("ord").alias("e"), filled.alias("f")).alias("t"))
    name = F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    rest = F.expr("substr(spec, length(key) + 2)")
    package = facts.filter("kind = 'package' AND language = 'TypeScript'").select("key", "dir", "ord", "value")
    below = F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.when(F.col("spec") == F.col("key"), F.col("value")).otherwise(F.concat(F.when(F.col("ord") == 0, "").otherwise("src/"), rest)))
    by_name = bare.withColumn("key", name).join(package, "key").filter((F.col("spec") == F.col("key")) | (F.col("ord") < 2))
    by_name = by_name.select("path", "spec", F.struct(F.lit(1).alias("a"), F.length("dir").alias("b"), F.lit(False).alias("c"), F.lit(0).alias("d"), F.col("ord").alias("e"), below.alias("f")).alias("t"))
    tries = by_alias.unionByName(by_name).groupBy("path", "spec").agg(F.transform(F.array_sort(F.collect_set("t")), lambda x: x["f"]).alias("bases"))
    return imports.join(tries, ["path", "spec"], "left")


#: language -> the pattern of the line that names a file's package or namespace.
PACKAGES = {"Java": r"(?m)^\s*package\s+([\w.]+)", "Kotlin": r"(?m)^\s*package\s+([\w.]+)", "CSharp": r"(?m)^\s*namespace\s+([\w.]+)", "VisualBasic": r"(?im)^\s*namespace\s+([\w.]+)", "Php": r"(?m)^\s*namespace\s+([\w\\]+)"}


def declared(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files: path, language, text; symbols: path, name.  language, package, name, target of what sources of the languages
    in PACKAGES declare; a file without a package has the package ''."""
    package = F.lit(None).cast("string")
    for language, pattern in PACKAGES.items():
        package = F.when(F.col("language") == language, F.regexp_extract("text", pattern, 1)).otherwise(package)
    named = files.select("path", "language", package.alias("package")).filter("package IS NOT NULL")
    return named.join(symbols.select("path", "name").distinct(), "path").select("language", "package", "name", F.col("path").alias("target"))

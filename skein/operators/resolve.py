"""Import resolution: candidate paths in order of preference, then the first that exists.

``candidates`` turns an import into paths by pure string rules, one small function a language family; ``resolve`` runs
them over the distinct imports and settles them with an equi-join on paths without their endings and a minimum.  Facts about the repository that a
rule needs (module names, source roots, package files) are tables that are joined before or after.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from posixpath import dirname, normpath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import bounded_batches, checkpointed, spread
from .joins import nearest_of


def join_rel(base: str, rel: str) -> str | None:
    """base/rel without . and ..; None if it leaves the root."""
    path = normpath(f"{base}/{rel}" if base else rel)
    return None if path == ".." or path.startswith(("../", "/")) else "" if path == "." else path


def _above(directory: str) -> list[str]:
    """The directory and all above it, the root last."""
    parts = directory.split("/") if directory else []
    return ["/".join(parts[:n]) for n in range(len(parts), -1, -1)]


def _join(base: str | None, name: str) -> str | None:
    return None if base is None else f"{base}/{name}" if base else name


def python(path: str, spec: str, roots: list[str]) -> list[str]:
    dots = len(spec) - len(spec.lstrip("."))
    name = spec.lstrip(".").replace(".", "/")
    if dots:
        here = _above(dirname(path))
        bases = [here[dots - 1]] if dots <= len(here) else []
    else:
        bases = [*roots, *_above(dirname(path))]
    out = []
    for base in dict.fromkeys(bases):
        at = _join(base, name) if name else base
        out += [f"{at}/__init__.py".lstrip("/"), f"{at}/__init__.pyi".lstrip("/"), *([f"{at}.py", f"{at}.pyi"] if name else [])]
    return out


SCRIPT_ENDS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".json")


def typescript(path: str, spec: str, roots: list[str]) -> list[str]:
    if spec.startswith("."):
        bases = [join_rel(dirname(path), spec)]
    elif spec.startswith("/"):
        bases = [spec.lstrip("/")]
    else:
        bases = [_join(r, spec) for r in roots]
    out = []
    for at in filter(None, bases):
        swapped = [re.sub(r"\.(m|c)?js(x?)$", rf".{e}", at) for e in (r"\1ts\2", r"ts", r"tsx")] if re.search(r"\.(m|c)?jsx?$", at) else []
        out += [*swapped, at, *(at + e for e in SCRIPT_ENDS), *(f"{at}/index{e}" for e in SCRIPT_ENDS)]
    return out


def java(path: str, spec: str, roots: list[str]) -> list[str]:
    """Longest leading part first, so that nested and static names come back to their file."""
    parts = spec.removeprefix("static ").removesuffix(".*").split(".")
    ends = (".java", ".kt")
    return [_join(r, "/".join(parts[:n])) + e for n in range(len(parts), 1, -1) for r in roots for e in ends]


def rust(path: str, spec: str, roots: list[str]) -> list[str]:
    """``mod x``, ``mod x = file`` (a module whose file is named by an attribute) and paths; roots are the src of crates."""
    here, stem = dirname(path), re.sub(r".*/|\.rs$", "", path)
    if m := re.match(r"mod \w+ = (.+)$", spec):
        return [x for x in [join_rel(here, m[1])] if x]
    inner = here if stem in ("mod", "lib", "main") else _join(here, stem)
    if m := re.match(r"mod (\w+)$", spec):
        return [_join(inner, f"{m[1]}.rs"), _join(inner, f"{m[1]}/mod.rs")]
    parts = spec.replace(" ", "").split("::")
    if parts[0] == "crate":
        root = next((a for a in _above(here) if a.endswith("src") or a == "src"), "")
        base, parts = root, parts[1:]
    elif parts[0] in ("self", "super"):
        base = inner
        while parts and parts[0] in ("self", "super"):
            base = dirname(base) if parts[0] == "super" else base
            parts = parts[1:]
    else:
        named = dict(r.partition("=")[::2] for r in roots if "=" in r)
        base = named.get(parts[0]) if parts[0] in named else next((r for r in roots if r.split("/")[-2:-1] == [parts[0].replace("_", "-")] or r.split("/")[-2:-1] == [parts[0]]), None)
        parts = parts[1:]
    if base is None:
        return []
    tries = [_join(base, "/".join(parts[:n])) + e for n in range(len(parts), 0, -1) for e in (".rs", "/mod.rs")]
    return [*tries, _join(base, "lib.rs"), _join(base, "main.rs"), _join(base, "mod.rs")]


def dart(path: str, spec: str, roots: list[str]) -> list[str]:
    if spec.startswith("dart:"):
        return []
    if spec.startswith("package:"):
        package, _, rest = spec.removeprefix("package:").partition("/")
        named = [_join(r.partition("=")[2], rest) for r in roots if r.startswith(f"{package}=")]
        return named + [_join(r, f"lib/{rest}") for r in roots if r.split("/")[-1] == package] + [f"lib/{rest}"]
    at = join_rel(dirname(path), spec)
    return [at, f"{at}.dart"] if at else []


def c_family(path: str, spec: str, roots: list[str]) -> list[str]:
    """Quoted names look beside the importer first, and at the root last; names in angles only in include directories."""
    quoted, name = not spec.startswith("<"), spec.strip("<>\"")
    return [x for x in ([join_rel(dirname(path), name)] if quoted else []) + [join_rel(r, name) for r in roots] + ([name] if quoted else []) if x]


def ruby(path: str, spec: str, roots: list[str]) -> list[str]:
    if spec.startswith("relative:"):
        at = join_rel(dirname(path), spec.removeprefix("relative:"))
        return [at, f"{at}.rb"] if at else []
    inner = [a for a in _above(dirname(path)) if a.split("/")[-1] in ("lib", "spec", "test")]
    return [_join(b, f"{spec.removesuffix('.rb')}.rb") for b in [*inner, *roots, dirname(path), ""]]


def lua(path: str, spec: str, roots: list[str]) -> list[str]:
    name = spec if spec.endswith(".lua") else spec.replace(".", "/")
    return [x for r in [*roots, "", *_above(dirname(path))] for x in ([_join(r, name)] if name.endswith(".lua") else [_join(r, f"{name}.lua"), _join(r, f"{name}/init.lua")])]


def proto(path: str, spec: str, roots: list[str]) -> list[str]:
    return [x for x in [join_rel(dirname(path), spec), spec, *(_join(r, spec) for r in roots)] if x]


def shell(path: str, spec: str, roots: list[str]) -> list[str]:
    tail = re.sub(r"^.*(\$\w+|\$\{[^}]*\}|\$\([^)]*\)|`[^`]*`|\")/", "", spec)
    bases = [dirname(path), ""] if tail == spec else _above(dirname(path))
    return [x for x in (join_rel(b, tail) for b in bases) if x]


def php(path: str, spec: str, roots: list[str]) -> list[str]:
    """roots: prefix=directory pairs of a class loader, tried by the longest prefix."""
    if re.search(r"[/]|\.php$", spec):
        return [x for x in (join_rel(dirname(path), spec.lstrip("/")), spec.lstrip("/")) if x]
    name = spec.strip("\\")
    pairs = sorted((r.partition("=")[::2] for r in roots if "=" in r), key=lambda p: -len(p[0]))
    return [_join(d.rstrip("/"), name[len(p) :].replace("\\", "/").strip("/") + ".php") for p, d in pairs if name.startswith(p)]


def kotlin(path: str, spec: str, roots: list[str]) -> list[str]:
    parts = spec.removesuffix(".*").split(".")
    return [_join(r, "/".join(parts[:n])) + e for n in range(len(parts), 1, -1) for r in roots for e in (".kt", ".java")]


def swift(path: str, spec: str, roots: list[str]) -> list[str]:
    return [_join(r, f"{d}{spec}.swift") for r in [*roots, ""] for d in (f"Sources/{spec}/", f"{spec}/")]


RULES: dict[str, Callable[[str, str, list[str]], list[str]]] = {
    "Python": python,
    "TypeScript": typescript,
    "Tsx": typescript,
    "JavaScript": typescript,
    "Vue": typescript,
    "Java": java,
    "Kotlin": kotlin,
    "Rust": rust,
    "Dart": dart,
    "C": c_family,
    "Cpp": c_family,
    "ObjC": c_family,
    "ObjCpp": c_family,
    "Ruby": ruby,
    "Lua": lua,
    "Proto": proto,
    "Shell": shell,
    "Php": php,
    "Swift": swift,
}


#: Endings that rules try after one another on the same name; the first stands for none.  A path is cut before the longest that it
#: has, so a name and the number of an ending are one path, and no name has more paths than there are endings.
ENDS = ("", *sorted({*SCRIPT_ENDS, *(f"/index{e}" for e in SCRIPT_ENDS), ".mts", ".cts", ".py", ".pyi", "/__init__.py", "/__init__.pyi", ".rs", "/mod.rs", ".lua", "/init.lua", ".java", ".kt", ".rb", ".dart", ".php", ".swift"}, key=lambda e: (-len(e), e)))
_END = re.compile("(" + "|".join(map(re.escape, ENDS[1:])) + r")\Z")
_NUMBER = {e: n for n, e in enumerate(ENDS)}
#: A try is its place in the order of preference times this, plus the number of its ending.
_STEP = 64
_TRIES = "path string, language string, spec string, name string, tries array<int>"
_TRY_TYPES = pa.schema([*((c, pa.string()) for c in ("path", "language", "spec", "name")), ("tries", pa.list_(pa.int32()))])


@lru_cache(maxsize=1 << 14)
def _ending(tail: str) -> tuple[int, int]:
    """Characters and number of the ending of the last segment of a path, with the / before it."""
    m = _END.search(tail)
    return (len(m[1]), _NUMBER[m[1]]) if m else (0, 0)


def _by_name(paths: list[str | None]) -> dict[str, list[int]]:
    """The names of paths in order of preference, each with its tries."""
    out: dict[str, list[int]] = {}
    for n, c in enumerate(dict.fromkeys(filter(None, paths))):
        size, number = _ending(c[max(c.rfind("/"), 0) :])
        out.setdefault(c[: len(c) - size], []).append(n * _STEP + number)
    return out


def _cut(paths: DataFrame) -> DataFrame:
    """name of each path and number of its ending."""
    number = F.when(F.col("path").endswith(ENDS[1]), 1)
    for n, e in enumerate(ENDS[2:], 2):
        number = number.when(F.col("path").endswith(e), n)
    size = F.array(*(F.lit(len(e)) for e in ENDS))
    return paths.withColumn("end", number.otherwise(0)).select(F.substr("path", F.lit(1), F.length("path") - size[F.col("end")]).alias("name"), "end")


def candidates(imports: DataFrame, roots: dict[str, list[str]] | None = None) -> DataFrame:
    """imports: path, language, spec, and if they are known the importer's own ``roots`` and paths to try after them,
    ``bases`` (arrays, null: none).  Adds name and tries, one row for all paths that differ in their ending only; languages
    without a rule give none, and no import may mean its own file."""
    roots = roots or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, spec, own, bases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if language not in RULES:
                    continue
                paths = RULES[language](path, spec, roots.get(language, [""]) if own is None else own) if path and spec else []
                if bases is not None:
                    paths = paths + [t for b in bases for t in RULES[language](path, f"/{b}", [])]
                rows += [(path, language, spec, *named) for named in _by_name([t for t in paths if t != path]).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TRY_TYPES.types, strict=True)], schema=_TRY_TYPES)

    bounded_batches(imports.sparkSession)
    facts = [(F.col(c) if c in imports.columns else F.lit(None)).cast("array<string>").alias(c) for c in ("roots", "bases")]
    return spread(imports.select("path", "language", "spec", *facts), "path", "spec").distinct().mapInArrow(run, _TRIES)


def first_try(tried: DataFrame, files: DataFrame) -> DataFrame:
    """path, language, spec, target.  tried: as ``candidates`` gives it.  The existing file of the first try.  Files are reduced
    to one row a name with a bit for each ending, so a join gives no more rows than it is given."""
    have = _cut(files.select("path")).groupBy("name").agg(F.expr("bit_or(shiftleft(1L, end))").alias("_ends"))
    end = lambda t: t.bitwiseAND(_STEP - 1)
    there = F.filter("tries", lambda t: F.getbit("_ends", end(t)) == 1)
    met = tried.join(have, "name").select("path", "language", "spec", "name", F.array_min(there).alias("_try")).filter("_try IS NOT NULL")
    best = met.groupBy("path", "language", "spec").agg(F.min(F.struct("_try", "name")).alias("b"))
    return best.select("path", "language", "spec", F.concat("b.name", F.array(*map(F.lit, ENDS))[end(F.col("b._try"))]).alias("target"))


def resolve(imports: DataFrame, files: DataFrame, roots: dict[str, list[str]] | None = None) -> DataFrame:
    """path, language, spec, target of the imports that have one."""
    return first_try(candidates(imports, roots), files)


#: Imports, and targets, of a key that one row holds before they are paired; about as many, as they are dealt by digests.
BLOCK = 1024


def paired(imports: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """path, spec, target of every pair of an import and a target of its ``key``, but of a path with itself.  imports: path,
    spec, key; declared: key, target.

    Of n imports and m targets of a key n * m pairs are asked for.  Both stand in blocks, blocks are paired first, and their
    pairs are dealt over all cores before rows come of them, so that neither few keys nor few files make long tasks.
    Compiled code holds all rows that it makes of one row: of a pair of blocks it would hold a million.  The blocks of
    imports are opened by a function that is not compiled, so that only the rows of one import are held."""

    def blocks(rows: DataFrame, by: list[str], inner: Column, name: str) -> DataFrame:
        slots = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("_slots"))
        dealt = rows.join(slots, key).withColumn(f"{name}_slot", F.pmod(F.xxhash64(*by), F.col("_slots")))
        return dealt.groupBy(key, f"{name}_slot").agg(F.collect_list(inner).alias(name))

    asked = blocks(imports, ["path", "spec"], F.struct("path", "spec"), "_asked")
    given = blocks(declared.select(F.col(key), "target"), ["target"], F.col("target"), "_given")
    cores = imports.sparkSession.sparkContext.defaultParallelism
    met = asked.join(given, key).repartition(4 * cores, key, "_asked_slot", "_given_slot")
    opened = F.filter("_asked", lambda a: a["path"].isNotNull())
    one = met.select(F.explode(opened).alias("a"), "_given").select("a.path", "a.spec", "_given")
    return one.select("path", "spec", F.explode("_given").alias("target")).filter("path != target")


def resolve_packages(imports: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """Languages whose import names a directory: every file of it except tests.  modules: name, dir."""
    from .joins import longest_prefix

    met = longest_prefix(imports, modules)
    rest = F.expr("substr(spec, length(module) + 2)")
    folder = F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.when(rest != "", rest))
    inside = files.filter(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(F.col("path").alias("target"), T.dir_of("path").alias("folder"))
    return paired(met.withColumn("folder", folder), inside, "folder")


def resolve_namespaces(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports of a namespace: all files that declare it, never one for all.  declared: spec (namespace), target."""
    return paired(imports, declared.select("spec", "target").distinct(), "spec")


def _met(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """spec of the namespaces that ``resolve_namespaces`` gives a pair: there are two different paths, so no pair is made."""
    ends = lambda rows, by, n: rows.groupBy("spec").agg(F.min(by).alias(f"_a{n}"), F.max(by).alias(f"_b{n}"))
    return ends(imports, "path", 1).join(ends(declared, "target", 2), "spec").filter("_a1 != _b1 OR _a2 != _b2 OR _a1 != _a2").select("spec")


def resolve_types(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports of a type by full name: its file if only one declares it.  declared: spec (namespace.name), target."""
    single = declared.groupBy("spec").agg(F.min("target").alias("target"), F.count_distinct("target").alias("n")).filter("n = 1")
    return imports.join(single, "spec").filter("path != target").select("path", "spec", "target")


def resolve_declared(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports of a package (pkg.*) or of a name in it.  declared: package, name, target.

    A wildcard means every file of the package; a name every file that declares it, after the longest leading part of the
    specifier that is declared, so nested names come back to their file."""
    wild = imports.filter(F.col("spec").endswith(".*")).withColumn("package", F.expr("left(spec, length(spec) - 2)"))
    whole = wild.join(declared.select("package", "target").distinct(), "package").select("path", "spec", "target")
    parts = F.split("spec", r"\.")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    single = imports.filter(~F.col("spec").endswith(".*")).select("path", "spec").distinct()
    tries = single.select("spec").distinct().select("spec", F.explode(leading).alias("full"))
    names = declared.select(F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), F.col("name")).alias("full"), "target").distinct()
    best = tries.join(names.select("full").distinct(), "full", "left_semi").groupBy("spec").agg(F.max_by("full", F.length("full")).alias("full"))
    named = single.join(best, "spec").join(names, "full").select("path", "spec", "target")
    return whole.unionByName(named).filter("path != target").distinct()


#: Directories from which a name in angles may be reached.
INCLUDE_DIRS = ("include", "inc", "includes", "public", "src")


def resolve_suffix(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Includes that no directory has: of the files whose path ends in /spec the one that shares most leading directories
    with the importer, then the shortest, then the smallest.  A name in angles needs an include directory before it.

    Ends of paths are enumerated only for base names that are asked for, so the join is on the whole specifier."""
    asked = imports.select("path", "spec", F.regexp_replace("spec", r'^[<"]|[>"]$', "").alias("_n")).distinct()
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    bases = asked.select(T.base_of("_n").alias("_base")).distinct()
    have = files.select("path").withColumn("_base", T.base_of("path")).join(bases, "_base", "left_semi").select(F.col("path").alias("target"), F.explode(ends).alias("_n"))
    before = F.expr("substring_index(left(target, greatest(length(target) - length(_n) - 1, 0)), '/', -1)")
    have = have.select("target", F.explode(F.when(before.isin(*INCLUDE_DIRS), F.array(F.col("_n"), F.concat(F.lit("<"), "_n"))).otherwise(F.array("_n"))).alias("key"))
    key = F.when(F.col("spec").startswith("<"), F.concat(F.lit("<"), "_n")).otherwise(F.col("_n"))
    asked = asked.select("path", "spec", key.alias("key"))
    return asked.join(nearest_of(asked, have), ["path", "key"]).select("path", "spec", "target")


def resolve_targets(imports: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """Imports of a module whose folder a manifest names.  targets: dir (the manifest's), spec (module), folder.

    The module of the nearest manifest above the importer counts, else that of the smallest folder.  It is represented by
    the file of its name, else its smallest direct file, else the smallest below it."""
    asked = imports.select("path", "spec").distinct()
    up = asked.select("path", "spec", F.explode(T.ancestors(T.dir_of("path"))).alias("dir"))
    own = up.join(targets, ["dir", "spec"]).groupBy("path", "spec").agg(F.max_by("folder", F.length("dir")).alias("_own"))
    any_ = targets.groupBy("spec").agg(F.min("folder").alias("_any"))
    placed = asked.join(any_, "spec").join(own, ["path", "spec"], "left").select("path", "spec", F.coalesce("_own", "_any").alias("folder"))
    below = files.filter(F.col("path").endswith(".swift")).select(F.col("path").alias("target"), F.explode(T.ancestors(T.dir_of("path"))).alias("folder"))
    rank = F.struct((T.stem_of("target") != F.col("spec")).alias("a"), (T.dir_of("target") != F.col("folder")).alias("b"), F.col("target").alias("target"))
    best = targets.select("spec", "folder").distinct().join(below, "folder").groupBy("spec", "folder").agg(F.min(rank)["target"].alias("target"))
    return placed.join(best, ["spec", "folder"]).filter("path != target").select("path", "spec", "target")


_SCRIPT = ("TypeScript", "Tsx", "JavaScript", "Vue")
_C = ("C", "Cpp", "ObjC", "ObjCpp")
#: Languages whose imports can have a target.
KNOWN = (*RULES, "CSharp", "VisualBasic", "Go")


def _joined(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


def resolve_repository(files: DataFrame) -> DataFrame:
    """path, language, spec, target of every import of sources that has a target.  files: path, language, text.

    Sources are read once into imports and names, manifests once into facts; every language that imports something then has
    its own joins, and rules by path go before rules by declaration or by the end of a path.  Languages that import nothing
    have none: joins of empty tables are planned, run and held by the driver like others."""
    from . import extract, facts as K

    read = checkpointed(extract.parsed(files, calls=False, symbols=tuple(K.PACKAGES)).select("path", "language", "imports", F.transform("symbols", lambda s: s["name"]).alias("names")))
    imports = checkpointed(read.select("path", "language", F.explode("imports").alias("spec")).distinct())
    paths = checkpointed(files.select("path").distinct())
    here = {r["language"] for r in imports.select("language").filter(F.col("language").isin(*KNOWN)).distinct().collect()}
    if not here:
        return imports.select("path", "language", "spec", F.col("spec").alias("target")).limit(0)
    known = checkpointed(K.manifests(files)) if here & {*_SCRIPT, "Python", "Php", "Rust", "Dart", "Swift", "Go"} else None

    def of(*languages: str) -> DataFrame:
        return imports.filter(F.col("language").isin(*languages))

    def told(language: str) -> DataFrame:
        return known.filter(F.col("language") == language)

    asked, out = [], []
    if plain := here & {n for n in RULES if n not in (*_SCRIPT, "Python", "Rust", "Dart", "Php", "Swift", "Java", "Kotlin")}:
        asked.append(of(*sorted(plain)))
    if "Swift" in here:
        targets = told("Swift").select("dir", F.col("key").alias("spec"), F.col("at").alias("folder")).filter("folder IS NOT NULL")
        modules = checkpointed(resolve_targets(of("Swift"), paths, targets))
        asked.append(of("Swift").join(modules, ["path", "spec"], "left_anti"))
        out.append(modules.withColumn("language", F.lit("Swift")))
    if "Python" in here:
        asked.append(K.rooted(of("Python"), told("Python")))
    if "Php" in here:
        asked.append(K.rooted(of("Php"), told("Php"), "namespace"))
    if "Rust" in here:
        asked.append(K.keyed(of("Rust"), told("Rust"), F.regexp_extract("spec", r"^(\w+)", 1)))
    if "Dart" in here:
        asked.append(K.keyed(of("Dart"), told("Dart"), F.regexp_extract("spec", r"^package:([^/]+)/", 1)))
    if here & {*_SCRIPT}:
        asked.append(K.script_bases(of(*_SCRIPT), told("TypeScript")))
    if asked:
        whole = _joined(asked)
        if here & {"Rust", "Dart", "Php"}:
            empty = F.array().cast("array<string>")
            whole = whole.withColumn("roots", F.when(F.col("language").isin("Rust", "Dart", "Php"), F.coalesce("roots", empty)).otherwise(F.col("roots")))
        by_path = checkpointed(resolve(whole, paths))
        out.append(by_path)

    rest = []
    if here & {*_C}:
        rest.append(resolve_suffix(of(*_C).join(by_path, ["path", "spec"], "left_anti"), paths))
    jvm, net = ("Java", "Kotlin"), ("CSharp", "VisualBasic")
    if here & {*jvm, *net}:
        symbols = read.select("path", F.explode("names").alias("name"))
        declared = checkpointed(K.declared(files.filter(F.col("language").isin(*jvm, *net)), symbols))
    if here & {*jvm}:
        rest.append(resolve_declared(of(*jvm), declared.filter(F.col("language").isin(*jvm))))
    if here & {*net}:
        there = declared.filter(F.col("language").isin(*net))
        spaces = there.filter("package != ''").select(F.col("package").alias("spec"), "target")
        full = there.select(F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "name").alias("spec"), "target")
        rest.append(resolve_namespaces(of(*net), spaces))
        rest.append(resolve_types(of(*net), full.join(_met(of(*net), spaces), "spec", "left_anti")))
    if "Go" in here:
        rest.append(resolve_packages(of("Go").select("path", "spec"), paths, told("Go").select(F.col("key").alias("name"), "dir")))
    if rest:
        out.append(_joined(rest).join(imports.select("path", "language").distinct(), "path"))
    return _joined([o.select("path", "language", "spec", "target") for o in out]).distinct()

"""The engine's joins: capped fan-out, division, longest prefix, first match by priority, path suffix and nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_TARGETS = 50


def capped_join(calls: DataFrame, targets: DataFrame, on: str, cap: int = MAX_TARGETS) -> DataFrame:
    """Equi-join that leaves out keys with more than ``cap`` targets: an ambiguous name says nothing."""
    few = targets.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") <= cap).select(on)
    return calls.join(targets.join(few, on, "left_semi"), on)


def fold_edges(edges: DataFrame, keys: tuple[str, ...] = ("src", "dst"), weight: Column | None = None) -> DataFrame:
    """One row a (src, dst, ...) with the weights' sum, without loops."""
    return edges.filter("src != dst").groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1)).cast("bigint").alias("weight"))


def division(have: DataFrame, need: DataFrame, item: str, group: str, owner: str) -> DataFrame:
    """(group, owner) where the owner has every item that the group needs.  have: owner, item; need: group, item.

    Owners with the same needed items are one set, and sets are divided: an item that very many owners have is joined
    once for each distinct set that holds it, not once an owner."""
    wanted = need.select(group, item).distinct()
    sizes = wanted.groupBy(group).agg(F.count("*").alias("_need"))
    held = have.select(owner, item).join(wanted.select(item).distinct(), item, "left_semi")
    owners = held.groupBy(owner).agg(F.array_sort(F.collect_set(item)).alias("_set"))
    got = owners.select("_set").distinct().withColumn(item, F.explode("_set")).join(wanted, item).groupBy(group, "_set").agg(F.count("*").alias("_have"))
    fits = got.join(sizes, group).filter("_have = _need").select(group, "_set")
    return owners.join(fits, "_set").select(group, owner)


def longest_prefix(specs: DataFrame, modules: DataFrame, spec: str = "spec", name: str = "name") -> DataFrame:
    """Each spec with the module of the longest name that is the spec or a leading part of it; ties by shorter, then
    smaller dir.  Leading parts are enumerated, so the join is on equality."""
    parts = specs.select(spec).distinct().withColumn("_p", F.explode(T.ancestors(spec)))
    met = parts.join(modules.withColumnRenamed(name, "_p"), "_p")
    best = met.groupBy(spec).agg(F.min(F.struct(-F.length("_p"), F.length("dir"), F.col("dir").alias("dir"), F.col("_p").alias("module"))).alias("b"))
    return specs.join(best.select(spec, F.col("b.module").alias("module"), F.col("b.dir").alias("dir")), spec)


def first_match(candidates: DataFrame, files: DataFrame, key: list[str], path: str = "path") -> DataFrame:
    """candidates: key columns, priority, candidate.  The existing file of the smallest priority for each key; a file
    never resolves to itself if the key has its path."""
    met = candidates.join(files.select(F.col(path).alias("candidate")).distinct(), "candidate")
    if path in key:
        met = met.filter(F.col("candidate") != F.col(path))
    return met.groupBy(*key).agg(F.min(F.struct("priority", "candidate")).alias("b")).select(*key, F.col("b.candidate").alias("target"))


def by_suffix(wanted: DataFrame, files: DataFrame, given: str = "given") -> DataFrame:
    """A file for each path as users give it: the path itself, else the shortest that ends in /path, then the smallest."""
    want = wanted.withColumn("_base", T.base_of(given))
    have = files.select("path").withColumn("_base", T.base_of("path"))
    met = want.join(have, "_base").filter((F.col("path") == F.col(given)) | F.col("path").endswith(F.concat(F.lit("/"), F.col(given))))
    rank = F.struct((F.col("path") != F.col(given)).alias("a"), F.length("path").alias("b"), F.col("path").alias("path"))
    return met.groupBy(given).agg(F.min(rank).alias("b")).select(given, F.col("b.path").alias("path"))


def nearest_of(asked: DataFrame, have: DataFrame) -> DataFrame:
    """path, key, target.  asked: path, key; have: key, target.  Of the targets of the key, but the path itself, the one that
    shares most leading directories, then the shortest, then the smallest.

    Targets are reduced to one for each directory above them and each key, so a name that many files have is never paired
    with all that ask for it."""
    asked = asked.select("path", "key").distinct()
    have = have.join(asked.select("key").distinct(), "key", "left_semi")
    under = have.select("key", "target", F.explode(T.ancestors(T.dir_of("target"))).alias("_up"))
    order = F.min(F.struct(F.length("target").alias("n"), F.col("target").alias("target")))["target"]
    first = under.groupBy("_up", "key").agg(order.alias("_first"))
    own = first.join(asked.select(F.col("path").alias("_first"), "key"), ["_first", "key"], "left_semi")
    second = under.join(own, ["_up", "key"]).filter("target != _first").groupBy("_up", "key").agg(order.alias("_second"))
    tries = asked.select("path", "key", F.explode(T.ancestors(T.dir_of("path"))).alias("_up"))
    met = tries.join(first.join(second, ["_up", "key"], "left"), ["_up", "key"])
    met = met.withColumn("target", F.when(F.col("_first") != F.col("path"), F.col("_first")).otherwise(F.col("_second"))).filter("target IS NOT NULL")
    return met.groupBy("path", "key").agg(F.max_by("target", F.length("_up")).alias("target"))


def nearest(wanted: DataFrame, files: DataFrame, importer: str = "importer", base: str = "base") -> DataFrame:
    """Of the files of a base name the one that shares most leading directories with the importer, then the shortest."""
    have = files.select(F.col("path").alias("target"), T.base_of("path").alias("key"))
    met = nearest_of(wanted.select(F.col(importer).alias("path"), F.col(base).alias("key")), have)
    return met.select(F.col("path").alias(importer), F.col("key").alias(base), "target")


def pattern_match(specs: DataFrame, patterns: DataFrame) -> DataFrame:
    """specs: spec; patterns: ord, pattern (one * at most), target.  Equal beats the longest literal prefix beats order.
    Patterns come from manifests: a few for each project."""
    star = F.instr("pattern", "*")
    before, after = F.when(star > 0, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern")), F.when(star > 0, F.substring_index("pattern", "*", -1))
    p = patterns.withColumn("_before", before).withColumn("_after", after)
    equal = F.col("spec") == F.col("pattern")
    fits = F.col("_after").isNotNull() & F.col("spec").startswith(F.col("_before")) & F.col("spec").endswith(F.col("_after")) & (F.length("spec") >= F.length("_before") + F.length("_after"))
    met = specs.join(F.broadcast(p), equal | fits)
    middle = F.expr("substr(spec, length(_before) + 1, length(spec) - length(_before) - length(_after))")
    filled = F.when(equal & F.col("_after").isNull(), F.col("target")).otherwise(F.regexp_replace("target", F.lit(r"\*"), F.regexp_replace(middle, r"([\\$])", r"\\$1")))
    rank = F.struct((~equal).alias("a"), -F.length("_before"), F.col("ord").alias("ord"), F.col("pattern").alias("pattern"), filled.alias("target"))
    return met.groupBy("spec").agg(F.min(rank).alias("b")).select("spec", F.col("b.pattern").alias("pattern"), F.col("b.target").alias("target"))


def unresolved(imports: DataFrame, resolved: DataFrame, key: list[str]) -> DataFrame:
    """Imports without a target that must lie inside the repository: relative ones."""
    return imports.join(resolved.select(*key), key, "left_anti").filter(F.col("spec").rlike(r"^(\.|crate::|self::)"))


def header_pairs(files: DataFrame) -> DataFrame:
    """Headers with their sources: same directory and stem, else include/ mirrored in src, source or lib."""
    header, source = r"\.(h|hh|hpp|hxx)$", r"\.(c|cc|cpp|cxx|m|mm)$"
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    heads = files.filter(F.col("path").rlike(header)).select(F.col("path").alias("header"), bare.alias("bare"))
    mirrored = [F.regexp_replace("bare", r"(^|/)include/", f"$1{d}/") for d in ("src", "source", "lib")]
    tries = heads.select("header", F.posexplode(F.array(F.col("bare"), *mirrored)).alias("priority", "candidate")).filter((F.col("priority") == 0) | F.col("header").rlike(r"(^|/)include/"))
    found = files.filter(F.col("path").rlike(source)).select(F.col("path").alias("source"), bare.alias("candidate"))
    met = tries.join(found, "candidate")
    best = met.groupBy("header").agg(F.min("priority").alias("priority"))
    return met.join(best, ["header", "priority"]).select("header", "source")


def prefix_seek(files: DataFrame, prefix: str) -> DataFrame:
    """Files whose path starts with the prefix; the range is pushed to the scan."""
    return files.filter(F.col("path").startswith(prefix))


def dir_listing(files: DataFrame, directories: DataFrame) -> DataFrame:
    """dir, path: the files that lie directly in each directory; '' is the root."""
    return files.select(T.dir_of("path").alias("dir"), "path").join(directories.select("dir").distinct(), "dir")


def files_named(files: DataFrame, names: DataFrame) -> DataFrame:
    """base, path: the files of each base name."""
    return files.select(T.base_of("path").alias("base"), "path").join(names.select("base").distinct(), "base")


def override_lookup(imports: DataFrame, overrides: DataFrame) -> DataFrame:
    """imports: path, declared_in, name.  overrides: ord, declared_in, name, target.  Each import with its manifest's first
    override of that name."""
    first = overrides.groupBy("declared_in", "name").agg(F.min_by("target", "ord").alias("target"))
    return imports.join(first, ["declared_in", "name"]).select("path", "declared_in", "name", "target")


def redetected(reads: DataFrame, changed: DataFrame) -> DataFrame:
    """resolver: those that have read a changed path (path) or listed the directory it lies in (path, ending in /)."""
    touched = changed.select("path").union(changed.select(F.concat(T.dir_of("path"), F.lit("/"))))
    return reads.join(touched.distinct(), "path", "left_semi").select("resolver").distinct()

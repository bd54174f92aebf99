"""Which types implement which interfaces where no source says so: a type does if its methods cover the interface's.

Method sets come from one line of source each, with the numbers of parameters and results where the line shows them.
Candidates live in the interface's package or in one that imports it and have the interface's rarest method; only these
are compared whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from posixpath import dirname

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, checkpointed
from . import extract as X

MAX_IMPLEMENTORS = 50
EMBEDDING_DEPTH = 4
MEMBERS = "dir string, what string, name string, interface boolean, member string, params int, results int"


def members_of(path: str, text: str) -> list[tuple[str, str, str, bool, str | None, int | None, int | None]]:
    """Rows of MEMBERS of a Go file: a ``type`` each, a ``method`` each with its type, and an ``embed`` each, whose member is
    null if it is a type of another package."""
    directory, code, out = dirname(path), X.blanked(text, "Go").split("\n"), []
    for name, kind, _, start, end, _ in X.symbols_of("Go", text):
        if kind in ("Interface", "Struct", "Type"):
            out.append((directory, "type", name, kind == "Interface", None, None, None))
        if kind in ("Interface", "Struct"):
            for line in code[start : end - 1]:
                if kind == "Interface" and (m := re.match(r"\s*(\w+)\s*\(", line)):
                    out.append((directory, "method", name, True, *X.method_key(m[1], line.strip())))
                elif m := re.match(r"\s*\*?(\w+(?:\.\w+)?)(?:\[[^\]]*\])?\s*(?:`[^`]*`)?\s*$", line):
                    out.append((directory, "embed", name, kind == "Interface", None if "." in m[1] else m[1], None, None))
        if kind == "Method" and (m := re.match(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)", code[start - 1])):
            out.append((directory, "method", m[1], False, *X.method_key(name, code[start - 1][m.end() :].strip())))
    return out


def members(files: DataFrame) -> DataFrame:
    """files: path, language, text.  What the Go files among them declare; see MEMBERS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, text in zip(batch["path"], batch["text"], strict=True) for r in members_of(path, text or "")]
            out = pd.DataFrame(rows, columns=["dir", "what", "name", "interface", "member", "params", "results"])
            yield out.astype({"params": "Int32", "results": "Int32"})

    bounded_batches(files.sparkSession)
    return files.filter("language = 'Go' AND path IS NOT NULL").select("path", "text").mapInPandas(run, MEMBERS)


def method_sets(found: DataFrame, depth: int = EMBEDDING_DEPTH) -> tuple[DataFrame, DataFrame]:
    """dir, name, member, params, results of every type with what it embeds in its own package, and dir, name of those whose
    set is not known whole: they embed a type of another package, one that is declared nowhere, or deeper than ``depth``."""
    types = checkpointed(found.filter("what = 'type'").select("dir", "name").distinct())
    embeds = checkpointed(found.filter("what = 'embed'").select("dir", F.col("name").alias("at"), F.col("member").alias("next")).distinct())
    step = types.select("dir", "name", F.col("name").alias("at"))
    reached = step
    for _ in range(depth):  # each step is made once, not again by all that follow
        step = checkpointed(step.join(embeds.filter("next IS NOT NULL"), ["dir", "at"]).select("dir", "name", F.col("next").alias("at")).distinct())
        if step.isEmpty():
            break
        reached = reached.union(step)
    reached = checkpointed(reached.distinct())
    beyond = step.join(embeds.filter("next IS NOT NULL"), ["dir", "at"]).select("dir", "name", F.col("next").alias("at")).join(reached, ["dir", "name", "at"], "left_anti")
    unknown = reached.join(types.select("dir", F.col("name").alias("at")), ["dir", "at"], "left_anti")
    foreign = reached.join(embeds.filter("next IS NULL"), ["dir", "at"], "left_semi")
    methods = found.filter("what = 'method'").select("dir", F.col("name").alias("at"), "member", "params", "results")
    sets = reached.join(methods, ["dir", "at"]).select("dir", "name", "member", "params", "results").distinct()
    return sets, beyond.unionByName(unknown).unionByName(foreign).select("dir", "name").distinct()


def implementing(found: DataFrame, near: DataFrame, cap: int = MAX_IMPLEMENTORS) -> DataFrame:
    """dir, interface, type_dir, type.  found: as of ``members``; near: dir, user (a package that imports it).

    An interface with more than ``cap`` types says nothing about any of them and has none; nor has one that is not known
    whole.  A number that no line shows agrees with every number."""
    found = checkpointed(found)
    sets, partial = method_sets(found)
    sets = checkpointed(sets)
    kinds = found.filter("what = 'type'").groupBy("dir", "name").agg(F.bool_or("interface").alias("interface"))
    need = sets.join(kinds.filter("interface"), ["dir", "name"], "left_semi").join(partial, ["dir", "name"], "left_anti").withColumnRenamed("name", "iface")
    need = checkpointed(need)
    have = sets.join(kinds.filter("NOT interface"), ["dir", "name"], "left_semi").select(F.col("dir").alias("type_dir"), F.col("name").alias("type"), "member", F.col("params").alias("_p"), F.col("results").alias("_r"))
    have = checkpointed(have)
    holders = have.select("type_dir", "type", "member").distinct()
    common = holders.groupBy("member").agg(F.count("*").alias("_n"))
    rarest = need.select("dir", "iface", "member").distinct().join(common, "member", "left").groupBy("dir", "iface").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "member"))["member"].alias("member"))
    where = near.select("dir", F.col("user").alias("type_dir")).union(rarest.select("dir", F.col("dir").alias("type_dir"))).distinct()
    pairs = rarest.join(where, "dir").join(holders, ["type_dir", "member"]).select("dir", "iface", "type_dir", "type")
    agree = (F.col("params").isNull() | F.col("_p").isNull() | (F.col("params") == F.col("_p"))) & (F.col("results").isNull() | F.col("_r").isNull() | (F.col("results") == F.col("_r")))
    key = F.struct("member", F.coalesce("params", F.lit(-1)), F.coalesce("results", F.lit(-1)))
    met = pairs.join(need, ["dir", "iface"]).join(have, ["type_dir", "type", "member"]).filter(agree).groupBy("dir", "iface", "type_dir", "type").agg(F.count_distinct(key).alias("_met"))
    whole = need.groupBy("dir", "iface").agg(F.count("*").alias("_need"))
    covered = checkpointed(met.join(whole, ["dir", "iface"]).filter("_met = _need").select("dir", "iface", "type_dir", "type"))
    few = covered.groupBy("dir", "iface").agg(F.count("*").alias("_n")).filter(F.col("_n") <= cap)
    return covered.join(few, ["dir", "iface"], "left_semi").select("dir", F.col("iface").alias("interface"), "type_dir", "type")

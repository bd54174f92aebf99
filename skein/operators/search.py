"""Line search and what is made of its hits: counts, groups, rank, context, paging.

A hit is (path, line_no, line).  Predicates on paths stand before lines are made; a literal query also filters whole
texts first, so that texts without a match are never split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpointed
from ..sources.tables import lines


@dataclass(frozen=True)
class Search:
    """A search: what to match, and in which paths."""

    query: str
    regex: bool = False
    case_sensitive: bool | None = None
    path_filter: str | None = None
    glob: str | None = None
    exclude: tuple[str, ...] = field(default=())

    def paths(self, path: Column) -> Column:
        ok = F.lit(True)
        if self.path_filter:
            ok &= path.contains(self.path_filter)
        if self.glob:
            ok &= path.rlike(T.glob_regex(self.glob))
        for glob in self.exclude:
            ok &= ~path.rlike(T.glob_regex(glob, exclude=True))
        return ok

    def matches(self, line: Column) -> Column:
        return T.line_matcher(self.query, self.regex, self.case_sensitive)(line)

    def hits(self, files: DataFrame, outside: bool = False) -> DataFrame:
        """``outside``: in all paths that the path predicates leave out."""
        ok = self.paths(F.col("path"))
        rows = files.filter(~ok if outside else ok)
        if not self.regex:
            rows = rows.filter(self.matches(F.col("text")))
        return lines(rows).filter(self.matches(F.col("line")))


def case_variants(files: DataFrame, query: str) -> DataFrame:
    """Hits that match only when case does not count."""
    low = query.lower()
    rows = lines(files.filter(F.lower("text").contains(low)))
    return rows.filter(F.lower("line").contains(low) & ~F.col("line").contains(query))


KEYS = {"top": T.top_of, "dir": lambda p: F.when(T.dir_of(p) == "", ".").otherwise(T.dir_of(p)), "file": F.col, "wide": T.two_segments}


def counts_by(hits: DataFrame, key: str) -> DataFrame:
    """key, hits, files; the order is hits descending, then key."""
    return hits.groupBy(KEYS[key]("path").alias("key")).agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"))


def totals(hits: DataFrame) -> DataFrame:
    p = F.col("path")
    return hits.agg(F.count("*").alias("hits"), F.count_distinct(p).alias("files"), F.count_distinct(KEYS["dir"](p)).alias("dirs"), F.count_distinct(KEYS["top"](p)).alias("tops"))


def page(df: DataFrame, order: list[Column], offset: int = 0, size: int = 80) -> DataFrame:
    """One page of a total order, with shown, omitted and next_offset (null on the last page)."""
    total = df.agg(F.count("*").alias("_total"))
    rows = df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))
    end = F.least(F.lit(offset + size), F.col("_total"))
    return rows.withColumn("omitted", F.col("_total") - end).withColumn("next_offset", F.when(F.col("_total") > offset + size, F.lit(offset + size).cast("bigint"))).drop("_total")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; ``rank`` counts from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def total_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """``rank`` from 1 over the whole table, by a total order, without one task that sorts it all: rows are dealt by
    ranges and numbered within each; what the driver sees is one count a range."""
    rows = checkpointed(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in rows.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["n"]
    at = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    ranked = rows.join(F.broadcast(at), "_range").withColumn("rank", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before"))
    return ranked.drop("_range", "_before")


def top_groups(hits: DataFrame, groups: int, rows: int) -> DataFrame:
    """The files with most hits, and the first hits of each, with the number left out."""
    n = hits.groupBy("path").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "path").limit(groups)
    shown = top_per_group(hits.join(F.broadcast(n), "path"), ["path"], [F.col("line_no")], rows)
    return shown.withColumn("left_out", F.greatest(F.col("hits") - rows, F.lit(0)))


def role_of(path: Column) -> Column:
    return F.when(T.is_doc_path(path), "doc").when(T.is_test_path(path), "test").otherwise("prod")


def grouped_by_role(hits: DataFrame, role: Column, rows: int = 6) -> DataFrame:
    """role, path, hits, first_lines: the first line numbers of each file, joined."""
    marked = hits.withColumn("role", role)
    counts = marked.groupBy("role", "path").agg(F.count("*").alias("hits"))
    first = top_per_group(marked, ["role", "path"], [F.col("line_no")], rows).groupBy("role", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line_no")), lambda x: x.cast("string")), ",").alias("first_lines"))
    return counts.join(first, ["role", "path"])


def broad_rank(hits: DataFrame, size: int = 12) -> DataFrame:
    """Definition lines first, then others, tests and documents last; within a class by path and line."""
    low = T.is_test_path(F.col("path")) | T.is_doc_path(F.col("path"))
    cls = F.when(low, 2).when(T.is_definition_line("line"), 0).otherwise(1)
    return hits.withColumn("class", cls).orderBy("class", "path", "line_no").limit(size)


#: Hits from which references are counted by file, and files shown outside and inside tests.
WIDE_REFERENCES, PROD_FILES, TEST_FILES = 150, 25, 15


def reference_groups(references: DataFrame, test: Column, most: int = WIDE_REFERENCES) -> DataFrame:
    """test, path, hits, rank: counts by file with most hits first, the first 25 files outside tests and 15 in them, if
    there are more than ``most`` references; no row otherwise, as then each is listed."""
    total = references.agg((F.count("*") > most).alias("_wide"))
    n = references.withColumn("test", test).groupBy("test", "path").agg(F.count("*").alias("hits"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy("test").orderBy(F.desc("hits"), "path")))
    return ranked.filter(F.col("rank") <= F.when(F.col("test"), TEST_FILES).otherwise(PROD_FILES)).crossJoin(F.broadcast(total)).filter("_wide").drop("_wide")


def digest(hits: DataFrame) -> DataFrame:
    """One row: lines, files, the three files with most hits and the first three hits."""
    files = hits.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(3)
    busiest = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "path"))), lambda s: s["path"]), ",").alias("busiest"))
    first = hits.orderBy("path", "line_no").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line_no"))), lambda s: F.concat(s["path"], F.lit(":"), s["line_no"].cast("string"))), ",").alias("first"))
    return hits.agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files")).crossJoin(F.broadcast(busiest)).crossJoin(F.broadcast(first))


def suggest_filter(hits: DataFrame) -> DataFrame:
    """One row: the file with at least half of the hits, else the directory, else the file that has most."""
    per_file = hits.groupBy("path").agg(F.count("*").alias("n"))
    file = per_file.agg(F.min(F.struct(-F.col("n"), "path")).alias("f"), F.sum("n").alias("total"), F.count("*").alias("files"))
    folder = per_file.groupBy(T.dir_of("path").alias("dir")).agg(F.sum("n").alias("n")).agg(F.min(F.struct(-F.col("n"), "dir")).alias("d"))
    both = file.crossJoin(F.broadcast(folder))
    by_file = (-F.col("f.col1") * 2 >= F.col("total")) | (F.col("files") == 1) | (F.col("d.dir") == "") | (-F.col("d.col1") * 2 < F.col("total"))
    return both.filter("total > 0").select(F.when(by_file, F.col("f.path")).otherwise(F.concat(F.col("d.dir"), F.lit("/"))).alias("path_filter"), F.col("total").alias("hits"))


def budget_prefix(df: DataFrame, order: list[str], chars: Column, limit: int) -> DataFrame:
    """The longest prefix, by the order, whose characters come to at most ``limit`` tokens; rows are never skipped.

    The order must be total and each row has a character at least, so a prefix has at most ``4 * limit`` rows: only these
    are brought together.
    """
    first = df.withColumn("_chars", chars.cast("bigint")).orderBy(*order).limit(4 * limit)
    running = F.sum("_chars").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("tokens", T.token_estimate(running)).filter(F.col("tokens") <= limit).drop("_chars")


def adaptive_context(total: int, requested: int | None = None, most: int = 10) -> int:
    """Lines shown on each side of a hit: three for up to five hits, one for up to twenty, none beyond."""
    if requested is not None:
        return min(requested, most)
    return 3 if total <= 5 else 1 if total <= 20 else 0


def context_windows(hits: DataFrame, around: int, files: DataFrame | None = None) -> DataFrame:
    """Ranges of ``around`` lines on each side, merged where they touch: path, first_line, last_line, hits.  ``files``
    (path, text): no range runs past its file's end."""
    w = Window.partitionBy("path").orderBy("line_no")
    fresh = F.col("line_no") - F.lag("line_no").over(w) > 2 * around + 1
    island = F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(w)
    ranges = hits.withColumn("island", island).groupBy("path", "island").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.count("*").alias("hits"))
    out = ranges.select("path", F.greatest(F.col("a") - around, F.lit(1)).alias("first_line"), (F.col("b") + around).alias("last_line"), "hits")
    if files is None:
        return out
    return out.join(files.select("path", T.loc("text").alias("_loc")), "path").withColumn("last_line", F.least("last_line", "_loc")).drop("_loc")


def body(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Numbered lines start..end of one file."""
    return lines(files.filter(F.col("path") == path)).filter(F.col("line_no").between(start, end))


def text_only(admitted: DataFrame, indexed: DataFrame) -> DataFrame:
    """Admitted files that the index lacks, without lock and ignore files."""
    named = ~T.base_of("path").rlike(r"(?i)(\.lock|-lock\.(json|yaml)|\.sum)$|^\.[a-z]*ignore$")
    return admitted.join(indexed.select("path"), "path", "left_anti").filter(named)


def language_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum(T.loc("text")).cast("bigint").alias("loc"))


def top_and_rest(df: DataFrame, key: str, k: int = 8) -> DataFrame:
    """Counts of the k most frequent keys (ties by key) and of all others as one row, '(other)'."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), key).limit(k).select(F.col(key).alias("_k"))
    marked = n.join(F.broadcast(top), F.col(key).eqNullSafe(F.col("_k")), "left")
    return marked.groupBy(F.when(F.col("_k").isNull(), "(other)").otherwise(F.col("_k").cast("string")).alias("key")).agg(F.sum("n").alias("n"))

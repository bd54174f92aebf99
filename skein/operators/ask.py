"""The engine's questions as functions over its tables: code search, symbol lookup, references and task context.

Each takes DataFrames (files: file_id, path, language, text; symbols: symbol_id, file_id, name, kind, start_line; edges:
src, dst, kind) and gives an ``Answer``: the shape that the number of hits asks for, the number, and the rows.  The number
is counted first, as the plan depends on it; rows stay lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import lines
from . import extract, graph, search
from . import symbols as names

# Fixed values.
BODY_HITS, GROUP_FILES, BROAD_HITS = 5, 3, 60
PACKAGE_FILES, SMALL_REPO, UNMATCHED_FILES, COMPACT_FILES, MOST_FILES = 12, 60, 5, 10, 80
#: Where a kind of question is sent; the kind alone decides.
ROUTES = {
    "FileDependencies": "Graph",
    "FileImpact": "Graph",
    "RepoSkeleton": "Graph",
    "TaskRank": "Graph",
    "FuzzySymbol": "Graph",
    "PreciseReferences": "LanguageServer",
    "GotoDefinition": "LanguageServer",
    "Diagnostics": "LanguageServer",
    "PrepareRename": "LanguageServer",
}


@dataclass
class Answer:
    shape: str
    total: int
    rows: DataFrame


def shape_of(total: int, files: int, group: bool | None = None, paged: bool = False, context: int | None = None) -> str:
    """How hits are shown: none, grouped by role, broad, in bodies, or as lines."""
    if not total:
        return "none"
    plain = not paged and context is None
    if (group and not paged) or (group is None and plain and BODY_HITS < total <= BROAD_HITS and files > GROUP_FILES):
        return "grouped"
    if plain and total > BROAD_HITS:
        return "broad"
    return "bodies" if plain and total <= BODY_HITS else "lines"


def search_code(files: DataFrame, wanted: search.Search, aggregate: str | None = None, count_only: bool = False, group: bool | None = None, offset: int = 0, size: int = 80, context: int | None = None) -> Answer:
    """Hits of a search: counts if asked for, else the shape of ``shape_of``.  Without a hit the rows are those outside the
    path predicates, so that a filter that is too narrow shows."""
    hits = wanted.hits(files)
    n = hits.agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")).first()
    if count_only:
        return Answer("count", n["n"], search.totals(hits))
    if aggregate:
        return Answer("counts", n["n"], search.page(search.counts_by(hits, aggregate), [F.desc("hits"), F.col("key")], offset, size))
    shape = shape_of(n["n"], n["files"], group, offset > 0, context)
    rows = {
        "none": lambda: search.counts_by(wanted.hits(files, outside=True), "file"),
        "grouped": lambda: search.grouped_by_role(hits, search.role_of(F.col("path"))),
        "broad": lambda: search.broad_rank(hits),
        "bodies": lambda: search.context_windows(hits, search.adaptive_context(n["n"], context), files),
        "lines": lambda: search.page(hits, [F.col("path"), F.col("line_no")], offset, size),
    }[shape]()
    return Answer(shape, n["n"], rows)


def find_symbol(symbols: DataFrame, query: str, order: list, substring: bool | None = None, kind: str | None = None, size: int = 80) -> Answer:
    """Symbols by name, best first.  An exact hit folds the others into a number, unless substrings are asked for; with no
    hit at all names are looked for by words, then by nearness."""
    rows = symbols if kind is None else symbols.filter(F.lower("kind") == kind.lower())
    hits = names.find_symbols(rows, query, order)
    n = hits.agg(F.count("*").alias("n"), F.count_if(F.col("tier") == 0).alias("exact")).first()
    if n["n"]:
        folds = n["exact"] and not substring
        return Answer("exact" if folds else "matches", n["exact"] if folds else n["n"], (names.fold_to_exact(hits) if folds else hits).orderBy("tier", "case_differs", *order).limit(size))
    words = sorted(set(names._tokens(query)) - set(T.STOP_WORDS))
    by_words = names.word_search(rows, words) if words and "container" in rows.columns else None
    if by_words is not None and not by_words.isEmpty():
        return Answer("words", by_words.count(), by_words)
    near = names.suggestions(rows, query)
    return Answer("suggestions", near.count(), near)


def offsets_of(rows: DataFrame, name: str, line: str = "line") -> DataFrame:
    """One row for each whole-word occurrence of the name: ``character``, how many characters stand before it."""
    pieces = F.split(F.col(line), T.word_regex(name), -1)
    before = lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda n, p: n + F.length(p)) + (k - 1) * len(name)
    places = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), before)
    return rows.filter(F.size(pieces) > 1).withColumn("character", F.explode(places))


def find_refs(files: DataFrame, edges: DataFrame, name: str, declared_in: int, declared_line: int | None = None, reexported: DataFrame | None = None) -> DataFrame:
    """path, line_no, column (UTF-16, from 1), line, role, test, declaration of each reference to a name that a file
    declares: whole words, outside comments and strings, in that file, the files that import it and those that it is
    re-exported to (file_id, name it has there).  Sorted tests last, then by path and place."""
    here = files.sparkSession.createDataFrame([(declared_in, name)], "file_id long, name string")
    importers = edges.filter((F.col("kind") == "Import") & (F.col("dst") == declared_in)).select(F.col("src").cast("bigint").alias("file_id"), F.lit(name).alias("name"))
    scope = here.union(importers)
    if reexported is not None:
        scope = scope.union(reexported.select(F.col("file_id").cast("bigint"), "name"))
    scope = scope.distinct()
    carried = [r["name"] for r in scope.select("name").distinct().limit(100).collect()]  # a name and its renamings
    out = None
    for called in carried:
        inside = files.join(scope.filter(F.col("name") == called), "file_id", "left_semi").filter(F.col("text").contains(called))
        masked = extract.masked_lines(inside.select("path", "language", "text")).filter(F.col("line").contains(called))
        found = offsets_of(masked, called).select("path", "line_no", "character", F.col("line").alias("masked"))
        shown = found.join(lines(inside), ["path", "line_no"])
        out = shown if out is None else out.unionByName(shown)
    test = T.is_test_caller("path", F.lit(""))
    declared = files.filter(F.col("file_id") == declared_in).select(F.col("path").alias("_p"))
    marked = out.join(F.broadcast(declared), F.col("path") == F.col("_p"), "left").withColumn("declaration", F.col("_p").isNotNull() & F.coalesce(F.col("line_no") == F.lit(declared_line), F.lit(False)))
    columns = marked.select("path", "line_no", (T.utf16_column("line", F.col("character")) + 1).alias("column"), "line", T.hit_role("line", test, "masked").alias("role"), test.alias("test"), "declaration")
    return columns.orderBy("test", "path", "line_no", "column")


def task_tiers(files: DataFrame, symbols: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """file_id, tier of the files that a task concerns.  hits: symbol_id, strength.

    0: a symbol is spelt out there; 1: its callers, the header or source paired with it, its implementors and the tests
    beside it; 2: the other files of a small Go package; 3: any other file with a hit."""
    met = symbols.join(hits, "symbol_id")
    sure = met.filter(F.col("strength") >= names.EXACT)
    exact = sure.select("file_id").distinct()
    of = lambda kind: edges.filter(F.col("kind") == kind)
    owners = symbols.select(F.col("symbol_id").alias("src"), "file_id")
    callers = of("Call").join(sure.select(F.col("symbol_id").alias("dst")), "dst", "left_semi").join(owners, "src").select("file_id")
    focal = sure.filter(F.col("kind") == "Interface").select(F.col("symbol_id").alias("dst"))
    implementing = of("Inherit").join(focal, "dst", "left_semi").join(owners, "src").select("file_id")
    paired = graph.pairs_both_ways(of("Pair")).join(exact.select(F.col("file_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("file_id"))
    placed = files.select("file_id", "language", T.dir_of("path").alias("dir"), F.lower(T.stem_of("path")).alias("stem"))
    tested = placed.join(exact, "file_id", "left_semi").select("dir", F.col("stem").alias("base"))
    dotted = F.regexp_extract("stem", r"^(.+)\.(test|spec)$", 1)
    tests = placed.withColumn("base", F.coalesce(F.when(dotted != "", dotted), T.test_base("stem"))).join(tested, ["dir", "base"], "left_semi").select("file_id")
    go = placed.filter(F.col("language") == "Go")
    small = go.groupBy("dir").agg(F.count("*").alias("n")).filter(F.col("n") <= PACKAGE_FILES).select("dir")
    packages = go.join(exact, "file_id", "left_semi").select("dir").distinct().join(small, "dir", "left_semi")
    siblings = go.join(packages, "dir", "left_semi").select("file_id")
    tiered = [exact.withColumn("tier", F.lit(0))]
    tiered += [df.withColumn("tier", F.lit(1)) for df in (callers, implementing, paired, tests)]
    tiered += [siblings.withColumn("tier", F.lit(2)), met.select("file_id").withColumn("tier", F.lit(3))]
    both = tiered[0]
    for df in tiered[1:]:
        both = both.unionByName(df)
    return both.groupBy("file_id").agg(F.min("tier").alias("tier"))


def page_size(matched: int, listed: int, budget: int, compact: bool = False) -> int:
    """Files on a page: few if nothing matched, all of a small repository, else by the budget of tokens."""
    if not matched:
        return UNMATCHED_FILES
    if listed > matched:
        return listed
    return COMPACT_FILES if compact else min(max(budget // 100, COMPACT_FILES), MOST_FILES)


def context_page(files: DataFrame, tiers: DataFrame, scores: DataFrame, path_filter: str | None = None, offset: int = 0, budget: int = 2500, compact: bool = False) -> Answer:
    """One page of the files for a task, by tier, score and id.  A small repository is listed whole, matched files first;
    with nothing matched the files of the highest scores are."""
    kept = files if not path_filter else files.filter(F.col("path").contains(path_filter))
    ranked = kept.select("file_id", "path").join(tiers, "file_id", "left").join(scores.select(F.col("node").alias("file_id"), "score"), "file_id", "left")
    n = ranked.agg(F.count("tier").alias("matched"), F.count("*").alias("kept")).first()
    whole = n["matched"] == 0 or files.count() <= SMALL_REPO
    listed = ranked if whole else ranked.filter("tier IS NOT NULL")
    size = page_size(n["matched"], n["kept"] if whole else n["matched"], budget, compact)
    order = [F.coalesce("tier", F.lit(4)), F.coalesce("score", F.lit(0.0)).desc(), F.col("file_id")]
    return Answer("context" if n["matched"] else "unmatched", n["matched"], listed.orderBy(*order).offset(offset).limit(size))


def resolve_context(files: DataFrame, symbols: DataFrame, edges: DataFrame, task: str, **page) -> Answer:
    """The files for a task: symbols that it names, tiers around them, and a rank that starts at what it mentions."""
    hits = names.task_hits(symbols, task)
    imports = edges.filter(F.col("kind") == "Import").select("src", "dst", "weight")
    per_file = symbols.join(hits, "symbol_id").groupBy(F.col("file_id").alias("node")).agg(F.max("strength").alias("strength"), F.count("*").alias("hits"))
    marks = files.select(F.col("file_id").alias("node"), T.mentions_path(F.lit(task), F.col("path")).alias("mentioned"), F.arrays_overlap(T.split_words(T.stem_of("path")), F.array(*map(F.lit, sorted(set(names._tokens(task)) - set(T.TASK_STOP_WORDS)) or [""]))).alias("stem_match"))
    signals = marks.join(per_file, "node", "left")
    scores = graph.personalised(files.select(F.col("file_id").alias("node")), imports, signals)
    return context_page(files, task_tiers(files, symbols, edges, hits), scores, **page)

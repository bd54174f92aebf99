"""Ranked symbol lookup, word relevance and near names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What a kind of symbol counts in word relevance.
KIND_PRIOR = {"Function": 1.0, "Method": 1.0, "Class": 0.95, "Struct": 0.95, "Interface": 0.95, "Trait": 0.95, "Enum": 0.95, "Type": 0.95, "Const": 0.85, "Module": 0.85, "Field": 0.7, "Variable": 0.7}
TEST_PRIOR = 0.8
K1, B, CONTAINER_WEIGHT, PATH_WEIGHT = 1.2, 0.75, 0.5, 0.35


def match_tier(name: Column | str, needle: str) -> Column:
    """0 equal, 1 prefix, 2 substring, null otherwise; case does not count."""
    x, low = F.lower(name), needle.lower()
    return F.when(x == low, 0).when(x.startswith(low), 1).when(x.contains(low), 2)


def find_symbols(symbols: DataFrame, needle: str, order: list[Column]) -> DataFrame:
    """Matches with tier and case_differs, best first: tier, case, then ``order``."""
    hits = symbols.withColumn("tier", match_tier("name", needle)).filter("tier IS NOT NULL")
    return hits.withColumn("case_differs", ~F.col("name").contains(needle)).orderBy("tier", "case_differs", *order)


def fold_to_exact(hits: DataFrame) -> DataFrame:
    """If a hit is exact, only exact ones stay, and ``folded`` has the number of the others."""
    n = hits.agg(F.min("tier").alias("_least"), F.count_if(F.col("tier") > 0).alias("_others"))
    rows = hits.crossJoin(F.broadcast(n))
    return rows.filter((F.col("_least") > 0) | (F.col("tier") == 0)).withColumn("folded", F.when(F.col("_least") == 0, F.col("_others")).otherwise(0)).drop("_least", "_others")


def closest(symbols: DataFrame, query: str) -> DataFrame:
    """name, score: 0 equal, 1 prefix either way, 2 contained either way, 3 few edits, 4 shared words."""
    q = query.strip().lower()
    if not 3 <= len(q.encode()) <= 80:
        return symbols.select("name", F.lit(0).alias("score")).limit(0)
    edits = min(max(len(q.encode()) // 5, 1), 2)
    tokens = sorted(set(_tokens(query)))
    name, long = F.lower("name"), F.octet_length(F.lower("name")) >= 4
    shared = F.size(F.filter(F.array_distinct(T.name_tokens("name")), lambda t: (F.octet_length(t) >= 3) & t.isin(*tokens)))
    score = (
        F.when(name == q, 0)
        .when(name.startswith(q) | (F.lit(q).startswith(name) & long), 1)
        .when(name.contains(q) | (F.lit(q).contains(name) & long), 2)
        .when(F.levenshtein(name, F.lit(q)) <= edits, 3)
        .when(shared >= max(1, min(2, len(tokens))), 4)
    )
    return symbols.select("name").distinct().withColumn("score", score).filter("score IS NOT NULL")


def _tokens(text: str) -> list[str]:
    import re

    return [t.lower() for t in re.split(r"[^0-9A-Za-zÀ-￿]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)) if t]


def suggestions(symbols: DataFrame, needle: str, k: int = 5) -> DataFrame:
    """Names with a shared beginning of four letters, or at most two edits; by distance, then name."""
    low, first = needle.lower(), needle.lower()[:4]
    x = F.lower("name")
    d = F.levenshtein(x, F.lit(low))
    near = (x.startswith(first) if len(first) == 4 else F.lit(False)) | (d <= 2)
    names = symbols.groupBy(x.alias("_low")).agg(F.min("name").alias("name"))
    return names.withColumn("distance", d).filter(near).orderBy("distance", "name").limit(k).select("name", "distance")


def word_index(symbols: DataFrame) -> DataFrame:
    """symbol_id, word, field (1 own name, 2 container's), length of that name in words.  A word of both is the name's."""
    own = symbols.select("symbol_id", F.explode(T.words_of("name")).alias("word"), F.lit(1).alias("field"), F.size(T.words_of("name")).alias("length"))
    holder = symbols.select("symbol_id", F.explode(T.words_of("container")).alias("word"), F.lit(2).alias("field"), F.size(T.words_of("container")).alias("length"))
    both = own.unionByName(holder).groupBy("symbol_id", "word").agg(F.min(F.struct("field", "length")).alias("f"))
    return both.select("symbol_id", "word", "f.field", "f.length")


def word_search(symbols: DataFrame, words: list[str], k: int = 20, prior: Column | None = None) -> DataFrame:
    """symbol_id, matched, score of the best k: BM25 of single occurrences times coverage and prior."""
    words = sorted(set(words))
    index = word_index(symbols)
    stats = symbols.agg(F.count("*").alias("n"), F.avg(F.size(T.words_of("name"))).alias("avg"))
    posts = index.filter(F.col("word").isin(*words))
    df = posts.groupBy("word").agg(F.count("*").alias("df"))
    rows = posts.join(F.broadcast(df), "word").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / F.col("avg")))
    part = idf * norm * F.when(F.col("field") == 1, 1.0).otherwise(CONTAINER_WEIGHT)
    sums = rows.groupBy("symbol_id").agg(F.sum(part).alias("s"), F.count("*").alias("matched")).filter(F.col("matched") >= min(2, len(words)))
    coverage = F.col("matched") / len(words)
    score = F.col("s") * (0.5 + 0.5 * coverage) * coverage
    if prior is not None:
        sums, score = sums.join(symbols.select("symbol_id", prior.alias("_prior")), "symbol_id"), score * F.col("_prior")
    return sums.select("symbol_id", "matched", score.alias("score")).orderBy(F.round("score", 9).desc(), "symbol_id").limit(k)


def kind_prior(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, value in KIND_PRIOR.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


# Strengths of a symbol's match with a task, and where words are called generic or rare.
EXACT, EXPLICIT, SPLIT, WEAK = 4, 3, 2, 1
GENERIC_LEAST, GENERIC_SHARE, RARE = 40, 64, 8


def task_hits(symbols: DataFrame, task: str) -> DataFrame:
    """symbol_id, strength of each symbol that a task's words name.

    exact: an identifier of the task (camelCase or with _) is the name; explicit: the name stands in the task and has a
    specific word; split: two specific words, or a rare only one; weak: one.  With no hit at all, symbols that hold two
    (or all) of the task's words count as weak.
    """
    import re

    compact = re.sub(r"[\W_]", "", task).lower()
    idents = [t for t in re.findall(r"\w+", task) if re.search(r"[a-z0-9][A-Z]|_", t)]
    exact = sorted({re.sub(r"[\W_]", "", t).lower() for t in idents}) or [""]
    words = sorted({w for t in re.findall(r"[^\W_]+", task) for w in _tokens(t)}) or [""]
    rows = symbols.select("symbol_id", T.compact_lower("name").alias("c"), F.filter(T.split_words("name"), lambda w: F.octet_length(w) >= 3).alias("long"))
    rows = rows.withColumn("matched", F.filter("long", lambda w: w.isin(*words)))
    n = symbols.agg(F.count("*").alias("n"))
    df = rows.select(F.explode("matched").alias("word")).groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    least = F.greatest(F.lit(GENERIC_LEAST), F.floor(F.col("n") / GENERIC_SHARE))
    marked = df.withColumn("generic", F.col("word").isin(*T.TASK_STOP_WORDS) | (F.col("df") >= least))  # one row a task word
    lists = marked.agg(F.collect_set(F.when(~F.col("generic"), F.col("word"))).alias("specific"), F.collect_set(F.when(F.col("df") <= RARE, F.col("word"))).alias("rare"))
    rows = rows.crossJoin(F.broadcast(lists))
    special = F.array_intersect("matched", "specific")
    explicit = (F.length("c") >= 4) & F.lit(compact).contains(F.col("c")) & ((F.size(special) > 0) | ((F.size("matched") == 0) & (F.size("long") >= 2)))
    strength = (
        F.when(F.col("c").isin(*exact), EXACT)
        .when(explicit, EXPLICIT)
        .when((F.size(special) >= 2) | ((F.size(special) == 1) & (F.size("long") == 1) & F.arrays_overlap("matched", "rare")), SPLIT)
        .when(F.size(special) >= 1, WEAK)
    )
    rows = rows.withColumn("strength", strength)
    content = F.size(F.filter("matched", lambda w: ~w.isin(*T.TASK_STOP_WORDS)))
    rows = rows.withColumn("fallback", (content >= 1) & (content >= F.least(F.size("long"), F.lit(2))))
    any_hit = rows.agg(F.max("strength").isNotNull().alias("any"))
    rows = rows.crossJoin(F.broadcast(any_hit))
    out = F.when(F.col("any"), F.col("strength")).when(F.col("fallback"), WEAK)
    return rows.select("symbol_id", out.alias("strength")).filter("strength IS NOT NULL")

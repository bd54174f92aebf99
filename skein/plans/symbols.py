"""Queries over symbols, intervals and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import search as S
from ..operators import symbols as Y
from ..sources.tables import events, files, intervals, symbols, table
from .registry import FILES, INTERVALS, query

SYM = "symbols AS (SELECT p_partkey AS symbol_id, p_name AS name, p_type AS kind, p_brand AS container, p_size AS size FROM part)"
TIER = "CASE WHEN lower(name) = 'red ring' THEN 0 WHEN starts_with(lower(name), 'red') THEN 1 WHEN contains(lower(name), 'ring') THEN 2 END"
RANKED = f"WITH {SYM}, h AS (SELECT *, CASE WHEN lower(name) = 'ring' THEN 0 WHEN starts_with(lower(name), 'ring') THEN 1 WHEN contains(lower(name), 'ring') THEN 2 END AS tier FROM symbols)"


@query("symbol_rank", f"{RANKED} SELECT symbol_id, name, tier, row_number() OVER (ORDER BY tier, kind, size, container, symbol_id) AS rank FROM h WHERE tier IS NOT NULL ORDER BY rank LIMIT 25")
def symbol_rank(spark, sf_dir):
    order = [F.col(c) for c in ("kind", "size", "container", "symbol_id")]
    top = Y.find_symbols(symbols(spark, sf_dir), "ring", order).limit(25)
    return S.top_per_group(top.withColumn("_g", F.lit(0)), ["_g"], [F.col("tier"), *order], 25).select("symbol_id", "name", "tier", "rank")


@query("exact_fold", f"WITH {SYM}, h AS (SELECT *, CASE WHEN lower(name) = 'red ring' THEN 0 WHEN starts_with(lower(name), 'red ring') THEN 1 WHEN contains(lower(name), 'red ring') THEN 2 END AS tier FROM symbols), m AS (SELECT min(tier) AS least, count(*) FILTER (tier > 0) AS others FROM h) SELECT symbol_id, tier, CASE WHEN least = 0 THEN others ELSE 0 END AS folded FROM h, m WHERE tier IS NOT NULL AND (least > 0 OR tier = 0)")
def exact_fold(spark, sf_dir):
    return Y.fold_to_exact(Y.find_symbols(symbols(spark, sf_dir), "red ring", [F.col("symbol_id")])).select("symbol_id", "tier", "folded")


@query("kind_counts", f"WITH {SYM} SELECT container, kind, count(*) AS n FROM symbols GROUP BY 1, 2")
def kind_counts(spark, sf_dir):
    return symbols(spark, sf_dir).groupBy("container", "kind").agg(F.count("*").alias("n"))


@query("kind_filter", f"WITH {SYM} SELECT symbol_id, name FROM symbols WHERE kind = 'PROMO' AND size < 10")
def kind_filter(spark, sf_dir):
    return symbols(spark, sf_dir).filter("kind = 'PROMO' AND size < 10").select("symbol_id", "name")


@query(
    "closest_names",
    f"""WITH {SYM}, n AS (SELECT DISTINCT name, lower(name) AS x FROM symbols)
SELECT name, CASE WHEN x = 'red bolts' THEN 0 WHEN starts_with(x, 'red bolts') OR starts_with('red bolts', x) AND strlen(x) >= 4 THEN 1
  WHEN contains(x, 'red bolts') OR contains('red bolts', x) AND strlen(x) >= 4 THEN 2 WHEN levenshtein(x, 'red bolts') <= 1 THEN 3
  WHEN len(list_filter(list_distinct(string_split(x, ' ')), lambda t: t IN ('red', 'bolts'))) >= 2 THEN 4 END AS score
FROM n WHERE score IS NOT NULL""",
)
def closest_names(spark, sf_dir):
    return Y.closest(symbols(spark, sf_dir), "Red Bolts")


@query("symbol_suggestions", f"WITH {SYM}, n AS (SELECT lower(name) AS low, min(name) AS name FROM symbols GROUP BY 1) SELECT name, levenshtein(low, 'smal ring') AS distance FROM n WHERE starts_with(low, 'smal') OR levenshtein(low, 'smal ring') <= 2 ORDER BY distance, name LIMIT 5")
def symbol_suggestions(spark, sf_dir):
    return Y.suggestions(symbols(spark, sf_dir), "smal ring")


NAMED = "WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || p_type || 'HTTPServer2Go' || p_brand AS name FROM part)"


def named(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.translate("p_name", " ", "_"), "p_type", F.lit("HTTPServer2Go"), "p_brand").alias("name"))


WORDS_SQL = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query("split_words", f"{NAMED} SELECT id, array_to_string(list_sort(list_distinct({WORDS_SQL})), ' ') AS words FROM n")
def split_words(spark, sf_dir):
    return named(spark, sf_dir).select("id", F.array_join(T.split_words("name"), " ").alias("words"))


STEM_SQL = "CASE WHEN strlen(w) > 4 AND ends_with(w, 'ies') THEN w[:-4] || 'y' WHEN strlen(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') AND NOT regexp_matches(w, '[^\\x00-\\x7F]') THEN w[:-2] ELSE w END"
STOPS_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("stems", f"WITH {FILES}, w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM files) SELECT w AS word, {STEM_SQL} AS stem FROM w")
def stems(spark, sf_dir):
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")))
    return files(spark, sf_dir).select(words.alias("word")).distinct().select("word", T.stem(F.col("word")).alias("stem"))


WHOLE_WORDS = f"list_transform(list_filter({WORDS_SQL}, lambda w: w NOT IN ({STOPS_SQL})), lambda w: {STEM_SQL})"


@query("words_of", f"WITH d AS (SELECT doc_id AS id, text AS name FROM documents) SELECT id, array_to_string(list_sort(list_distinct({WHOLE_WORDS})), ' ') AS words FROM d")
def words_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(T.words_of("text"), " ").alias("words"))


@query("compact_names", f"{NAMED} SELECT id, lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS compact FROM n")
def compact_names(spark, sf_dir):
    return named(spark, sf_dir).select("id", T.compact_lower("name").alias("compact"))


@query(
    "word_bm25",
    f"""WITH {SYM}, own AS (SELECT symbol_id, unnest(string_split(name, ' ')) AS word, 1 AS field, 2 AS length FROM symbols),
held AS (SELECT symbol_id, unnest(['brand', replace(container, 'Brand#', '')]) AS word, 2 AS field, 2 AS length FROM symbols),
posts AS (SELECT symbol_id, word, min(field) AS field, 2 AS length FROM (SELECT * FROM own UNION ALL SELECT * FROM held) WHERE word IN ('red', 'ring', '7') GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM posts GROUP BY 1), st AS (SELECT count(*) AS n, 2.0::DOUBLE AS avg FROM symbols),
s AS (SELECT symbol_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / avg)) * CASE WHEN field = 1 THEN 1.0 ELSE 0.5 END) AS s, count(*) AS matched FROM posts JOIN df USING (word), st GROUP BY 1)
SELECT symbol_id, matched, round(s * (0.5 + 0.5 * (matched / 3.0::DOUBLE)) * (matched / 3.0::DOUBLE), 6) AS score FROM s WHERE matched >= 2 ORDER BY round(s * (0.5 + 0.5 * (matched / 3.0::DOUBLE)) * (matched / 3.0::DOUBLE), 9) DESC, symbol_id LIMIT 20""",
)
def word_bm25(spark, sf_dir):
    return Y.word_search(symbols(spark, sf_dir), ["red", "ring", "7"]).select("symbol_id", "matched", F.round("score", 6).alias("score"))


@query(
    "task_hits",
    f"""WITH {SYM}, r AS (SELECT symbol_id, replace(name, ' ', '') AS c, list_distinct(list_filter(string_split(name, ' '), lambda w: strlen(w) >= 3)) AS long FROM symbols),
m AS (SELECT *, list_filter(long, lambda w: w IN ('where', 'is', 'the', 'hot', 'gear', 'small', 'bolt', 'handled')) AS matched FROM r),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(matched) AS word FROM m) GROUP BY 1),
g AS (SELECT word, df <= 8 AS rare, word IN ('where', 'the') OR df >= greatest(40, (SELECT count(*) FROM symbols) // 64) AS generic FROM df),
l AS (SELECT coalesce(list(word) FILTER (NOT generic), []) AS specific, coalesce(list(word) FILTER (rare), []) AS rare FROM g),
s AS (SELECT symbol_id, CASE WHEN c = 'smallbolt' THEN 4
  WHEN length(c) >= 4 AND contains('whereisthehotgearsmallbolthandled', c) AND (len(list_intersect(matched, specific)) > 0 OR len(matched) = 0 AND len(long) >= 2) THEN 3
  WHEN len(list_intersect(matched, specific)) >= 2 OR len(list_intersect(matched, specific)) = 1 AND len(long) = 1 AND list_has_any(matched, rare) THEN 2
  WHEN len(list_intersect(matched, specific)) >= 1 THEN 1 END AS strength,
  len(list_filter(matched, lambda w: w NOT IN ('where', 'the'))) AS content, len(long) AS n FROM m, l)
SELECT symbol_id, CASE WHEN (SELECT max(strength) FROM s) IS NOT NULL THEN strength WHEN content >= 1 AND content >= least(n, 2) THEN 1 END AS strength FROM s
WHERE CASE WHEN (SELECT max(strength) FROM s) IS NOT NULL THEN strength WHEN content >= 1 AND content >= least(n, 2) THEN 1 END IS NOT NULL""",
)
def task_hits(spark, sf_dir):
    return Y.task_hits(symbols(spark, sf_dir), "where is the hot gear smallBolt handled")


POINTS = "points AS (SELECT event_id, user_id AS file_id, epoch_us(ts) // 1000000 + 1800 AS line FROM events)"


def points(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.col("user_id").alias("file_id"), F.expr("us div 1000000 + 1800").alias("line"))


ENCLOSE = "SELECT event_id, arg_min(name, (end_line - start_line, start_line, name)) AS name, min(end_line - start_line) AS span FROM points p JOIN intervals i ON p.file_id = i.file_id AND p.line BETWEEN i.start_line AND i.end_line"


@query("enclosing_min", f"WITH {INTERVALS}, {POINTS} {ENCLOSE} GROUP BY 1")
def enclosing_min(spark, sf_dir):
    out = I.enclosing(points(spark, sf_dir), intervals(spark, sf_dir))
    return out.select("event_id", "name", (F.col("end_line") - F.col("start_line")).alias("span"))


@query("enclosing_long", f"WITH {INTERVALS}, {POINTS} {ENCLOSE} AND i.end_line - i.start_line + 1 >= 7200 GROUP BY 1")
def enclosing_long(spark, sf_dir):
    out = I.enclosing(points(spark, sf_dir), intervals(spark, sf_dir), least_lines=7200)
    return out.select("event_id", "name", (F.col("end_line") - F.col("start_line")).alias("span"))


CONTAINS = """FROM intervals o JOIN intervals i ON o.file_id = i.file_id AND o.start_line <= i.start_line AND o.end_line >= i.end_line
  AND ((o.start_line, o.end_line) <> (i.start_line, i.end_line) OR o.kind IN ('Class', 'Module') AND i.kind = 'Method')"""


@query("containment", f"WITH {INTERVALS} SELECT i.file_id, o.name AS outer, i.name AS inner {CONTAINS}")
def containment(spark, sf_dir):
    return I.containment(intervals(spark, sf_dir)).select("file_id", F.col("outer.name").alias("outer"), F.col("inner.name").alias("inner"))


@query("containment_parent", f"WITH {INTERVALS}, p AS (SELECT i.file_id, i.name, arg_min(o.name, (o.end_line - o.start_line, -o.start_line, o.name)) AS parent, count(*) AS depth {CONTAINS} GROUP BY 1, 2) SELECT i.file_id, i.name, p.parent, coalesce(p.depth, 0) AS depth FROM intervals i LEFT JOIN p USING (file_id, name)")
def containment_parent(spark, sf_dir):
    return I.parents(intervals(spark, sf_dir)).select("file_id", "name", "parent", "depth")


@query("name_path", f"WITH {INTERVALS} SELECT DISTINCT i.file_id, i.name {CONTAINS} WHERE o.name = 'w2818' AND contains(i.name, 'r1')")
def name_path(spark, sf_dir):
    return I.name_path(intervals(spark, sf_dir), "w2818/r1", substring=True).select("file_id", "name")


@query("first_lines", f"WITH {INTERVALS} SELECT file_id, min(start_line) AS first_line, count(*) AS n FROM intervals GROUP BY 1")
def first_lines(spark, sf_dir):
    return intervals(spark, sf_dir).groupBy("file_id").agg(F.min("start_line").alias("first_line"), F.count("*").alias("n"))


# --- joins -----------------------------------------------------------------

CALLS = "calls AS (SELECT l_suppkey AS src, p_name || p_brand AS callee FROM lineitem JOIN part ON l_partkey = p_partkey), targets AS (SELECT p_partkey AS dst, p_name || p_brand AS callee FROM part)"


def calls_and_targets(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", "p_brand").alias("callee"))
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    calls = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("src"), "callee")
    return calls, part.select(F.col("p_partkey").alias("dst"), "callee")


@query("call_edges_capped", f"WITH {CALLS}, few AS (SELECT callee FROM targets GROUP BY 1 HAVING count(*) <= 2) SELECT src, dst, count(*) AS weight FROM calls JOIN targets USING (callee) WHERE callee IN (SELECT callee FROM few) AND src <> dst GROUP BY 1, 2")
def call_edges_capped(spark, sf_dir):
    calls, targets = calls_and_targets(spark, sf_dir)
    return J.fold_edges(J.capped_join(calls, targets, "callee", cap=2))


@query("division", "WITH need AS (SELECT DISTINCT p_brand AS iface, p_type AS item FROM part WHERE p_size <= 3), have AS (SELECT DISTINCT l_orderkey AS owner, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT iface, owner FROM have JOIN need USING (item) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM need n WHERE n.iface = need.iface)")
def division(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("iface"), F.col("p_type").alias("item"), "p_size")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), "l_partkey")
    have = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select("owner", "item")
    return J.division(have, part.filter("p_size <= 3"), "item", "iface", "owner")


MODULES = "modules AS (SELECT DISTINCT source AS name, 'top' AS dir FROM documents UNION SELECT DISTINCT source || '/' || lang, 'x/' || lang FROM documents WHERE lang <> 'es')"


@query("longest_prefix", f"WITH {FILES}, {MODULES} SELECT path AS spec, arg_max(name, length(name)) AS module, arg_max(dir, length(name)) AS dir FROM files JOIN modules ON starts_with(path, name || '/') GROUP BY 1")
def longest_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tops = d.select(F.col("source").alias("name"), F.lit("top").alias("dir"))
    subs = d.filter("lang != 'es'").select(F.concat_ws("/", "source", "lang").alias("name"), F.concat(F.lit("x/"), "lang").alias("dir"))
    return J.longest_prefix(files(spark, sf_dir).select(F.col("path").alias("spec")), tops.unionByName(subs).distinct())


CANDIDATES = """cand AS (SELECT path, p AS priority, CASE p WHEN 0 THEN source || '/en/doc_' || (doc_id + 1) || '.txt' WHEN 1 THEN source || '/fr/doc_' || (doc_id + 20) || '.txt' ELSE 'src' || (doc_id % 5) || '/de/doc_' || (doc_id * 3) || '.txt' END AS candidate
  FROM (SELECT doc_id, source, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents), range(3) r(p))"""


def candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = lambda e: F.expr(f"cast({e} as string)")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), i("doc_id"), F.lit(".txt"))
    tries = F.array(
        F.concat("source", F.lit("/en/doc_"), i("doc_id + 1"), F.lit(".txt")),
        F.concat("source", F.lit("/fr/doc_"), i("doc_id + 20"), F.lit(".txt")),
        F.concat(F.lit("src"), i("doc_id % 5"), F.lit("/de/doc_"), i("doc_id * 3"), F.lit(".txt")),
    )
    return d.select(path.alias("path"), F.posexplode(tries).alias("priority", "candidate"))


@query("first_match", f"WITH {FILES}, {CANDIDATES} SELECT c.path, arg_min(candidate, priority) AS target FROM cand c JOIN files f ON f.path = candidate WHERE candidate <> c.path GROUP BY 1")
def first_match(spark, sf_dir):
    return J.first_match(candidates(spark, sf_dir), files(spark, sf_dir), ["path"])


@query("unresolved", f"WITH {FILES}, {CANDIDATES}, i AS (SELECT path, CASE WHEN doc_id % 2 = 0 THEN './x' ELSE 'y' END AS spec FROM files) SELECT path, spec FROM i WHERE starts_with(spec, '.') AND path NOT IN (SELECT c.path FROM cand c JOIN files f ON f.path = candidate WHERE candidate <> c.path)")
def unresolved(spark, sf_dir):
    f = files(spark, sf_dir)
    imports = f.select("path", F.when(F.col("doc_id") % 2 == 0, "./x").otherwise("y").alias("spec"))
    return J.unresolved(imports, J.first_match(candidates(spark, sf_dir), f, ["path"]), ["path"])


@query("user_path", f"WITH {FILES}, w AS (SELECT CASE WHEN doc_id % 3 = 0 THEN path ELSE language || '/doc_' || doc_id || '.txt' END AS given FROM files) SELECT given, arg_min(path, (path <> given, length(path), path)) AS path FROM w JOIN files ON path = given OR ends_with(path, '/' || given) GROUP BY 1")
def user_path(spark, sf_dir):
    f = files(spark, sf_dir)
    short = F.concat("language", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return J.by_suffix(f.select(F.when(F.col("doc_id") % 3 == 0, F.col("path")).otherwise(short).alias("given")), f)


@query("nearest", f"WITH {FILES}, m AS (SELECT 'src' || (doc_id % 3) || '/' || language || '/doc_' || (doc_id % 50) || '.txt' AS path FROM files), t AS (SELECT DISTINCT path FROM m), w AS (SELECT path AS importer, 'doc_' || (doc_id % 50) || '.txt' AS base FROM files), j AS (SELECT importer, base, t.path AS target, CASE WHEN split_part(importer, '/', 1) <> split_part(t.path, '/', 1) THEN 0 WHEN split_part(importer, '/', 2) <> split_part(t.path, '/', 2) THEN 1 ELSE 2 END AS shared FROM w JOIN t ON regexp_extract(t.path, '([^/]*)$', 1) = base WHERE importer <> t.path) SELECT importer, base, arg_min(target, (-shared, length(target), target)) AS target FROM j GROUP BY 1, 2")
def nearest(spark, sf_dir):
    f = files(spark, sf_dir)
    base = F.concat(F.lit("doc_"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt"))
    have = f.select(F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), "language", F.lit("/"), base).alias("path")).distinct()
    return J.nearest(f.select(F.col("path").alias("importer"), base.alias("base")), have)


@query("pattern_match", "WITH s AS (SELECT DISTINCT source || '/' || lang AS spec FROM documents) SELECT spec, CASE WHEN spec = 'src1/en' THEN 'src1/en' WHEN starts_with(spec, 'src1') THEN 'src1*' ELSE '*' END AS pattern, CASE WHEN spec = 'src1/en' THEN 'one' WHEN starts_with(spec, 'src1') THEN 'a/' || substr(spec, 5) ELSE 'all/' || spec || '/x' END AS target FROM s")
def pattern_match(spark, sf_dir):
    specs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("spec")).distinct()
    patterns = spark.createDataFrame([(0, "*", "all/*/x"), (1, "src1*", "a/*"), (2, "src1/en", "one"), (3, "src1*", "late/*")], "ord int, pattern string, target string")
    return J.pattern_match(specs, patterns)


@query("semi_join", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY 1")
def semi_join(spark, sf_dir):
    promo = table(spark, sf_dir, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(promo, "l_partkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def anti_join(spark, sf_dir):
    buyers = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(buyers, "c_custkey", "left_anti").select("c_custkey", "c_name")

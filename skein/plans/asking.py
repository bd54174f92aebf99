"""Queries of lookups, predicates on what is asked, entry points and what is told beside an answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ask as A
from ..operators import changes as C
from ..operators import graph as G
from ..operators import joins as J
from ..operators import search as S
from ..sources import scan
from ..sources.tables import events, file_graph, files, lines, symbols, table
from .graph import NODES, RANK, THIN, first_target, nodes, thin
from .registry import EVENTS, FILES, LINES, query
from .symbols import SYM, named

BASE = "regexp_extract(path, '([^/]*)$', 1)"
DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def variant(column, forms):
    """The form of a row: the one that its key's remainder picks, with ``{}`` for the column."""
    parts = [F.concat(F.lit(f.partition("{}")[0]), F.col(column), F.lit(f.partition("{}")[2])) if "{}" in f else F.lit(f) for f in forms]
    return F.element_at(F.array(*parts), (F.col("p_partkey") % len(forms) + 1).cast("int"))


def variant_sql(column, forms):
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [f"{quote(f.partition('{}')[0])} || {column} || {quote(f.partition('{}')[2])}" if "{}" in f else quote(f) for f in forms]
    return f"[{', '.join(parts)}][1 + p_partkey % {len(forms)}]"


# --- lookups ---------------------------------------------------------------


@query("prefix_seek", f"WITH {FILES} SELECT path FROM files WHERE starts_with(path, 'src1/')")
def prefix_seek(spark, sf_dir):
    return J.prefix_seek(files(spark, sf_dir), "src1/").select("path")


@query("dir_listing", f"WITH {FILES}, d AS (SELECT DISTINCT source || '/en' AS dir FROM documents) SELECT dir, path FROM d JOIN files ON {DIR} = dir")
def dir_listing(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/en")).alias("dir"))
    return J.dir_listing(files(spark, sf_dir), wanted)


@query("files_named", f"WITH {FILES} SELECT {BASE} AS base, path FROM files WHERE {BASE} IN (SELECT 'doc_' || p_partkey || '.txt' FROM part)")
def files_named(spark, sf_dir):
    return J.files_named(files(spark, sf_dir), table(spark, sf_dir, "part").selectExpr("concat('doc_', p_partkey, '.txt') as base"))


@query("override_lookup", "WITH o AS (SELECT p_brand AS declared_in, p_type AS name, arg_min(p_name, p_partkey) AS target FROM part WHERE p_size > 40 GROUP BY 1, 2) SELECT p_partkey || '.rs' AS path, declared_in, name, target FROM part JOIN o ON p_brand = declared_in AND p_type = name")
def override_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    imports = part.selectExpr("concat(p_partkey, '.rs') as path", "p_brand as declared_in", "p_type as name")
    return J.override_lookup(imports, part.filter("p_size > 40").selectExpr("p_partkey as ord", "p_brand as declared_in", "p_type as name", "p_name as target"))


@query("redetected", "WITH r AS (SELECT DISTINCT source AS resolver, 'go.' || lang AS path FROM documents WHERE n_chars > 4000), c AS (SELECT DISTINCT 'go.' || lang AS path FROM documents WHERE n_chars > 20000) SELECT DISTINCT resolver FROM r WHERE path IN (SELECT path FROM c)")
def redetected(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("resolver"), F.concat(F.lit("go."), "lang").alias("path"), "n_chars")
    return J.redetected(d.filter("n_chars > 4000").select("resolver", "path"), d.filter("n_chars > 20000").select("path"))


@query("declared_excludes", f"WITH {FILES} SELECT path, CASE WHEN starts_with(path, 'src1/de/') OR starts_with(path, 'src2/') OR path = 'src3/en/doc_3.txt' THEN 'Ignored' END AS reason FROM files")
def declared_excludes(spark, sf_dir):
    return scan.without_declared(files(spark, sf_dir), ["./src1/de/", "src2", "/src3/en/doc_3.txt", ".", "", "src"])


@query("coverage_report", f"""WITH {LINES}, l AS (SELECT path, count(*) AS n FROM lines GROUP BY 1), g AS (SELECT language, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS loc FROM files LEFT JOIN l USING (path) GROUP BY 1),
m AS (SELECT CASE WHEN n_chars > 9000 THEN 'TooLarge' ELSE 'Excluded' END AS reason, count(*) AS n FROM documents WHERE n_chars > 5000 GROUP BY 1),
p AS (SELECT 0 AS part, k, line FROM (VALUES (0, '# Coverage'), (1, ''), (2, '| language | files | lines |'), (3, '|-|-|-|')) t(k, line)
  UNION ALL SELECT 1, row_number() OVER (ORDER BY files DESC, language), '| ' || coalesce(language, '-') || ' | ' || files || ' | ' || loc || ' |' FROM g
  UNION ALL SELECT 2, k, line FROM (VALUES (0, ''), (1, '## Not indexed'), (2, '')) t(k, line)
  UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, reason), '- ' || reason || ': ' || n FROM m)
SELECT row_number() OVER (ORDER BY part, k) AS line_no, line FROM p""")
def coverage_report(spark, sf_dir):
    gaps = table(spark, sf_dir, "documents").filter("n_chars > 5000").groupBy(F.when(F.col("n_chars") > 9000, "TooLarge").otherwise("Excluded").alias("reason")).agg(F.count("*").alias("n"))
    return scan.report_lines(gaps, S.language_totals(files(spark, sf_dir)))


# --- what is asked ---------------------------------------------------------

FORMS = ["{}", "a|{}", "^{}", "{}$", "{}\\$", "{}(x)", "({})", "({}) => 1", "fn f(", "{}.*", "\\b{}", "{}\\(", "./a/{}.rs", "/{}", "/a/{}", "~/{}", "C:\\{}", "{}/", "x.PY", "*", "", "f.txt", "obj.m (a)", "(a){}) {"]
REGEX = r"(regexp_matches(q, '\||\.\*|\.\+|\\[bsdw]|\(\?') OR starts_with(q, '^') AND length(q) > 1 OR ends_with(q, '$') AND length(q) > 1 AND NOT ends_with(q, '\$'))"
CODE = ", ".join(f"'{e}'" for e in T.CODE_EXTENSIONS)


@query(
    "query_shapes",
    rf"""WITH v AS (SELECT p_partkey, {variant_sql("p_name", FORMS)} AS q FROM part), c AS (SELECT *, regexp_replace(trim(q), '^(\./)+', '') AS t, {REGEX} AS regex FROM v),
e AS (SELECT *, lower(regexp_extract(regexp_extract(t, '([^/]*)$', 1), '\.([A-Za-z0-9]+)$', 1)) IN ({CODE}) AS code FROM c)
SELECT p_partkey, regex, NOT regex AND NOT regexp_matches(q, '\\[()]') AND contains(q, '(') AND CASE WHEN starts_with(q, '(') THEN regexp_matches(q, '=>|\) ?\{{') ELSE regexp_matches(q, '^[^(]*[\p{{L}}\p{{N}}_]\s*\(') END AS code,
  t <> '' AND t <> '*' AND CASE WHEN regexp_matches(t, '^[/\\]') THEN length(t) > 1 AND (regexp_matches(substr(t, 2), '[/\\]') OR code) ELSE regexp_matches(t, '^~[/\\]|^[A-Za-z]:[/\\]|\\|/$') OR code END AS path
FROM e""",
)
def query_shapes(spark, sf_dir):
    q = table(spark, sf_dir, "part").select("p_partkey", variant("p_name", FORMS).alias("q"))
    return q.select("p_partkey", T.looks_like_regex("q").alias("regex"), T.looks_like_code("q").alias("code"), T.looks_like_path("q").alias("path"))


NAMES = ["func {}", "{}::new", "pkg.{}", "class", "::a::{}", "struct class", "a/b.{}", "  fn   x.y ", "{}", "Type.", "def Class::m"]
KEYWORDS = ", ".join(f"'{k}'" for k in T.QUERY_KEYWORDS)


@query(
    "symbol_queries",
    rf"""WITH v AS (SELECT p_partkey, list_filter(regexp_split_to_array({variant_sql("p_type", NAMES)}, '\s+'), lambda t: t <> '') AS t FROM part),
k AS (SELECT p_partkey, array_to_string(CASE WHEN len(t) > 1 AND len(list_filter(t, lambda x: lower(x) NOT IN ({KEYWORDS}))) > 0 THEN list_filter(t, lambda x: lower(x) NOT IN ({KEYWORDS})) ELSE t END, ' ') AS q FROM v),
p AS (SELECT *, list_filter(regexp_split_to_array(q, '::|\.'), lambda x: x <> '') AS s FROM k)
SELECT p_partkey, CASE WHEN NOT contains(q, '/') AND len(s) > 1 THEN CASE WHEN starts_with(q, '::') THEN '/' ELSE '' END || array_to_string(s, '/') ELSE q END AS name FROM p""",
)
def symbol_queries(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.symbol_query(variant("p_type", NAMES)).alias("name"))


@query("utf16_columns", rf"WITH {LINES} SELECT path, line_no, (length(line) + len(regexp_extract_all(line, '[\x{{10000}}-\x{{10FFFF}}]')))::BIGINT AS units FROM lines")
def utf16_columns(spark, sf_dir):
    return lines(files(spark, sf_dir)).select("path", "line_no", T.utf16_column("line", F.length("line")).cast("bigint").alias("units"))


@query("name_tokens", r"WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || p_type || 'HTTPServer2Go' || p_brand AS name FROM part) SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') AS tokens FROM n")
def name_tokens(spark, sf_dir):
    return named(spark, sf_dir).select("id", F.array_join(T.name_tokens("name"), " ").alias("tokens"))


STEMS = ["{}_test", "{}test", "test_{}", "{}", "_test", "test", "test_"]


@query("test_bases", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN p_type END AS base FROM part")
def test_bases(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.test_base(variant("p_type", STEMS)).alias("base"))


NOTES = "".join(f" WHEN {n} THEN '{v}'" for n, v in enumerate(T.CONFIDENCE_NOTES.values()))


@query("confidence_notes", f"SELECT p_partkey, CASE p_partkey % 5{NOTES} END AS note FROM part")
def confidence_notes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.confidence_note(variant("p_type", [*T.CONFIDENCE_NOTES, "else"])).alias("note"))


@query("decorated_lines", f"WITH {SYM} SELECT symbol_id, name || '  @x' || CASE WHEN size % 3 = 0 THEN '  [in ' || h || ']' ELSE '  [' || lower(kind) || ' in ' || h || ']' END AS line FROM (SELECT *, CASE WHEN length(container || name || kind) > 24 THEN substr(container || name || kind, 1, 23) || '…' ELSE container || name || kind END AS h FROM symbols)")
def decorated_lines(spark, sf_dir):
    signature = F.when(F.col("size") % 3 == 0, F.concat(F.lit("  "), F.lower("kind"), F.lit(" x"))).otherwise(F.concat("kind", F.lit("x")))
    return symbols(spark, sf_dir).select("symbol_id", T.decorated(F.concat("name", F.lit("  @x")), "kind", F.concat("container", "name", "kind"), signature).alias("line"))


SEVERITY = "CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'information' WHEN 'view' THEN 'hint' ELSE 'note' END"


@query("severity_floor", f"SELECT event_id, {SEVERITY} AS severity FROM events WHERE event_type IN ('error', 'purchase')")
def severity_floor(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(SEVERITY).alias("severity")).filter(T.at_least("severity", "warning"))


PATHS = ["a/{}_test.go", "tests/{}.json", "src/{}.rs", "docs/{}.py", "{}.md", "x/testdata/{}.golden", "README.txt", "x/{}.txt", "e2e/{}.ts", "lib/data/{}.csv", "test_{}.py", "probe/{}.c"]


@query("path_classes", "SELECT p_partkey, [true, true, false, true, false, true, false, false, true, false, true, true][1 + p_partkey % 12] AS last, [true, true, false, false, false, false, false, false, false, false, true, false][1 + p_partkey % 12] OR p_size > 25 AS test, [false, false, false, true, true, false, true, false, false, false, false, false][1 + p_partkey % 12] AS prose, [false, true, false, false, false, true, false, false, false, true, false, false][1 + p_partkey % 12] AS data FROM part")
def path_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", variant("p_type", PATHS).alias("path"), F.when(F.col("p_size") > 25, "TestX").otherwise("aTest").alias("caller"))
    return rows.select("p_partkey", T.is_test_path("path").alias("last"), T.is_test_caller("path", "caller").alias("test"), T.is_doc_path("path").alias("prose"), T.is_data_fixture("path").alias("data"))


# --- entry points ----------------------------------------------------------

ASKED = ["license", "the", "Licensed", "zzzz nowhere", "e"]


@query("search_shapes", f"""WITH {LINES}, a AS (SELECT unnest({ASKED}) AS query), h AS (SELECT query, path FROM a LEFT JOIN lines ON CASE WHEN query = 'Licensed' THEN contains(line, query) ELSE contains(lower(line), query) END),
n AS (SELECT query, count(path) AS total, count(DISTINCT path) AS files FROM h GROUP BY 1)
SELECT query, total, CASE WHEN total = 0 THEN 'none' WHEN total BETWEEN 6 AND 60 AND files > 3 THEN 'grouped' WHEN total > 60 THEN 'broad' WHEN total <= 5 THEN 'bodies' ELSE 'lines' END AS shape FROM n""")
def search_shapes(spark, sf_dir):
    answers = [(q, A.search_code(files(spark, sf_dir), S.Search(q))) for q in ASKED]
    return spark.createDataFrame([(q, a.total, a.shape) for q, a in answers], "query string, total long, shape string")


@query("search_code", f"WITH {LINES}, h AS (SELECT {DIR} AS key, count(*) AS hits, count(DISTINCT path) AS files FROM lines WHERE lower(line) LIKE '%license%' AND starts_with(path, 'src') GROUP BY 1) SELECT key, hits, files FROM h ORDER BY hits DESC, key LIMIT 80")
def search_code(spark, sf_dir):
    return A.search_code(files(spark, sf_dir), S.Search("license", path_filter="src"), aggregate="dir").rows.select("key", "hits", "files")


@query("find_symbol", f"WITH {SYM}, h AS (SELECT *, CASE WHEN lower(name) = 'red ring' THEN 0 WHEN starts_with(lower(name), 'red ring') THEN 1 WHEN contains(lower(name), 'red ring') THEN 2 END AS tier FROM symbols WHERE kind = 'PROMO'), m AS (SELECT min(tier) AS least, count(*) FILTER (tier > 0) AS others FROM h) SELECT symbol_id, name, tier, CASE WHEN least = 0 THEN others ELSE 0 END AS folded FROM h, m WHERE tier IS NOT NULL AND (least > 0 OR tier = 0) ORDER BY tier, symbol_id LIMIT 80")
def find_symbol(spark, sf_dir):
    a = A.find_symbol(symbols(spark, sf_dir), "red ring", [F.col("symbol_id")], kind="promo")
    rows = a.rows if "folded" in a.rows.columns else a.rows.withColumn("folded", F.lit(0).cast("bigint"))
    return rows.select("symbol_id", "name", "tier", "folded") if "tier" in rows.columns else symbols(spark, sf_dir).select("symbol_id", "name", F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("folded")).limit(0)


@query("find_refs", """WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'tests/f' ELSE 'src/f' END || p_partkey || '.py' AS path FROM part)
SELECT path, line_no, col AS "column", CASE WHEN k % 5 = 0 THEN 'ref' ELSE role END AS role, false AS declaration FROM f, (VALUES (1, 18, 'load'), (3, 5, 'use'), (3, 14, 'use')) t(line_no, col, role) WHERE k > 1 AND k % 3 = 0
UNION ALL SELECT path, 1, 5, 'def', true FROM f WHERE k = 1""")
def find_refs(spark, sf_dir):
    """The first file declares go_on; every third file imports it; all files say the word in a comment and a string."""
    k = F.col("p_partkey")
    body = F.when(k == 1, "def go_on(a):\n    return a\n").otherwise("from m.f1 import go_on  # go_on\ns = 'go_on'\ny = go_on(1, go_on)\nz = go_on2\n")
    rows = table(spark, sf_dir, "part").select(k.alias("file_id"), F.concat(F.when(k % 5 == 0, "tests/f").otherwise("src/f"), k.cast("string"), F.lit(".py")).alias("path"), F.lit("Python").alias("language"), body.alias("text"))
    imports = rows.filter("file_id % 3 = 0 AND file_id > 1").select(F.col("file_id").alias("src"), F.lit(1).cast("bigint").alias("dst"), F.lit("Import").alias("kind"))
    return A.find_refs(rows, imports, "go_on", 1, 1).select("path", "line_no", "column", "role", "declaration")


TASK_FILES = "tf AS (SELECT f AS file_id, CASE WHEN f % 4 = 0 THEN 'Go' ELSE 'Python' END AS language, 'd' || (f % 6) AS dir, CASE WHEN f % 10 = 1 THEN 's' || (f + 5) || '_test' ELSE 's' || f END AS stem FROM range(97) r(f))"


@query(
    "task_tiers",
    f"""WITH {SYM}, {TASK_FILES}, s AS (SELECT symbol_id, symbol_id % 97 AS file_id, kind FROM symbols), h AS (SELECT symbol_id, CASE WHEN size = 50 AND container = 'Brand#11' THEN 4 ELSE 2 END AS strength FROM symbols WHERE size = 50),
sure AS (SELECT symbol_id, file_id, kind FROM s JOIN h USING (symbol_id) WHERE strength = 4), exact AS (SELECT DISTINCT file_id FROM sure),
t AS (SELECT file_id, 0 AS tier FROM exact
  UNION ALL SELECT c.file_id, 1 FROM sure x JOIN s c ON c.symbol_id = x.symbol_id + 1
  UNION ALL SELECT c.file_id, 1 FROM sure x JOIN s c ON c.symbol_id = x.symbol_id + 7 WHERE x.kind = 'Interface'
  UNION ALL SELECT f.file_id, 1 FROM tf f JOIN tf e ON f.stem = e.stem || '_test' AND f.dir = e.dir JOIN exact x ON x.file_id = e.file_id
  UNION ALL SELECT (x.file_id + 50) % 97, 1 FROM exact x WHERE x.file_id % 3 = 0 UNION ALL SELECT (x.file_id + 47) % 97, 1 FROM exact x WHERE (x.file_id + 47) % 97 % 3 = 0
  UNION ALL SELECT f.file_id, 2 FROM tf f WHERE f.language = 'Go' AND f.dir IN (SELECT e.dir FROM tf e JOIN exact x ON x.file_id = e.file_id WHERE e.language = 'Go') AND f.dir IN (SELECT dir FROM tf WHERE language = 'Go' GROUP BY 1 HAVING count(*) <= 12)
  UNION ALL SELECT s.file_id, 3 FROM s JOIN h USING (symbol_id))
SELECT file_id, min(tier) AS tier FROM t GROUP BY 1""",
)
def task_tiers(spark, sf_dir):
    s = symbols(spark, sf_dir)
    owned = s.select("symbol_id", (F.col("symbol_id") % 97).alias("file_id"), "kind")
    hits = s.filter("size = 50").select("symbol_id", F.when(F.col("container") == "Brand#11", 4).otherwise(2).alias("strength"))
    f = spark.range(97).withColumnRenamed("id", "file_id")
    stem = F.expr("if(file_id % 10 = 1, concat('s', file_id + 5, '_test'), concat('s', file_id))")
    placed = f.select("file_id", F.when(F.col("file_id") % 4 == 0, "Go").otherwise("Python").alias("language"), F.concat(F.expr("concat('d', file_id % 6, '/')"), stem, F.lit(".x")).alias("path"))
    calls = s.select((F.col("symbol_id") + 1).alias("src"), F.col("symbol_id").alias("dst"), F.lit("Call").alias("kind"))
    inherits = s.select((F.col("symbol_id") + 7).alias("src"), F.col("symbol_id").alias("dst"), F.lit("Inherit").alias("kind"))
    pairs = f.filter("file_id % 3 = 0").select(F.col("file_id").alias("src"), ((F.col("file_id") + 50) % 97).alias("dst"), F.lit("Pair").alias("kind"))
    return A.task_tiers(placed, owned, calls.union(inherits).union(pairs), hits)


@query("routes", "SELECT * FROM (VALUES ('FileDependencies', 'Graph'), ('FileImpact', 'Graph'), ('RepoSkeleton', 'Graph'), ('TaskRank', 'Graph'), ('FuzzySymbol', 'Graph'), ('PreciseReferences', 'LanguageServer'), ('GotoDefinition', 'LanguageServer'), ('Diagnostics', 'LanguageServer'), ('PrepareRename', 'LanguageServer')) t(kind, source)")
def routes(spark, sf_dir):
    return spark.createDataFrame(list(A.ROUTES.items()), "kind string, source string")


@query("reference_groups", f"WITH {LINES}, r AS (SELECT *, regexp_matches(path, '[37]\\.txt$') AS test FROM lines WHERE contains(lower(line), 'e')), n AS (SELECT test, path, count(*) AS hits FROM r WHERE (SELECT count(*) > 150 FROM r) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY hits DESC, path) AS rank FROM n) SELECT test, path, hits, rank FROM k WHERE rank <= CASE WHEN test THEN 15 ELSE 25 END")
def reference_groups(spark, sf_dir):
    return S.reference_groups(S.Search("e").hits(files(spark, sf_dir)), F.col("path").rlike(r"[37]\.txt$")).select("test", "path", "hits", "rank")


# --- rank and freshness ----------------------------------------------------


@query(
    "dependents_ranked",
    f"""WITH RECURSIVE {THIN}, {NODES}, base AS (SELECT id, 1.0 / n AS restart FROM nodes),
{RANK.format(r="r", base="base", graph="thin", links="links", dangling="dangling")},
c AS (SELECT (SELECT min(dst) FROM thin WHERE src = 0) AS node UNION SELECT t.src FROM c JOIN thin t ON t.dst = c.node),
f AS (SELECT n_nationkey AS node, lower(n_name) AS path FROM nation), l AS (SELECT s_nationkey AS node, min(s_suppkey) AS first_line FROM supplier GROUP BY 1)
SELECT c.node, path, row_number() OVER (ORDER BY round(score, 12) DESC, path, coalesce(first_line, 0), c.node) AS rank FROM c JOIN f USING (node) JOIN r_done USING (node) LEFT JOIN l USING (node) WHERE c.node <> (SELECT min(dst) FROM thin WHERE src = 0)""",
)
def dependents_ranked(spark, sf_dir):
    edges = thin(file_graph(spark, sf_dir))
    named_files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), F.lower("n_name").alias("path"))
    first = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file_id"), F.col("s_suppkey").alias("start_line"))
    scores = G.pagerank(nodes(spark, sf_dir), G.adjacency(edges))
    return G.ranked_closure(G.closure(edges, first_target(edges), reverse=True), scores, named_files, first).select("node", "path", "rank")


@query("barrier_answers", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fresh' WHEN event_id % 3 = 1 THEN 'repaired' WHEN value <= 2 THEN 'fresh' ELSE 'stale' END AS told FROM events")
def barrier_answers(spark, sf_dir):
    decision = F.element_at(F.array(*map(F.lit, ("Fresh", "Repair", "Degrade"))), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", C.barrier_answer(decision, F.col("value")).alias("told"))


@query("safety_waits", "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_id % 100 WHEN event_id % 100 = 0 THEN 60 ELSE least(event_id % 100, 60) END::BIGINT AS wait FROM events")
def safety_waits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.safety_wait(F.col("event_id") % 100, F.col("event_type") == "error").cast("bigint").alias("wait"))


@query("verified_suspects", f"WITH {EVENTS}, m AS (SELECT min(us) + (max(us) - min(us)) // 2 AS a, max(us) AS b FROM ev) SELECT path, b + 1 AS at FROM (SELECT DISTINCT 'u' || user_id AS path FROM ev, m WHERE us > a AND event_type = 'error' UNION SELECT DISTINCT 'u' || user_id FROM ev WHERE event_type = 'signup'), m")
def verified_suspects(spark, sf_dir):
    e = events(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("us").alias("at"), "event_type")
    ends = e.agg(F.expr("min(at) + (max(at) - min(at)) div 2").alias("a"), F.max("at").alias("b")).first()
    return C.verified(e.filter("event_type = 'error'"), e.filter("event_type = 'signup'"), ends["a"], ends["b"])

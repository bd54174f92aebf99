"""Queries of shaped results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import reports as R
from ..sources.tables import events, files, intervals, table
from .registry import EVENTS, FILES, INTERVALS, query
from .symbols import points

POINTS = "points AS (SELECT event_id, user_id AS file_id, epoch_us(ts) // 1000000 + 1800 AS line FROM events)"


@query("merged_bodies", f"WITH {INTERVALS}, {POINTS}, b AS (SELECT event_id, any_value(p.file_id) AS file_id, any_value(p.line) AS line, arg_min((i.name, i.start_line, i.end_line), (i.end_line - i.start_line, i.start_line, i.name)) AS b FROM points p JOIN intervals i ON p.file_id = i.file_id AND p.line BETWEEN i.start_line AND i.end_line AND i.end_line - i.start_line >= 2 GROUP BY 1) SELECT file_id, b[1] AS name, count(*) AS hits, min(line) AS first, b[3] - b[2] + 1 < 20000 AS shown FROM b GROUP BY file_id, b")
def merged_bodies(spark, sf_dir):
    return R.merged_bodies(points(spark, sf_dir), intervals(spark, sf_dir), longest=20_000).select("file_id", "name", "hits", "first", "shown")


@query(
    "call_graph",
    f"""WITH {INTERVALS}, c AS (SELECT event_id, user_id AS file_id, epoch_us(ts) // 1000000 AS line, 'r' || (event_id % 120) AS callee FROM events WHERE event_type = 'click'),
e AS (SELECT event_id, any_value(c.callee) AS callee, arg_min(s.file_id || ':' || s.name || ':' || s.start_line, (s.end_line - s.start_line, s.start_line, s.name)) AS src FROM c JOIN intervals s ON c.file_id = s.file_id AND c.line BETWEEN s.start_line AND s.end_line GROUP BY 1),
t AS (SELECT name AS callee, file_id || ':' || name || ':' || start_line AS dst, count(*) OVER (PARTITION BY name) AS n FROM intervals)
SELECT src, dst, count(*) AS weight FROM e JOIN t USING (callee) WHERE n <= {R.MAX_TARGETS} AND src <> dst GROUP BY 1, 2""",
)
def call_graph(spark, sf_dir):
    """Over every file, with the operator's own cap: runs of late numbers are in few files."""
    e = events(spark, sf_dir).filter("event_type = 'click'")
    calls = e.select(F.col("user_id").alias("file_id"), F.expr("us div 1000000").alias("line"), F.expr("concat('r', event_id % 120)").alias("callee"))
    return R.call_graph(calls, intervals(spark, sf_dir))


@query("callers", f"WITH {EVENTS}, r AS (SELECT 'u' || (user_id % 10) AS path, event_type AS name, event_id % 20 AS line FROM ev), g AS (SELECT path, name, count(*) AS n, list_sort(list_distinct(list(line))) AS l FROM r WHERE name IN ('click', 'view') GROUP BY 1, 2), k AS (SELECT row_number() OVER (ORDER BY n DESC, path, name) AS rank, name || '@' || path || '×' || n || '(' || array_to_string(l, ',') || ')' AS text FROM g WHERE (SELECT count(*) FILTER (name NOT IN ('click', 'view')) > count(*) FILTER (name IN ('click', 'view')) FROM r)) SELECT rank, text FROM k WHERE rank <= 12")
def callers(spark, sf_dir):
    refs = events(spark, sf_dir).select(F.expr("concat('u', user_id % 10)").alias("path"), F.col("event_type").alias("name"), F.expr("event_id % 20").alias("line"))
    return R.callers(refs, ~F.col("name").isin("click", "view"))


@query("implementors", "WITH need AS (SELECT DISTINCT p_brand AS iface, p_type AS item FROM part WHERE p_size <= 3), have AS (SELECT DISTINCT l_orderkey AS owner, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT iface, owner FROM have JOIN need USING (item) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM need n WHERE n.iface = need.iface)), r AS (SELECT *, row_number() OVER (PARTITION BY iface ORDER BY owner) AS rk FROM d) SELECT iface, count(*) AS n, string_agg(CASE WHEN rk <= 10 THEN owner::VARCHAR END, ',' ORDER BY owner) AS first FROM r GROUP BY 1")
def implementors(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("iface"), F.col("p_type").alias("item"), "p_size")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), "l_partkey")
    have = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select("owner", "item")
    return R.implementors(J.division(have, part.filter("p_size <= 3"), "item", "iface", "owner"), "iface", "owner")


@query("path_suggestions", f"WITH {FILES}, p AS (SELECT path FROM files UNION SELECT split_part(path, '/', 1) FROM files UNION SELECT split_part(path, '/', 1) || '/' || language FROM files) SELECT path, list_contains(string_split(path, '/'), 'src1')::INT + list_contains(string_split(path, '/'), 'english')::INT AS shared, levenshtein(regexp_extract(path, '([^/]*)$', 1), 'english') AS edits FROM p ORDER BY shared DESC, edits, length(path), path LIMIT 5")
def path_suggestions(spark, sf_dir):
    return R.path_suggestions(files(spark, sf_dir), "src1/english")


@query("directed_diff", f"WITH {FILES} SELECT path, 'Modified' AS change FROM files WHERE doc_id % 2 = 0 AND (path LIKE 'src4/%' OR doc_id = 41)")
def directed_diff(spark, sf_dir):
    f = files(spark, sf_dir)
    now = f.select("path", (F.col("doc_id") % 2).alias("m"))
    suspects = f.filter("doc_id = 41").select("path").union(spark.createDataFrame([("src4",), ("nowhere",)], "path string"))
    return R.directed_diff(now.withColumn("m", F.lit(1).cast("bigint")), now, suspects, "path", ["m"])


@query("changeset_filter", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Removed' WHEN lang IN ('en', 'de') OR doc_id % 5 = 0 THEN CASE WHEN doc_id % 3 = 1 THEN 'Added' ELSE 'Modified' END ELSE 'Removed' END AS change FROM documents WHERE doc_id % 3 <> 1 OR lang IN ('en', 'de') OR doc_id % 5 = 0")
def changeset_filter(spark, sf_dir):
    change = F.element_at(F.array(*map(F.lit, ("Removed", "Added", "Modified"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").withColumn("change", change)
    return R.changeset_filter(rows, F.when(F.col("lang").isin("en", "de"), F.col("lang")), F.col("doc_id") % 5 == 0).select("doc_id", "change")


@query("reused_lookups", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN n_chars END AS n_chars, doc_id % 4 = 0 AS fresh FROM documents")
def reused_lookups(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return R.reused(d.select("doc_id"), d.filter("doc_id % 4 != 0"), ["doc_id"], "n_chars").select("doc_id", "n_chars", "fresh")


DRAW = "('0x' || substr(md5(user_id || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "bootstrap_interval",
    f"""WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1),
d AS (SELECT user_id, a.v - b.v AS d FROM a JOIN b USING (user_id)), u AS (SELECT k, d, {DRAW} AS u FROM d, range(1000) r(k)),
w AS (SELECT k, d, ({" + ".join(f"(u >= {x!r})::INT" for x in R.POISSON)}) AS w FROM u), m AS (SELECT k, sum(w * d) / sum(w) AS mean FROM w GROUP BY 1 HAVING sum(w) > 0)
SELECT (SELECT count(*) FROM d) AS n, (SELECT round(avg(d), 6) FROM d) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""",
)
def bootstrap_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    arm = lambda kind, name: e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias(name))
    pairs = arm("click", "a").join(arm("view", "b"), "user_id").select("user_id", (F.col("a") - F.col("b")).alias("d"))
    return R.bootstrap(pairs, "d", "user_id", resamples=1_000).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])

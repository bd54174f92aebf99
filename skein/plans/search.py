"""Queries of the search family over ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..sources.tables import files, lines
from .registry import FILES, LINES, query

LICENSE = S.Search("license")
HITS = LINES + ",\nhits AS (SELECT * FROM lines WHERE lower(line) LIKE '%license%')"
TOP = "split_part(path, '/', 1)"
DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def hits(spark, sf_dir):
    return LICENSE.hits(files(spark, sf_dir))


for _key, _sql in (("top", TOP), ("dir", DIR), ("file", "path"), ("wide", DIR)):
    query(f"count_by_{_key}", f"WITH {HITS} SELECT {_sql} AS key, count(*) AS hits, count(DISTINCT path) AS files FROM hits GROUP BY 1")(lambda spark, sf_dir, k=_key: S.counts_by(hits(spark, sf_dir), k))

query("count_only", f"WITH {HITS} SELECT count(*) AS hits, count(DISTINCT path) AS files, count(DISTINCT {DIR}) AS dirs, count(DISTINCT {TOP}) AS tops FROM hits")(lambda spark, sf_dir: S.totals(hits(spark, sf_dir)))


@query("count_page", f"WITH {HITS}, c AS (SELECT {DIR} AS key, count(*) AS hits, count(DISTINCT path) AS files FROM hits GROUP BY 1), t AS (SELECT count(*) AS n FROM c) SELECT key, hits, files, n - least(20, n) AS omitted, CASE WHEN n > 20 THEN 20 END::BIGINT AS next_offset FROM c, t ORDER BY hits DESC, key LIMIT 15 OFFSET 5")
def count_page(spark, sf_dir):
    return S.page(S.counts_by(hits(spark, sf_dir), "dir"), [F.desc("hits"), F.col("key")], offset=5, size=15)


@query("search_lines", f"WITH {HITS} SELECT path, line_no, line FROM hits")
def search_lines(spark, sf_dir):
    return hits(spark, sf_dir)


@query("search_regex", f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '(?i)licen[cs]ed? .*(version|v\\.?) ?[0-9]')")
def search_regex(spark, sf_dir):
    return S.Search("licen[cs]ed? .*(version|v\\.?) ?[0-9]", regex=True, case_sensitive=False).hits(files(spark, sf_dir))


@query("smart_case", f"WITH {LINES} SELECT 'lower' AS variant, count(*) AS n FROM lines WHERE lower(line) LIKE '%licensed%' UNION ALL SELECT 'upper', count(*) FROM lines WHERE line LIKE '%Licensed%' UNION ALL SELECT 'forced', count(*) FROM lines WHERE line LIKE '%licensed%'")
def smart_case(spark, sf_dir):
    f = files(spark, sf_dir)
    parts = [S.Search(q, case_sensitive=c).hits(f).agg(F.count("*").alias("n")).select(F.lit(v).alias("variant"), "n") for v, q, c in (("lower", "licensed", None), ("upper", "Licensed", None), ("forced", "licensed", True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("case_variants", f"WITH {LINES} SELECT path, count(*) AS n, min(line_no) AS first_line FROM lines WHERE lower(line) LIKE '%licensed%' AND line NOT LIKE '%licensed%' GROUP BY 1")
def case_variants(spark, sf_dir):
    return S.case_variants(files(spark, sf_dir), "licensed").groupBy("path").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


NARROW = S.Search("license", path_filter="/en/", glob="src1*", exclude=("src12", "_9.txt"))
NARROW_SQL = "path LIKE '%/en/%' AND regexp_matches(path, '^(.*/)?src1.*$') AND NOT regexp_matches(path, '^(.*/)?src12(/.*)?$') AND NOT regexp_matches(path, '^.*_9\\.txt$')"


@query("path_predicates", f"WITH {HITS} SELECT path, line_no, line FROM hits WHERE {NARROW_SQL}")
def path_predicates(spark, sf_dir):
    return NARROW.hits(files(spark, sf_dir))


@query("outside_filter", f"WITH {HITS} SELECT {TOP} AS key, count(*) AS hits, count(DISTINCT path) AS files FROM hits WHERE NOT ({NARROW_SQL}) GROUP BY 1")
def outside_filter(spark, sf_dir):
    return S.counts_by(NARROW.hits(files(spark, sf_dir), outside=True), "top")


@query("data_probe", f"WITH {HITS}, o AS (SELECT * FROM hits WHERE NOT ({NARROW_SQL})), f AS (SELECT path, count(*) AS hits FROM o GROUP BY 1 ORDER BY hits DESC, path LIMIT 8), r AS (SELECT o.path, o.line_no, f.hits, row_number() OVER (PARTITION BY o.path ORDER BY o.line_no) AS rank FROM o JOIN f USING (path)) SELECT path, line_no, hits, rank, greatest(hits - 5, 0) AS left_out FROM r WHERE rank <= 5")
def data_probe(spark, sf_dir):
    return S.top_groups(NARROW.hits(files(spark, sf_dir), outside=True), 8, 5).select("path", "line_no", "hits", "rank", "left_out")


ROLE_SQL = "CASE WHEN path LIKE '%7.txt' THEN 'test' WHEN path LIKE '%/de/%' THEN 'doc' ELSE 'prod' END"


@query("grouped_roles", f"WITH {HITS}, m AS (SELECT *, {ROLE_SQL} AS role, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rk FROM hits) SELECT role, path, count(*) AS hits, string_agg(CASE WHEN rk <= 6 THEN line_no::VARCHAR END, ',' ORDER BY line_no) AS first_lines FROM m GROUP BY 1, 2")
def grouped_roles(spark, sf_dir):
    p = F.col("path")
    return S.grouped_by_role(hits(spark, sf_dir), F.when(p.endswith("7.txt"), "test").when(p.contains("/de/"), "doc").otherwise("prod"))


@query("broad_rank", f"WITH {HITS}, m AS (SELECT regexp_replace(path, '\\.txt$', CASE WHEN doc_id % 3 = 0 THEN '_test.py' WHEN doc_id % 3 = 1 THEN '.md' ELSE '.py' END) AS path, line_no, CASE WHEN line_no % 2 = 0 THEN 'def license(x):' ELSE line END AS line FROM (SELECT *, regexp_extract(path, 'doc_(\\d+)', 1)::INT AS doc_id FROM hits)) SELECT path, line_no, CASE WHEN path LIKE '%.md' OR path LIKE '%_test.py' THEN 2 WHEN line_no % 2 = 0 THEN 0 ELSE 1 END AS class FROM m ORDER BY class, path, line_no LIMIT 12")
def broad_rank(spark, sf_dir):
    n = F.regexp_extract("path", r"doc_(\d+)", 1).cast("int") % 3
    path = F.concat(F.regexp_replace("path", r"\.txt$", ""), F.when(n == 0, "_test.py").when(n == 1, ".md").otherwise(".py"))
    rows = hits(spark, sf_dir).select(path.alias("path"), "line_no", F.when(F.col("line_no") % 2 == 0, "def license(x):").otherwise(F.col("line")).alias("line"))
    return S.broad_rank(rows).select("path", "line_no", "class")


@query("wide_summary", f"WITH {HITS}, d AS (SELECT 'dir' AS level, {DIR} AS key, count(*) AS hits FROM hits GROUP BY 2 ORDER BY hits DESC, key LIMIT 10), f AS (SELECT 'file' AS level, path AS key, count(*) AS hits FROM hits GROUP BY 2 ORDER BY hits DESC, key LIMIT 15) SELECT * FROM d UNION ALL SELECT * FROM f")
def wide_summary(spark, sf_dir):
    h = hits(spark, sf_dir)
    part = lambda level, key, k: S.counts_by(h, key).orderBy(F.desc("hits"), "key").limit(k).select(F.lit(level).alias("level"), "key", "hits")
    return part("dir", "wide", 10).unionByName(part("file", "file", 15))


@query("search_digest", f"WITH {HITS}, b AS (SELECT path, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, path LIMIT 3), f AS (SELECT path, line_no FROM hits ORDER BY path, line_no LIMIT 3) SELECT (SELECT count(*) FROM hits) AS hits, (SELECT count(DISTINCT path) FROM hits) AS files, (SELECT string_agg(path, ',' ORDER BY n DESC, path) FROM b) AS busiest, (SELECT string_agg(path || ':' || line_no, ',' ORDER BY path, line_no) FROM f) AS first")
def search_digest(spark, sf_dir):
    return S.digest(hits(spark, sf_dir))


@query("suggest_filter", f"WITH {HITS}, f AS (SELECT path, count(*) AS n FROM hits GROUP BY 1), d AS (SELECT {DIR} AS dir, sum(n) AS n FROM f GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total, count(*) AS files FROM f), bf AS (SELECT * FROM f ORDER BY n DESC, path LIMIT 1), bd AS (SELECT * FROM d ORDER BY n DESC, dir LIMIT 1) SELECT CASE WHEN bf.n * 2 >= total OR files = 1 OR bd.dir = '' OR bd.n * 2 < total THEN bf.path ELSE bd.dir || '/' END AS path_filter, total AS hits FROM t, bf, bd")
def suggest_filter(spark, sf_dir):
    return S.suggest_filter(hits(spark, sf_dir))


@query("remaining_by_dir", f"WITH {HITS}, r AS (SELECT * FROM hits ORDER BY path, line_no OFFSET 10) SELECT {DIR} AS dir, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, dir LIMIT 3")
def remaining_by_dir(spark, sf_dir):
    rest = hits(spark, sf_dir).orderBy("path", "line_no").offset(10)
    return rest.groupBy(T.dir_of("path").alias("dir")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(3)


@query("budget_prefix", f"WITH {HITS}, r AS (SELECT path, line_no, sum(length(path) + length(line) + 2) OVER (ORDER BY path, line_no ROWS UNBOUNDED PRECEDING) AS c FROM hits) SELECT path, line_no, ceil(c / 4.0)::BIGINT AS tokens FROM r WHERE ceil(c / 4.0) <= 700")
def budget_prefix(spark, sf_dir):
    return S.budget_prefix(hits(spark, sf_dir), ["path", "line_no"], F.length("path") + F.length("line") + 2, 700).select("path", "line_no", "tokens")


@query("context_windows", f"WITH {LINES}, hits AS (SELECT * FROM lines WHERE lower(line) LIKE '%the%'), g AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER w > 7 THEN 1 ELSE 0 END AS fresh FROM hits WINDOW w AS (PARTITION BY path ORDER BY line_no)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY line_no) AS island FROM g) SELECT path, greatest(min(line_no) - 3, 1) AS first_line, max(line_no) + 3 AS last_line, count(*) AS hits FROM i GROUP BY path, island")
def context_windows(spark, sf_dir):
    return S.context_windows(S.Search("the").hits(files(spark, sf_dir)), 3)


@query("first_per_file", f"WITH {HITS}, r AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rank FROM hits) SELECT path, line_no, rank FROM r WHERE rank <= 2")
def first_per_file(spark, sf_dir):
    return S.top_per_group(hits(spark, sf_dir), ["path"], [F.col("line_no")], 2).select("path", "line_no", "rank")


@query("line_explode", f"WITH {LINES} SELECT path, count(*) AS lines, sum(length(line))::BIGINT AS chars, max(line_no) AS last_line FROM lines GROUP BY 1")
def line_explode(spark, sf_dir):
    return lines(files(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.max("line_no").alias("last_line"))


@query("body_slice", f"WITH {LINES}, p AS (SELECT min(path) AS path FROM lines) SELECT line_no, line FROM lines WHERE path = (SELECT path FROM p) AND line_no BETWEEN 2 AND 5")
def body_slice(spark, sf_dir):
    f = files(spark, sf_dir)
    first = f.filter("text != ''").agg(F.min("path").alias("path"))
    return lines(f.join(F.broadcast(first), "path", "left_semi")).filter(F.col("line_no").between(2, 5)).select("line_no", "line")


@query("clip_lines", f"WITH {HITS}, m AS (SELECT path, line_no, line, length(line) AS n, strpos(lower(line), 'license') AS pos FROM hits), c AS (SELECT *, greatest(1, pos - 30) AS b, least(n, pos + 6 + 30) AS e FROM m) SELECT path, line_no, CASE WHEN n <= 60 THEN line ELSE (CASE WHEN b > 1 THEN '…' ELSE '' END) || substr(line, b, e - b + 1) || (CASE WHEN e < n THEN '…' ELSE '' END) END AS clipped FROM c")
def clip_lines(spark, sf_dir):
    at = F.locate("license", F.lower("line"))
    return hits(spark, sf_dir).select("path", "line_no", T.clip_line("line", at, 7, most=60, around=30).alias("clipped"))


@query("language_totals", f"WITH {LINES}, l AS (SELECT path, count(*) AS n FROM lines GROUP BY 1) SELECT language, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS loc FROM files LEFT JOIN l USING (path) GROUP BY 1")
def language_totals(spark, sf_dir):
    return S.language_totals(files(spark, sf_dir))


@query("top_and_rest", f"WITH {FILES}, c AS (SELECT {TOP} AS key, count(*) AS n FROM files GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS rk FROM c) SELECT CASE WHEN rk <= 8 THEN key ELSE '(other)' END AS key, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def top_and_rest(spark, sf_dir):
    return S.top_and_rest(files(spark, sf_dir).select(T.top_of("path").alias("top")), "top", 8)


@query("path_parts", f"WITH {FILES} SELECT path, {DIR} AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, 'txt' AS ext, {TOP} AS top, 'doc_' || doc_id AS stem FROM files")
def path_parts(spark, sf_dir):
    return files(spark, sf_dir).select("path", T.dir_of("path").alias("dir"), T.base_of("path").alias("base"), T.ext_of("path").alias("ext"), T.top_of("path").alias("top"), T.stem_of("path").alias("stem"))


@query("token_estimates", f"WITH {FILES} SELECT language, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, max(ceil(length(text) / 4.0))::BIGINT AS most FROM files GROUP BY 1")
def token_estimates(spark, sf_dir):
    t = T.token_estimate(F.length("text"))
    return files(spark, sf_dir).groupBy("language").agg(F.sum(t).alias("tokens"), F.max(t).alias("most"))


@query("path_mentions", f"WITH {FILES}, t AS (SELECT 'see doc_17.txt and xdoc_18.txt, src3/en/doc_19.txt2 or (doc_20.txt)' AS task) SELECT path FROM files, t WHERE regexp_matches(task, '(^|[^a-z0-9_-])' || replace(regexp_extract(path, '([^/]*)$', 1), '.', '\\.') || '($|[^a-z0-9_-])')")
def path_mentions(spark, sf_dir):
    task = F.lit("see doc_17.txt and xdoc_18.txt, src3/en/doc_19.txt2 or (doc_20.txt)")
    return files(spark, sf_dir).filter(T.mentions_path(task, T.base_of("path"))).select("path")


@query("hit_union", f"WITH {LINES}, a AS (SELECT path, line_no FROM lines WHERE lower(line) LIKE '%license%'), b AS (SELECT path, line_no FROM lines WHERE lower(line) LIKE '%public%') SELECT path, line_no, 0 AS source FROM a UNION ALL SELECT path, line_no, 1 AS source FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def hit_union(spark, sf_dir):
    f = files(spark, sf_dir)
    a, b = (S.Search(q).hits(f).select("path", "line_no") for q in ("license", "public"))
    return a.withColumn("source", F.lit(0)).unionByName(b.join(a, ["path", "line_no"], "left_anti").withColumn("source", F.lit(1)))


@query("text_only_files", f"WITH {FILES} SELECT path FROM files WHERE language <> 'en'")
def text_only_files(spark, sf_dir):
    f = files(spark, sf_dir)
    return S.text_only(f, f.filter("language = 'en'")).select("path")


@query("whole_words", f"WITH {LINES} SELECT path, sum(len(regexp_extract_all(lower(line), '(^|[^a-zà-ÿ0-9_])license($|[^a-zà-ÿ0-9_])')))::BIGINT AS n FROM lines GROUP BY 1 HAVING n > 0")
def whole_words(spark, sf_dir):
    n = F.regexp_count("line", F.lit("(?i)" + T.word_regex("license")))
    return S.Search("license").hits(files(spark, sf_dir)).groupBy("path").agg(F.sum(n).alias("n")).filter("n > 0")


@query("early_stop", f"WITH {FILES}, c AS (SELECT count(*) AS n FROM (SELECT 1 FROM files LIMIT 501)) SELECT least(n, 500) AS files, n > 500 AS truncated FROM c")
def early_stop(spark, sf_dir):
    n = files(spark, sf_dir).select("path").limit(501).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(500)).alias("files"), (F.col("n") > 500).alias("truncated"))


@query("reference_summary", f"WITH {HITS} SELECT count(*) AS hits, count(DISTINCT path) AS files, count(*) FILTER (path LIKE '%7.txt') AS test_hits, count(*) FILTER (line LIKE 'Licensed%') AS declarations FROM hits")
def reference_summary(spark, sf_dir):
    return hits(spark, sf_dir).agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"), F.count_if(F.col("path").endswith("7.txt")).alias("test_hits"), F.count_if(F.col("line").startswith("Licensed")).alias("declarations"))


@query("changed_note", f"WITH {FILES}, s AS (SELECT doc_id, language, lag(language) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY doc_id) AS before FROM files) SELECT doc_id, language FROM s WHERE before IS NULL OR before <> language")
def changed_note(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("before", F.lag("language").over(Window.partitionBy(T.top_of("path")).orderBy("doc_id")))
    return f.filter("before IS NULL OR before != language").select("doc_id", "language")

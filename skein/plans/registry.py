"""The register of queries: a name, a function of (spark, sf_dir), and the same query in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import measured_joins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            measured_joins(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return f

    return register


#: SQL of the bound tables, put before an oracle's own text.
FILES = "files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS language, text FROM documents)"
LINES = (
    FILES
    + r""",
split AS (SELECT path, regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS l FROM files WHERE text <> ''),
lines AS (SELECT path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM split)"""
)
TRADE = """trade AS (
  SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey
  WHERE c.c_nationkey <> s.s_nationkey GROUP BY 1, 2)"""
EVENTS = "ev AS (SELECT *, epoch_us(ts) AS us FROM events)"
INTERVALS = """ie AS (SELECT user_id AS file_id, epoch_us(ts) // 1000000 AS line FROM events),
runs AS (SELECT file_id, line, sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line) AS run
  FROM (SELECT *, line - lag(line) OVER (PARTITION BY file_id ORDER BY line) AS gap FROM ie)),
intervals AS (
  SELECT file_id, 'w' || (line // 604800) AS name, 'Class' AS kind, min(line) AS start_line, max(line) AS end_line FROM ie GROUP BY 1, 2
  UNION ALL SELECT file_id, 'd' || (line // 86400), 'Module', min(line), max(line) FROM ie GROUP BY 1, 2
  UNION ALL SELECT file_id, 'r' || run, 'Method', min(line), max(line) FROM runs GROUP BY 1, 2)"""

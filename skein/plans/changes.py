"""Queries over ``events`` as a log of changes and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..sources.tables import events, table
from .registry import EVENTS, query

MIN = 60_000_000
KIND = "CASE event_type WHEN 'signup' THEN 'Added' WHEN 'purchase' THEN 'Modified' WHEN 'error' THEN 'Removed' END"


@query("snapshot_diff", "WITH a AS (SELECT user_id, count(*) AS n, max(value) AS v FROM events WHERE event_id % 3 = 0 AND user_id % 5 <> 1 GROUP BY 1), b AS (SELECT user_id, count(*) AS n, max(value) AS v FROM events WHERE event_id % 3 <> (user_id % 2) AND user_id % 7 <> 2 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'Added' WHEN b.user_id IS NULL THEN 'Removed' ELSE 'Modified' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL OR (a.n, a.v) <> (b.n, b.v)")
def snapshot_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stamp = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    return C.snapshot_diff(stamp(e.filter("event_id % 3 = 0 AND user_id % 5 != 1")), stamp(e.filter("event_id % 3 != user_id % 2 AND user_id % 7 != 2")), "user_id", ["n", "v"])


@query("change_coalesce", f"WITH {EVENTS}, c AS (SELECT user_id, us // 86400000000 AS day, us, event_id, {KIND} AS kind FROM ev), k AS (SELECT user_id || ':' || day AS path, kind, (us, event_id) AS seq FROM c WHERE kind IS NOT NULL), g AS (SELECT path, arg_max(kind, seq) AS last, arg_min(kind, seq) AS first, bool_or(kind = 'Removed') AS removed FROM k GROUP BY 1) SELECT path, CASE WHEN last = 'Removed' THEN 'Removed' WHEN removed THEN 'Modified' ELSE first END AS change FROM g")
def change_coalesce(spark, sf_dir):
    e = events(spark, sf_dir)
    path = F.concat_ws(":", F.col("user_id").cast("string"), F.expr("us div 86400000000").cast("string"))
    rows = e.select(path.alias("path"), "us", "event_id", F.expr(KIND).alias("kind")).filter("kind IS NOT NULL")
    return C.coalesce_changes(rows, "path", "kind", ["us", "event_id"])


GAP = f"WITH {EVENTS}, g AS (SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM ev)"


@query("debounce_session", f"{GAP}, s AS (SELECT *, sum(CASE WHEN gap <= {120 * MIN} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us) AS run FROM g) SELECT user_id, min(us) AS started, max(us) AS ended, count(*) AS n FROM s GROUP BY user_id, run")
def debounce_session(spark, sf_dir):
    return C.quiet_periods(events(spark, sf_dir).select("user_id", "us"), "user_id", "us", 120 * MIN)


DEBOUNCED = """
o AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM ev),
f AS (
  SELECT user_id, rn, us, us AS started FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.rn, o.us, CASE WHEN o.us - f.us <= {quiet} AND o.us - f.started < {longest} THEN f.started ELSE o.us END FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)"""


@query("debounce_capped", f"WITH RECURSIVE {EVENTS}, {DEBOUNCED.format(quiet=600 * MIN, longest=1800 * MIN)} SELECT user_id, started, max(us) AS ended, count(*) AS n FROM f GROUP BY 1, 2")
def debounce_capped(spark, sf_dir):
    return C.debounced(events(spark, sf_dir).select("user_id", "us"), "user_id", "us", 600 * MIN, 1800 * MIN)


@query("throttle", f"WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM ev), f AS (SELECT user_id, rn, us, us AS applied FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, o.us, CASE WHEN o.us - f.applied >= {900 * MIN} THEN o.us ELSE f.applied END FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1) SELECT DISTINCT user_id, applied FROM f")
def throttle(spark, sf_dir):
    return C.throttled(events(spark, sf_dir).select("user_id", "us"), "user_id", "us", 900 * MIN)


@query("barrier", "WITH s AS (SELECT user_id, min(value) AS age, count(DISTINCT event_type) FILTER (value > 60) AS n, max(value) > 198 AS bad FROM events GROUP BY 1) SELECT user_id, CASE WHEN bad THEN 'Degrade' WHEN age <= 1 AND n = 0 THEN 'Fresh' WHEN n <= 3 THEN 'Repair' ELSE 'Degrade' END AS decision FROM s")
def barrier(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("age"), F.collect_list(F.when(F.col("value") > 60, F.col("event_type"))).alias("suspects"), (F.max("value") > 198).alias("bad"))
    return s.select("user_id", C.barrier(F.col("age"), F.col("bad"), F.col("suspects"), window_s=1, inline=3).alias("decision"))


@query("unsettled", "WITH s AS (SELECT event_id, value - 20 AS age FROM events) SELECT event_id, (age >= 0 AND age < 2) OR (age < 0 AND age >= -86400) AS unsettled FROM s")
def unsettled(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.unsettled(F.col("value") - 20).alias("unsettled"))


@query(
    "loop_repeat",
    f"""WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM ev),
f AS (SELECT user_id, rn, us, 0 AS prior, false AS blocked, [us] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT user_id, rn, us, len(k) AS prior, len(k) >= 3 AS blocked, CASE WHEN len(k) >= 3 THEN k ELSE list_append(k, us) END AS kept
  FROM (SELECT o.user_id, o.rn, o.us, list_filter(f.kept, lambda x: o.us - x < {1440 * MIN}) AS k FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1))
SELECT user_id, us, prior, blocked FROM f""",
)
def loop_repeat(spark, sf_dir):
    return C.repeat_guard(events(spark, sf_dir).select("user_id", "us"), ["user_id"], "us", most=3, window_us=1440 * MIN)


@query("loop_rate", f"WITH {EVENTS} SELECT event_id AS id, us, count(*) OVER (ORDER BY us RANGE BETWEEN {60 * MIN - 1} PRECEDING AND 1 PRECEDING) AS prior, prior >= 12 AS warned FROM ev")
def loop_rate(spark, sf_dir):
    return C.rate_guard(events(spark, sf_dir), "us", "event_id", most=12, window_us=60 * MIN)


@query("burst_counts", f"WITH {EVENTS}, g AS (SELECT user_id, event_type, us, CASE WHEN us - lag(us) OVER w <= {1440 * MIN} THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY us) AS run FROM g) SELECT user_id, event_type, us, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY us) AS n FROM r")
def burst_counts(spark, sf_dir):
    return C.burst_counts(events(spark, sf_dir).select("user_id", "event_type", "us"), ["user_id", "event_type"], "us", 1440 * MIN)


PERIODS = {"view": 1440 * MIN, "click": 2880 * MIN}
LIMITS = {"view": 3, "click": 4}


@query(
    "burst_guard",
    f"""WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, us, event_id AS id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM ev),
s AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS us, NULL::BIGINT AS id, NULL::VARCHAR AS kind, NULL::VARCHAR AS decision, NULL::BIGINT AS va, 0 AS vn, NULL::BIGINT AS ca, 0 AS cn, NULL::BIGINT AS denied FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL
  SELECT user_id, rn, us, id, kind, d AS decision,
    CASE WHEN d IN ('reset', 'deny') THEN NULL WHEN d = 'allow' AND kind = 'view' THEN us ELSE va END, CASE WHEN d IN ('reset', 'deny') THEN 0 WHEN d = 'allow' AND kind = 'view' THEN n ELSE vn END,
    CASE WHEN d IN ('reset', 'deny') THEN NULL WHEN d = 'allow' AND kind = 'click' THEN us ELSE ca END, CASE WHEN d IN ('reset', 'deny') THEN 0 WHEN d = 'allow' AND kind = 'click' THEN n ELSE cn END,
    CASE WHEN d = 'reset' THEN NULL WHEN d = 'deny' THEN us ELSE denied END
  FROM (SELECT *, CASE WHEN kind = 'signup' THEN 'reset' WHEN coalesce(us - denied < {600 * MIN}, false) THEN 'silenced' WHEN kind = 'view' AND n >= 3 OR kind = 'click' AND n >= 4 THEN 'deny' WHEN kind IN ('view', 'click') THEN 'allow' ELSE 'neutral' END AS d
    FROM (SELECT o.*, s.va, s.vn, s.ca, s.cn, s.denied, CASE WHEN o.kind = 'view' AND coalesce(o.us - s.va <= {1440 * MIN}, false) THEN s.vn + 1 WHEN o.kind = 'click' AND coalesce(o.us - s.ca <= {2880 * MIN}, false) THEN s.cn + 1 ELSE 1 END AS n FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1)))
SELECT user_id, us, id, kind, decision FROM s WHERE rn > 0""",
)
def burst_guard(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "us", F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return C.burst_guard(e, "user_id", "us", "kind", PERIODS, LIMITS, "signup", silence_us=600 * MIN)


@query("session_dedup", f"WITH {EVENTS} SELECT event_id, user_id % 11 = 0 OR row_number() OVER (PARTITION BY CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id END, event_type ORDER BY us, event_id) = 1 AS first FROM ev")
def session_dedup(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("agent", F.when(F.col("user_id") % 11 != 0, F.col("user_id")))
    return C.send_once(e, "agent", ["event_type"], ["us", "event_id"]).select("event_id", "first")


@query("stale_sessions", f"WITH {EVENTS}, m AS (SELECT max(us) - {360 * MIN} AS cut FROM ev) SELECT user_id, max(us) AS newest FROM ev, m GROUP BY user_id, cut HAVING max(us) < cut")
def stale_sessions(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "us")
    cut = e.agg((F.max("us") - 360 * MIN).alias("cut"))
    return e.groupBy("user_id").agg(F.max("us").alias("newest")).crossJoin(F.broadcast(cut)).filter("newest < cut").select("user_id", "newest")


@query("retries", f"WITH {EVENTS}, o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn, value < 25 AS ok FROM ev), f AS (SELECT user_id, min(rn) FILTER (ok) AS ok, max(rn) AS n FROM o GROUP BY 1) SELECT user_id, least(coalesce(ok, n), 4) AS tries, coalesce(ok, 5) > 4 AS given_up FROM f")
def retries(spark, sf_dir):
    return C.retries(events(spark, sf_dir).select("user_id", "us", "value"), "user_id", "us", F.col("value") >= 25)


@query("idle_gaps", f"{GAP} SELECT user_id, count(*) AS wakes, max(gap) AS longest FROM g WHERE gap > {1440 * MIN} GROUP BY 1")
def idle_gaps(spark, sf_dir):
    p = C.quiet_periods(events(spark, sf_dir).select("user_id", "us"), "user_id", "us", 1440 * MIN)
    from pyspark.sql import Window

    gaps = p.withColumn("gap", F.col("started") - F.lag("ended").over(Window.partitionBy("user_id").orderBy("started"))).filter("gap IS NOT NULL")
    return gaps.groupBy("user_id").agg(F.count("*").alias("wakes"), F.max("gap").alias("longest"))


@query("paired_difference", "WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) SELECT count(*) AS pairs, round(avg(a.v - b.v), 6) AS mean FROM a JOIN b USING (user_id)")
def paired_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    arm = lambda kind, name: e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias(name))
    return arm("click", "a").join(arm("view", "b"), "user_id").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("mean"))


@query("recall", "SELECT o_orderpriority AS language, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS found, round(count(*) FILTER (o_orderstatus <> 'O') / count(*), 9) AS recall FROM orders GROUP BY 1")
def recall(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("hit", F.col("o_orderstatus") != "O")
    return o.groupBy(F.col("o_orderpriority").alias("language")).agg(F.count("*").alias("n"), F.count_if("hit").alias("found"), F.round(F.count_if("hit") / F.count("*"), 9).alias("recall"))

"""Change tracking over batches of rows: snapshot differences, coalescing, quiet periods, freshness, guards.

Folds that a later row can undo (a block that is not recorded, a denial that resets) are streams: rows are dealt by key,
sorted, and folded in Arrow batches with the state of one key at a time, so that a key's history may be of any length.
Everything else is windows and joins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..session import bounded_batches

# Fixed values.
REPEAT_MAX, RATE_MAX, GUARD_WINDOW_US = 3, 300, 600_000_000
FRESH_WINDOW_S, MAX_INLINE = 5, 64
UNSETTLED_S, FUTURE_S = 2, 24 * 3600
IDLE_S = 1800


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """key, change: Added, Modified or Removed; equal stamps give no row."""
    a = before.select(F.col(key), F.struct(*stamp).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(F.col(key), F.struct(*stamp).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "Added").when(F.col("_in_b").isNull(), "Removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "Modified")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def coalesce_changes(changes: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """One change a key.  A removal stays if it is last; after one, anything else is a modification; otherwise the first
    kind stays."""
    at = F.struct(*order)
    rows = changes.groupBy(key).agg(F.max_by(kind, at).alias("last"), F.min_by(kind, at).alias("first"), F.max(F.col(kind) == "Removed").alias("removed"))
    return rows.select(key, F.when(F.col("last") == "Removed", "Removed").when(F.col("removed"), "Modified").otherwise(F.col("first")).alias("change"))


def quiet_periods(events: DataFrame, key: str, us: str, gap_us: int) -> DataFrame:
    """Runs of events no further apart than the gap: key, started, ended, n."""
    w = Window.partitionBy(key).orderBy(us)
    fresh = F.coalesce(F.col(us) - F.lag(us).over(w) > gap_us, F.lit(True))
    runs = events.withColumn("_run", F.sum(fresh.cast("int")).over(w))
    return runs.groupBy(key, "_run").agg(F.min(us).alias("started"), F.max(us).alias("ended"), F.count("*").alias("n")).drop("_run")


def folded(rows: DataFrame, key: list[str], order: list[str], start: Callable, schema: list[tuple[str, str]]) -> DataFrame:
    """key columns and what ``start()`` makes of each key's rows in order.  ``start`` gives two functions: ``step(row)``, a
    list of results for the columns after the key, and ``end()``, the results that are left.  ``schema``: their columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    rest = [c for c in rows.columns if c not in key]
    arrow = [kinds[t] for _, t in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, end = None, None, None
        key_types = None
        for batch in batches:
            key_types = [batch.schema.field(c).type for c in key]
            out = []
            for k, row in zip(zip(*(batch.column(c).to_pylist() for c in key), strict=True), zip(*(batch.column(c).to_pylist() for c in rest), strict=True), strict=True):
                if step is None or k != at:
                    out += [(*at, *r) for r in end()] if end else []
                    at, (step, end) = k, start()
                out += [(*k, *r) for r in step(*row)]
            if out:
                yield batch_of(out, key_types)
        if end and (left := [(*at, *r) for r in end()]):
            yield batch_of(left, key_types)

    def batch_of(out: list[tuple], key_types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*key_types, *arrow], strict=True)], names=[*key, *(n for n, _ in schema)])

    bounded_batches(rows.sparkSession)
    types = {"long": LongType(), "int": IntegerType(), "boolean": BooleanType(), "string": StringType()}
    result = StructType([*(StructField(c, rows.schema[c].dataType) for c in key), *(StructField(n, types[t]) for n, t in schema)])
    return rows.select(*key, *rest).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, result)


def debounced(events: DataFrame, key: str, us: str, quiet_us: int, longest_us: int) -> DataFrame:
    """Batches that close after ``quiet_us`` without an event, or ``longest_us`` after their first: key, started, n."""

    def start():
        now: list[int] = []  # started, ended, n of the open batch

        def step(t: int) -> list:
            if now and t - now[1] <= quiet_us and t - now[0] < longest_us:
                now[1:] = t, now[2] + 1
                return []
            done, now[:] = [tuple(now)] if now else [], (t, t, 1)
            return done

        return step, lambda: [tuple(now)] if now else []

    return folded(events.select(key, F.col(us).cast("bigint").alias(us)), [key], [us], start, [("started", "long"), ("ended", "long"), ("n", "long")])


def throttled(events: DataFrame, key: str, us: str, gap_us: int) -> DataFrame:
    """Moments at which a key is applied: the first event, then the first at least ``gap_us`` after the last moment."""

    def start():
        last: list[int] = []

        def step(t: int) -> list:
            if last and t - last[0] < gap_us:
                return []
            last[:] = [t]
            return [(t,)]

        return step, lambda: []

    return folded(events.select(key, F.col(us).cast("bigint").alias(us)), [key], [us], start, [("applied", "long")])


def barrier(age_s: Column, distrusted: Column, suspects: Column, window_s: int = FRESH_WINDOW_S, inline: int = MAX_INLINE) -> Column:
    """Fresh, Repair or Degrade, of an array of suspect paths; repeats count once."""
    n = F.size(F.array_distinct(suspects))
    return F.when(distrusted, "Degrade").when((age_s <= window_s) & (n == 0), "Fresh").when(n <= inline, "Repair").otherwise("Degrade")


#: How long an answer waits for a verification, and how long a watcher goes without a whole scan.
WAIT_S, SAFETY_S, DISTRUST_S = 2, 1800, 60


def barrier_answer(decision: Column, verified_after_s: Column) -> Column:
    """fresh, repaired or stale: what a query is told behind the barrier.  A repair is done in line; where none of the
    suspects could be checked, the answer waits for a verification, for WAIT_S at most."""
    return F.when(decision == "Fresh", "fresh").when(decision == "Repair", "repaired").when(F.coalesce(verified_after_s <= WAIT_S, F.lit(False)), "fresh").otherwise("stale")


def safety_wait(configured_s: Column, distrusted: Column) -> Column:
    """Seconds until the next whole scan: DISTRUST_S at most while the log is distrusted; 0 switches scans off otherwise."""
    return F.when(~distrusted, configured_s).when(configured_s == 0, DISTRUST_S).otherwise(F.least(configured_s, F.lit(DISTRUST_S)))


def verified(suspects: DataFrame, found: DataFrame, started: int, finished: int) -> DataFrame:
    """path, at: the suspects that stay after a verification that ran from ``started`` to ``finished``, the new watermark.
    Paths noted while it ran stay, and what it found and was not applied yet is suspect too: both right after it."""
    late = suspects.filter(F.col("at") > started).select("path")
    return late.union(found.select("path")).distinct().withColumn("at", F.lit(finished + 1).cast("bigint"))


def unsettled(age_s: Column) -> Column:
    """A modification time too close to now, or a little ahead of it, does not prove that nothing changed."""
    return ((age_s >= 0) & (age_s < UNSETTLED_S)) | ((age_s < 0) & (age_s >= -FUTURE_S))


def repeat_guard(calls: DataFrame, key: list[str], us: str, most: int = REPEAT_MAX, window_us: int = GUARD_WINDOW_US) -> DataFrame:
    """key, us, prior, blocked for each call.  A call with ``most`` recorded runs in the half-open window is blocked, and
    a blocked call is not recorded."""

    def start():
        kept: list[int] = []  # at most ``most`` recorded runs

        def step(t: int) -> list:
            del kept[: bisect_right(kept, t - window_us)]
            prior = len(kept)
            if prior < most:
                kept.append(t)
            return [(t, prior, prior >= most)]

        return step, lambda: []

    return folded(calls.select(*key, F.col(us).cast("bigint").alias("_us")), key, ["_us"], start, [("us", "long"), ("prior", "int"), ("blocked", "boolean")])


def rate_guard(calls: DataFrame, us: str, id_: str, most: int = RATE_MAX, window_us: int = GUARD_WINDOW_US) -> DataFrame:
    """id, prior (calls before it in the half-open window, over all keys), warned.

    Time is cut into buckets of the window's length; each call stands in its own bucket and, as a past one, in the next,
    so that no bucket needs more than its neighbour and none is a global window.  Sorted calls are counted by where their
    window's ends fall among them, so a bucket of many calls costs no more a call than one of few.
    """
    bucket = F.expr(f"{us} div {window_us}")
    rows = calls.select(F.col(id_).alias("id"), F.col(us).cast("bigint").alias("us"), bucket.alias("b"))
    both = rows.withColumn("own", F.lit(True)).unionByName(rows.withColumn("b", F.col("b") + 1).withColumn("own", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty(0, np.int64)  # the bucket, and its times that later calls may count
        for batch in batches:
            times, buckets = (batch.column(c).to_numpy() for c in ("us", "b"))
            prior = np.zeros(len(times), np.int64)
            ends = [*(np.flatnonzero(np.diff(buckets)) + 1), len(times)] if len(times) else []
            start = 0
            for end in ends:
                if buckets[start] != at:
                    at, held = buckets[start], held[:0]
                own = times[start:end]
                known = np.concatenate([held[np.searchsorted(held, own[0] - window_us, "right") :], own])
                prior[start:end] = np.searchsorted(known, own, "left") - np.searchsorted(known, own - window_us, "right")
                held, start = known, end
            kept = batch.column("own")
            out = [batch.column("id").filter(kept), batch.column("us").filter(kept), pa.array(prior).filter(kept)]
            yield pa.RecordBatch.from_arrays(out, names=["id", "us", "prior"])

    bounded_batches(calls.sparkSession)
    shape = StructType([rows.schema["id"], rows.schema["us"], StructField("prior", LongType())])
    swept = both.filter("us IS NOT NULL").repartition("b").sortWithinPartitions("b", "us").mapInArrow(run, shape)
    nulls = rows.filter("us IS NULL").select("id", "us")  # they are peers of each other only
    found = swept.unionByName(nulls.crossJoin(nulls.agg(F.count("*").alias("prior"))))
    return found.select("id", "us", "prior", (F.col("prior") >= most).alias("warned"))


def burst_counts(calls: DataFrame, key: list[str], us: str, period_us: int) -> DataFrame:
    """key, us, n: how many calls in a row came no further apart than the period (inclusive)."""
    w = Window.partitionBy(*key).orderBy(us)
    fresh = F.coalesce(F.col(us) - F.lag(us).over(w) > period_us, F.lit(True))
    runs = calls.withColumn("_run", F.sum(fresh.cast("int")).over(w))
    return runs.withColumn("n", F.row_number().over(Window.partitionBy(*key, "_run").orderBy(us))).select(*key, us, "n")


def burst_guard(calls: DataFrame, session: str, us: str, kind: str, periods: dict[str, int], limits: dict[str, int], reset_kind: str, silence_us: int = 15_000_000) -> DataFrame:
    """session, us, kind, decision for each call: reset, silenced, deny, allow or neutral.

    A call of ``reset_kind`` sets all counters back and ends a silence.  Within the silence after a denial nothing counts.
    A kind in ``periods`` counts calls no further apart than its period; at its limit the call is denied, all counters go
    back and a silence begins.  Other kinds are neutral.
    """

    def start():
        counters: dict[str, tuple[int, int]] = {}
        denied: list[int] = []

        def step(t: int, id_: int, what: str) -> list:
            if what == reset_kind:
                counters.clear()
                denied.clear()
                return [(t, id_, what, "reset")]
            if denied and t - denied[0] < silence_us:
                return [(t, id_, what, "silenced")]
            if what not in periods:
                return [(t, id_, what, "neutral")]
            at, n = counters.get(what, (t - periods[what] - 1, 0))
            n = n + 1 if t - at <= periods[what] else 1
            if n >= limits[what]:
                counters.clear()
                denied[:] = [t]
                return [(t, id_, what, "deny")]
            counters[what] = t, n
            return [(t, id_, what, "allow")]

        return step, lambda: []

    rows = calls.select(session, F.col(us).cast("bigint").alias("_us"), F.col("id").cast("bigint").alias("_id"), F.col(kind).alias("_kind"))
    return folded(rows, [session], ["_us", "_id", "_kind"], start, [("us", "long"), ("id", "long"), ("kind", "string"), ("decision", "string")])


def send_once(rows: DataFrame, agent: str, key: list[str], order: list[str]) -> DataFrame:
    """``first``: whether the agent has not had the key before; an unknown agent always gets the whole."""
    n = F.row_number().over(Window.partitionBy(agent, *key).orderBy(*order))
    return rows.withColumn("first", F.col(agent).isNull() | (n == 1))


def stale(rows: DataFrame, key: str, us: str, cutoff_us: int) -> DataFrame:
    """Keys whose newest row is older than the cut-off."""
    return rows.groupBy(key).agg(F.max(us).alias("newest")).filter(F.col("newest") < cutoff_us)


def retries(attempts: DataFrame, key: str, us: str, failed: Column, most: int = 3) -> DataFrame:
    """key, tries, given_up: a key is tried again after failures until one succeeds, ``most`` times at most."""
    w = Window.partitionBy(key).orderBy(us)
    rows = attempts.withColumn("_n", F.row_number().over(w)).withColumn("_ok", ~failed)
    first = rows.groupBy(key).agg(F.min(F.when(F.col("_ok"), F.col("_n"))).alias("ok"), F.max("_n").alias("n"))
    tries = F.least(F.coalesce("ok", "n"), F.lit(most + 1))
    return first.select(key, tries.alias("tries"), (F.coalesce("ok", F.lit(most + 2)) > most + 1).alias("given_up"))

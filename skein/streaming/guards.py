"""Structured Streaming forms of the change and guard operators.

State is held per key by the engine's state store; late and idle state goes by time-outs.  Sources and sinks are the
caller's: each function takes and returns a streaming (or static) DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import GUARD_WINDOW_US, REPEAT_MAX


def debounce(events: DataFrame, key: str, ts: str, quiet: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """Quiet-period batches as session windows: key, started, ended, n."""
    w = F.session_window(ts, quiet)
    out = events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def send_once(events: DataFrame, keys: list[str], ts: str, horizon: str = "1 hour") -> DataFrame:
    """The first row of each key within the horizon."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def _merged(before: str | None, kind: str) -> str:
    if before is None or kind == "Removed":
        return kind
    return "Modified" if before == "Removed" else before


def coalesce_changes(changes: DataFrame, key: str = "path", kind: str = "kind", seq: str = "seq") -> DataFrame:
    """path, change, seq: the coalesced change of each path after every batch that touches it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values(seq)
        for change, n in zip(rows[kind], rows[seq], strict=True):
            if n > last:
                now, last = _merged(now, change), int(n)
        state.update((now, last))
        yield pd.DataFrame({key: [k[0]], "change": [now], seq: [last]})

    return changes.groupBy(key).applyInPandasWithState(step, f"{key} string, change string, {seq} long", "change string, seq long", "update", GroupStateTimeout.NoTimeout)


def repeat_guard(calls: DataFrame, key: str, us: str, most: int = REPEAT_MAX, window_us: int = GUARD_WINDOW_US, idle_ms: int | None = None) -> DataFrame:
    """key, us, prior, blocked of each call; only runs that are not blocked are recorded.  With ``idle_ms``, keys are
    forgotten after that time without a call; such a query always has a next batch, so it suits running triggers only."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, out = list(state.get[0]) if state.exists else [], []
        for t in sorted(pd.concat(list(batches))[us]):
            kept = [x for x in kept if t - x < window_us]
            out.append((k[0], int(t), len(kept), len(kept) >= most))
            if len(kept) < most:
                kept.append(int(t))
        state.update((kept,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, us, "prior", "blocked"])

    return calls.groupBy(key).applyInPandasWithState(step, f"{key} long, {us} long, prior int, blocked boolean", "kept array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def upsert_batches(target: str, key: list[str]):
    """A ``foreachBatch`` function that writes each batch under its id and a folder of the rows that now hold.

    A batch id that comes again overwrites its own folder only, so a batch that is repeated after a failure changes
    nothing.  ``current`` reads the newest row of each key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def current(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of the newest batch for each key."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return newest.select(*key, "r.*")

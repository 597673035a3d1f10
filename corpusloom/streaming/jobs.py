"""Structured Streaming forms of the queue and usage operators.

Each function takes a streaming (or batch) DataFrame and returns a DataFrame; sinks and
triggers are the caller's. State lives in Spark's state store, so a lost executor resumes
from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage_windows(events: DataFrame, late: str = "1 hour", size: str = "1 hour", ceiling: int = 5) -> DataFrame:
    """Calls and tokens by window and type, with ``over`` where calls pass the ceiling."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    per = w.agg(F.count("*").alias("calls"), F.sum("value").alias("tokens"))
    return per.select(F.col("w.start").alias("start"), "event_type", "calls", "tokens", (F.col("calls") > ceiling).alias("over"))


def sliding_usage(events: DataFrame, late: str = "1 hour", size: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """Calls by sliding window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"))
    return w.agg(F.count("*").alias("calls")).select(F.col("w.start").alias("start"), "calls")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: runs of events with less than ``gap`` between them."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def enqueue_once(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests (queue, job_key, ts) of which no equal one came within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["queue", "job_key"])


def job_states(changes: DataFrame, most: int = 3) -> DataFrame:
    """State of each job after each micro-batch of changes (job_id, ts, kind).

    ``kind`` is enqueue, claim, finish, fail or reap; a job that fails or loses its lease for
    the ``most``-th time is dead.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        now, attempts = state.get if state.exists else ("new", 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for kind in rows["kind"]:
            if kind == "enqueue" and now in ("new", "done"):
                now, attempts = "queued", 0
            elif kind == "claim" and now == "queued":
                now, attempts = "running", attempts + 1
            elif kind == "finish" and now == "running":
                now = "done"
            elif kind in ("fail", "reap") and now == "running":
                now = "dead" if attempts >= most else "queued"
        state.update((now, attempts))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "attempts": [attempts]})

    return changes.groupBy("job_id").applyInPandasWithState(
        step, "job_id bigint, state string, attempts int", "state string, attempts int", "update", GroupStateTimeout.NoTimeout
    )


def token_bucket(calls: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """Whether each call (source, ts, cost) finds enough tokens in its source's bucket."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        level, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        allowed = []
        for ts, cost in zip(rows["ts"], rows["cost"], strict=True):
            at = ts.timestamp()
            level = min(capacity, level + (0 if last is None else max(0.0, at - last) * per_second))
            last = at
            allowed.append(bool(level >= cost))
            level -= cost if allowed[-1] else 0
        state.update((float(level), float(last)))
        yield pd.DataFrame({"source": key[0], "ts": rows["ts"], "allowed": allowed})

    return calls.groupBy("source").applyInPandasWithState(
        step, "source string, ts timestamp, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout
    )


def circuit_breaker(calls: DataFrame, failures: int = 3, wait_s: float = 60.0) -> DataFrame:
    """State of each source's breaker at each call (source, ts, ok): closed, open or half_open.

    It opens after ``failures`` failed calls in a row and lets one call probe after the wait.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        failed, opened = state.get if state.exists else (0, -1.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        seen = []
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            at = ts.timestamp()
            now = "closed" if opened < 0 else "half_open" if at - opened >= wait_s else "open"
            seen.append(now)
            if now == "open":
                continue
            if ok:
                failed, opened = 0, -1.0
            else:
                failed += 1
                if now == "half_open" or failed >= failures:
                    opened = at
        state.update((int(failed), float(opened)))
        yield pd.DataFrame({"source": key[0], "ts": rows["ts"], "state": seen})

    return calls.groupBy("source").applyInPandasWithState(
        step, "source string, ts timestamp, state string", "failed int, opened double", "append", GroupStateTimeout.NoTimeout
    )

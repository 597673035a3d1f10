"""Outage windows of sources: opened by a failed call, closed by a good one or by time.

A window opens at the first failure after a good call. A good call within ``window`` seconds
closes it as recovered; else it is spent at its end, and the source counts as down until a good
call, which emits nothing. The batch form numbers runs of failures; the stream form keeps a
value a source and a timer at the window's end, so a source that falls silent is closed by the
watermark alone, and one more timer later forgets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "source string, opened timestamp, closed timestamp, failures bigint, status string"


def outage_windows(calls: DataFrame, window_s: int) -> DataFrame:
    """Windows of calls (source, ts, ok): source, opened, closed, failures, status.

    A window whose end lies after the last call of all is open, with no end.
    """
    order = Window.partitionBy("source").orderBy("ts", F.desc("ok"))
    rows = calls.withColumn("run", F.sum(F.col("ok").cast("int")).over(order))
    ends = rows.where("ok").select("source", (F.col("run") - 1).alias("run"), F.col("ts").alias("good"))
    first = F.min("ts").over(Window.partitionBy("source", "run"))
    failed = rows.where("not ok").withColumn("opened", first)
    end = (F.col("opened").cast("double") + window_s).cast("timestamp")
    per = failed.where(F.col("ts") < end).groupBy("source", "run", "opened").agg(F.count("*").alias("failures"))
    latest = calls.agg(F.max("ts").alias("latest"))
    done = per.join(ends, ["source", "run"], "left").crossJoin(F.broadcast(latest)).withColumn("end", end)
    recovered, spent = F.col("good") < F.col("end"), F.col("latest") >= F.col("end")
    status = F.when(F.coalesce(recovered, F.lit(False)), "recovered").when(spent, "spent").otherwise("open")
    closed = F.when(status == "recovered", F.col("good")).when(status == "spent", F.col("end"))
    return done.select("source", "opened", closed.alias("closed"), "failures", status.alias("status"))


class Outages(StatefulProcessor):
    """One value a source: opening, failures, whether spent; a timer ends a window."""

    def __init__(self, window_s: int, forget_s: int):
        self.window_ms, self.forget_ms = window_s * 1000, forget_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.outage = handle.getValueState("outage", "since bigint, failures bigint, spent boolean")

    def row(self, source: str, since: int, closed: int, failures: int, status: str) -> dict[str, Any]:
        return {"source": source, "opened": pd.Timestamp(since, unit="ms"), "closed": pd.Timestamp(closed, unit="ms"), "failures": failures, "status": status}

    def end_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "ok"], ascending=[True, False], kind="stable")
        since, failures, spent = self.outage.get() if self.outage.exists() else (None, 0, False)
        out = []
        for ts, ok in zip(calls["ts"].astype("datetime64[ms]").astype("int64").tolist(), calls["ok"].tolist(), strict=True):
            if since is not None and not spent and ts >= since + self.window_ms:
                out.append(self.row(key[0], since, since + self.window_ms, failures, "spent"))
                spent = True
            if ok and since is not None and ts >= since:
                if not spent:
                    out.append(self.row(key[0], since, ts, failures, "recovered"))
                since, failures, spent = None, 0, False
            elif not ok and not spent:
                since, failures = ts if since is None else min(since, ts), failures + 1
        self.end_timers()
        if since is None:
            self.outage.clear()
        else:
            self.outage.update((since, failures, spent))
            self.handle.registerTimer(since + self.window_ms + (self.forget_ms if spent else 0))
        yield pd.DataFrame(out, columns=["source", "opened", "closed", "failures", "status"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = []
        if self.outage.exists():
            since, failures, spent = self.outage.get()
            if spent:
                self.outage.clear()
            else:
                out.append(self.row(key[0], since, since + self.window_ms, failures, "spent"))
                self.outage.update((since, failures, True))
                self.handle.registerTimer(since + self.window_ms + self.forget_ms)
        yield pd.DataFrame(out, columns=["source", "opened", "closed", "failures", "status"])

    def close(self) -> None:
        pass


def stream_outages(calls: DataFrame, window_s: int, late: str = "10 minutes", forget_s: int = 86_400) -> DataFrame:
    """The stream form over calls (source, ts, ok); rows behind the watermark are dropped.

    Needs the RocksDB state store.
    """
    marked = calls.withWatermark("ts", late)
    return marked.groupBy("source").transformWithStateInPandas(Outages(window_s, forget_s), OUT, "Append", "EventTime")

"""Work-queue transitions on a snapshot of jobs, as pure DataFrame functions.

Spark has no row locks: a single writer applies these transitions to the table, in batches
or in ``foreachBatch``. Jobs have job_id, queue, state, available_at, attempts, leased_until.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(jobs: DataFrame, now: Column, batch: int) -> DataFrame:
    """Adds ``claimed``: the first due jobs of each queue by (available_at, job_id).

    The last job of each queue's claim is a row a queue, which the jobs meet where they are, so
    no payload moves. Only queues with more due jobs than ``batch`` are ordered.
    """
    due = (F.col("state") == "queued") & (F.col("available_at") <= now)
    place = F.struct("available_at", "job_id")
    waiting = jobs.where(due).select("queue", "available_at", "job_id")
    queues = waiting.groupBy(F.col("queue").alias("__queue")).agg(F.count("*").alias("n"), F.max(place).alias("__last"))
    of_queue = F.col("queue").eqNullSafe(F.col("__queue"))
    rn = F.row_number().over(Window.partitionBy("queue").orderBy("available_at", "job_id"))
    long = waiting.join(F.broadcast(queues.where(F.col("n") > batch)), of_queue, "left_semi").withColumn("__rn", rn).where(F.col("__rn") == batch)
    last = queues.where(F.col("n") <= batch).select("__queue", "__last").union(long.select("queue", place))
    met = jobs.join(F.broadcast(last), of_queue, "left")
    return met.select(*jobs.columns, F.coalesce(due & (place <= F.col("__last")), F.lit(False)).alias("claimed"))


def fail(jobs: DataFrame, failed: Column, now: Column, most: int, backoff_s: int) -> DataFrame:
    """Failed jobs wait for a backoff that doubles by attempt, or die at the cap."""
    dead = failed & (F.col("attempts") >= most)
    wait = F.lit(backoff_s) * F.pow(F.lit(2), F.col("attempts") - 1)
    later = (now.cast("double") + wait).cast("timestamp")
    return jobs.withColumns(
        {
            "state": F.when(dead, "dead").when(failed, "queued").otherwise(F.col("state")),
            "available_at": F.when(failed & ~dead, later).otherwise(F.col("available_at")),
        }
    )


def reap(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """Jobs whose lease has run out are queued again, or die at the cap."""
    lost = (F.col("state") == "running") & (F.col("leased_until") < now)
    state = F.when(lost & (F.col("attempts") >= most), "dead").when(lost, "queued").otherwise(F.col("state"))
    return jobs.withColumn("state", state)


def not_in_flight(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (queue, job_key), each key once already, that have no job in flight."""
    flying = jobs.where(F.col("state").isin("queued", "running")).select("queue", "job_key")
    return new.join(flying, ["queue", "job_key"], "left_anti")


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (queue, job_key) that have no job in flight, each key once."""
    return not_in_flight(jobs, new.dropDuplicates(["queue", "job_key"]))

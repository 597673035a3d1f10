"""Workers of a job table as micro-batches: reap, take in, claim, process, finish or fail.

One writer applies a tick to each micro-batch in ``foreachBatch``. Everything a tick reads is
fixed by its number: the micro-batch, and the snapshot that the tick before it wrote. So a tick
that is repeated after a failure overwrites its own output with the same rows, and nothing is
done twice. The clock is that of the requests, not of the machine.

A folder holds ``open/batch=N`` (jobs that wait or run after tick N), ``closed/batch=N`` (jobs
that tick N finished or gave up) and ``results/batch=N``. Only open jobs are written again; the
retention rule of the folder may remove snapshots before the last two.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusloom.operators import queues

JOBS = "job_id string, queue string, job_key string, payload string, state string, available_at timestamp, attempts int, leased_until timestamp"
#: From claimed jobs: job_id, ok, error and the columns of the result. A row that fails is a row.
Process = Callable[[DataFrame], DataFrame]


def taken_in(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """``jobs`` and the requests (queue, job_key, payload) that have no job open, each key once."""
    one = requests.groupBy("queue", "job_key").agg(F.min("payload").alias("payload"))
    new = queues.not_in_flight(jobs, one)
    rows = new.select(F.concat_ws(":", "queue", "job_key").alias("job_id"), "queue", "job_key", "payload", F.lit("queued").alias("state"), now.alias("available_at"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("leased_until"))
    return jobs.unionByName(rows)


def settled(jobs: DataFrame, done: DataFrame, now: Column, most: int, backoff_s: int) -> DataFrame:
    """Jobs after a tick: processed ones are done, wait for another try, or are dead."""
    marked = jobs.join(done.select("job_id", "ok"), "job_id", "left")
    failed = queues.fail(marked, F.coalesce(~F.col("ok"), F.lit(False)), now, most, backoff_s)
    state = F.when(F.coalesce("ok", F.lit(False)), "done").otherwise(F.col("state"))
    return failed.withColumn("state", state).withColumn("leased_until", F.when(F.col("ok").isNull(), F.col("leased_until"))).select(*jobs.columns)


class Worker:
    """The ticks of one worker over one folder."""

    def __init__(self, spark: SparkSession, folder: str, process: Process, batch: int = 1000, most: int = 3, backoff_s: int = 30, lease_s: int = 300):
        self.spark, self.folder, self.process = spark, folder.rstrip("/"), process
        self.batch, self.most, self.backoff_s, self.lease_s = batch, most, backoff_s, lease_s
        self.kinds = StructType.fromDDL(JOBS)

    def path(self, what: str, n: int) -> str:
        return f"{self.folder}/{what}/batch={n}"

    def open_jobs(self, n: int) -> DataFrame:
        """Open jobs after tick ``n``; before the first one there are none."""
        if n < 0:
            return self.spark.createDataFrame([], self.kinds)
        return self.spark.read.schema(self.kinds).parquet(self.path("open", n))

    def closed_jobs(self) -> DataFrame:
        return self.spark.read.schema(self.kinds).parquet(f"{self.folder}/closed/*")

    def tick(self, requests: DataFrame, n: int) -> int:
        """Tick ``n`` over requests (queue, job_key, payload, ts); open jobs after it."""
        jobs = self.open_jobs(n - 1)
        at = requests.agg(F.max("ts")).first()[0] or jobs.agg(F.min(F.coalesce("leased_until", "available_at"))).first()[0]
        now = F.lit(at).cast("timestamp")
        jobs = taken_in(queues.reap(jobs, now, self.most), requests, now)
        claimed = queues.claim(jobs, now, self.batch)
        running = claimed.withColumns(
            {
                "state": F.when(F.col("claimed"), "running").otherwise(F.col("state")),
                "attempts": F.col("attempts") + F.col("claimed").cast("int"),
                "leased_until": F.when(F.col("claimed"), (now.cast("double") + self.lease_s).cast("timestamp")).otherwise(F.col("leased_until")),
            }
        )
        # The claim is written before any work, so that work and outcome read the same jobs.
        running.write.mode("overwrite").parquet(self.path("claimed", n))
        running = self.spark.read.parquet(self.path("claimed", n))
        self.process(running.where("claimed")).write.mode("overwrite").parquet(self.path("results", n))
        done = self.spark.read.parquet(self.path("results", n))
        after = settled(running.select(*self.kinds.names), done, now, self.most, self.backoff_s)
        over = F.col("state").isin("done", "dead")
        after.where(over).write.mode("overwrite").parquet(self.path("closed", n))
        after.where(~over).write.mode("overwrite").parquet(self.path("open", n))
        return self.open_jobs(n).count()

    def start(self, requests: DataFrame, **trigger: Any) -> StreamingQuery:
        """Tick on each micro-batch of a stream of requests."""
        stream = requests.writeStream.foreachBatch(lambda df, n: self.tick(df, n) and None).option("checkpointLocation", f"{self.folder}/checkpoint")
        return stream.trigger(**trigger).start() if trigger else stream.start()

    def drain(self, requests: DataFrame, n: int) -> int:
        """Ticks without requests, from number ``n``, until no job is open; the next number.

        Attempts are bounded, so every job ends.
        """
        none = requests.where(F.lit(False))
        while self.tick(none, n):
            n += 1
        return n + 1


def without_vectors(versions: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Versions (queue, job_key, payload, ts) that have no vector of their profile (queue) yet."""
    if vectors is None:
        return versions
    return versions.join(vectors.select("queue", "job_key").distinct(), ["queue", "job_key"], "left_anti")


class Embedder(Worker):
    """A worker whose results are vectors by profile and version; known versions are not asked again.

    ``embed`` maps (job_id, queue, job_key, payload) to these and ``vector``; a null vector is a
    failed call.
    """

    def __init__(self, spark: SparkSession, folder: str, embed: Process, **options: Any):
        def process(claimed: DataFrame) -> DataFrame:
            made = embed(claimed.select("job_id", "queue", "job_key", "payload"))
            return made.select("job_id", "queue", "job_key", "vector", F.col("vector").isNotNull().alias("ok"), F.when(F.col("vector").isNull(), "NO_VECTOR").alias("error"))

        super().__init__(spark, folder, process, **options)

    def vectors(self, before: int) -> DataFrame | None:
        """Vectors of the ticks before number ``before``."""
        return self.spark.read.parquet(*[self.path("results", n) for n in range(before)]).where("ok") if before else None

    def tick(self, requests: DataFrame, n: int) -> int:
        return super().tick(without_vectors(requests, self.vectors(n)), n)


def hashed_vector(text: Column, dims: int = 16) -> Column:
    """A unit vector of the words' hashed counts; null without words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dims)))

    def counted(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.when(norm > 0, F.transform(v, lambda x: x / norm))

    # In an array of one, slots and counts have names, so that each is worked out once.
    counts = F.transform(F.array(slots), counted)
    return F.get(F.transform(counts, scaled), F.lit(0))

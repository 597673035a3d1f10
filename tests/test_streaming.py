"""Streaming forms give what the batch forms give, and states follow their rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import queues
from corpusloom.streaming import jobs
from corpusloom.tables import table

SF = "/root/testdata/sf0.001"


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def stream(spark, tmp_path, rows, schema, name):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_usage_windows_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    run(jobs.usage_windows(live), "usage", "complete")
    want = {tuple(r) for r in jobs.usage_windows(events).select("start", "event_type", "calls", "over").collect()}
    assert {tuple(r) for r in spark.table("usage").select("start", "event_type", "calls", "over").collect()} == want
    assert jobs.sliding_usage(events).agg(F.sum("calls")).first()[0] == 4 * events.count()
    assert jobs.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_job_states(spark, tmp_path):
    rows = [[(1, at(0), "enqueue"), (1, at(1), "claim"), (2, at(0), "enqueue")], [(1, at(2), "fail"), (1, at(3), "claim"), (1, at(4), "reap")], [(1, at(5), "claim"), (1, at(6), "fail"), (2, at(7), "claim"), (2, at(8), "finish")]]
    live = stream(spark, tmp_path, rows, "job_id bigint, ts timestamp, kind string", "jobs")
    run(jobs.job_states(live), "job_states", "update")
    last = {r["job_id"]: (r["state"], r["attempts"]) for r in spark.sql("select job_id, max_by(state, attempts) as state, max(attempts) as attempts from job_states where state in ('dead', 'done') group by 1").collect()}
    assert last == {1: ("dead", 3), 2: ("done", 1)}


@pytest.mark.parametrize("kind", ["bucket", "breaker"])
def test_rate_limits(spark, tmp_path, kind):
    if kind == "bucket":
        live = stream(spark, tmp_path, [[("a", at(i), 1.0) for i in range(0, 4)]], "source string, ts timestamp, cost double", kind)
        run(jobs.token_bucket(live, 2.0, 0.1), kind, "append")
        assert [r["allowed"] for r in spark.table(kind).orderBy("ts").collect()] == [True, True, False, False]
    else:
        calls = [(0, False), (1, False), (2, False), (3, True), (70, False), (71, True), (140, True), (141, True)]
        live = stream(spark, tmp_path, [[("a", at(s), ok) for s, ok in calls]], "source string, ts timestamp, ok boolean", kind)
        run(jobs.circuit_breaker(live), kind, "append")
        assert [r["state"] for r in spark.table(kind).orderBy("ts").collect()] == ["closed"] * 3 + ["open", "half_open", "open", "half_open", "closed"]


def test_enqueue_once(spark, tmp_path):
    rows = [[("q", "k", at(0)), ("q", "k", at(1)), ("q", "j", at(1))], [("q", "k", at(2))]]
    live = stream(spark, tmp_path, rows, "queue string, job_key string, ts timestamp", "requests")
    run(jobs.enqueue_once(live), "enqueued", "append")
    assert spark.table("enqueued").count() == 2


def test_claim_moves_no_payload(spark):
    """Jobs meet the last place of their queue's claim where they are; none are dealt by their id."""
    rows = [(f"j{i:02}", None if i % 3 == 2 else f"q{i % 3}", "x" * 50, "queued" if i % 4 else "running", dt.datetime(2024, 1, 1 + i % 5)) for i in range(20)]
    jobs = spark.createDataFrame(rows, "job_id string, queue string, payload string, state string, available_at timestamp")
    claimed = queues.claim(jobs, F.lit("2024-01-04").cast("timestamp"), 3)
    assert "hashpartitioning(job_id" not in claimed._jdf.queryExecution().executedPlan().toString()
    due = sorted((r[1] or "", r[4], r[0]) for r in rows if r[3] == "queued" and r[4] <= dt.datetime(2024, 1, 4))
    want = {j for q in ("", "q0", "q1") for j in [d[2] for d in due if d[0] == q][:3]}
    got = claimed.collect()
    assert len(got) == 20 and {r["job_id"] for r in got if r["claimed"]} == want

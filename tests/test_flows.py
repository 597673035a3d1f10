"""Workers, outages, lanes and the port: replays, late rows, failing lanes, unreadable parts."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lanes
from corpusloom.plans import flows
from corpusloom.sources import port
from corpusloom.streaming import outages, workers
from corpusloom.tables import table

SF = "/root/testdata/sf0.001"
REQUEST = "queue string, job_key string, payload string, ts timestamp"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def snapshot(worker, n):
    jobs = worker.open_jobs(n).unionByName(worker.closed_jobs())
    return sorted((r["job_id"], r["state"], r["attempts"], r["available_at"]) for r in jobs.collect())


def test_worker_replays_a_batch(spark, tmp_path):
    worker = workers.Worker(spark, str(tmp_path), flows.checked_value, most=2, backoff_s=30)
    first = spark.createDataFrame([("a", "1", "10", at(0)), ("a", "1", "10", at(1)), ("a", "2", "90", at(2)), ("b", "1", None, at(2))], REQUEST)
    assert worker.tick(first, 0) == 2
    once = snapshot(worker, 0)
    assert once == [("a:1", "done", 1, at(2)), ("a:2", "queued", 1, at(32)), ("b:1", "queued", 1, at(32))]
    assert worker.tick(first, 0) == 2 and snapshot(worker, 0) == once
    # A job in flight is not taken in again; one that is over is.
    again = spark.createDataFrame([("a", "2", "20", at(10)), ("a", "1", "5", at(10))], REQUEST)
    assert worker.tick(again, 1) == 2
    assert [x for x in snapshot(worker, 1) if x[0] == "a:2"] == [("a:2", "queued", 1, at(32))]
    assert worker.drain(again, 2) == 3
    assert sorted(x[:3] for x in snapshot(worker, 2)) == [("a:1", "done", 1), ("a:1", "done", 1), ("a:2", "dead", 2), ("b:1", "dead", 2)]


def test_worker_claims_in_batches_and_reaps(spark, tmp_path):
    worker = workers.Worker(spark, str(tmp_path), flows.checked_value, batch=2, lease_s=60)
    rows = spark.createDataFrame([("a", str(n), "1", at(n)) for n in range(5)], REQUEST)
    assert [worker.tick(rows, 0), worker.tick(rows.limit(0), 1), worker.tick(rows.limit(0), 2)] == [3, 1, 0]
    lost = worker.open_jobs(-1).union(spark.createDataFrame([("a:9", "a", "9", "1", "running", at(0), 1, at(5))], worker.kinds))
    lost.write.parquet(worker.path("open", 6))
    assert worker.tick(spark.createDataFrame([("b", "1", "1", at(9))], REQUEST), 7) == 0
    assert {(r["job_id"], r["attempts"]) for r in worker.closed_jobs().where("attempts = 2").collect()} == {("a:9", 2)}


def test_worker_stream_resumes(spark, tmp_path):
    """A stream that stops and starts again goes on where it was."""
    source = tmp_path / "in"
    worker = workers.Worker(spark, str(tmp_path / "work"), flows.checked_value)
    for part in ([("a", "1", "1", at(0))], [("a", "2", "99", at(100)), ("a", "3", "2", at(100))]):
        spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(str(source))
        worker.start(spark.readStream.schema(REQUEST).parquet(str(source)), availableNow=True).awaitTermination()
    assert sorted((r["job_id"], r["state"]) for r in worker.closed_jobs().collect()) == [("a:1", "done"), ("a:3", "done")]
    assert [r["job_id"] for r in worker.open_jobs(1).collect()] == ["a:2"]


def test_embedder_asks_once(spark, tmp_path):
    asked = []

    def embed(claimed):
        asked.append(claimed.count())
        return claimed.select("job_id", "queue", "job_key", workers.hashed_vector(F.col("payload")).alias("vector"))

    worker = workers.Embedder(spark, str(tmp_path), embed, most=1)
    rows = [("p", str(i), t, at(0)) for i, t in enumerate(["a b b", "...", None, "c"])]
    worker.tick(spark.createDataFrame(rows, REQUEST), 0)
    worker.tick(spark.createDataFrame([*rows[:1], ("p", "9", "a", at(5)), ("q", "0", "a b b", at(5))], REQUEST), 1)
    made = {(r["queue"], r["job_key"]): r["vector"] for r in worker.vectors(2).collect()}
    assert asked == [4, 2] and set(made) == {("p", "0"), ("p", "3"), ("p", "9"), ("q", "0")}
    assert all(math.isclose(sum(x * x for x in v), 1.0) for v in made.values())
    assert sorted(x for x in made[("p", "0")] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def plain_outages(calls, window):
    """Windows of one source's calls (seconds, ok) by a walk, with the last call as the end."""
    out, since, failures, spent, last = [], None, 0, False, max(t for t, _ in calls)
    for t, ok in sorted(calls, key=lambda c: (c[0], not c[1])):
        if since is not None and not spent and t >= since + window:
            out.append((since, since + window, failures, "spent"))
            spent = True
        if ok:
            if since is not None and not spent:
                out.append((since, t, failures, "recovered"))
            since, failures, spent = None, 0, False
        elif not spent:
            since, failures = t if since is None else since, failures + 1
    return out, (since, None, failures, "open") if since is not None and not spent else None, last


def test_outages_equal_plain(spark):
    rnd = random.Random(4)
    calls = [(s, t, rnd.random() < 0.4) for s in "abcdef" for t in sorted(rnd.sample(range(600), 40))]
    df = spark.createDataFrame([(s, at(t), ok) for s, t, ok in calls], "source string, ts timestamp, ok boolean")
    got = sorted((r["source"], r["opened"], r["closed"], r["failures"], r["status"]) for r in outages.outage_windows(df, 60).collect() if r["status"] != "open")
    want, last = [], max(t for _, t, _ in calls)
    for s in "abcdef":
        done, open_, _ = plain_outages([(t, ok) for x, t, ok in calls if x == s], 60)
        if open_ and last >= open_[0] + 60:
            done.append((open_[0], open_[0] + 60, open_[2], "spent"))
        want += [(s, at(a), at(b), n, status) for a, b, n, status in done]
    assert got == sorted(want)


def test_outages_stream(spark, tmp_path):
    """Windows open and close by event time; a row behind the watermark changes nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "source string, ts timestamp, ok boolean"
    parts = [
        [("a", at(0), False), ("a", at(20), False), ("b", at(30), False)],
        [("a", at(40), True), ("c", at(50), True)],
        [("c", at(2000), True)],
        [("a", at(45), False), ("b", at(2010), False)],
        [("b", at(2020), True), ("b", at(2030), False), ("c", at(4000), True)],
        [("c", at(6000), True)],
    ]
    try:
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            live = outages.stream_outages(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 60, "10 seconds")
            q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["source"], r["opened"], r["closed"], r["failures"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", at(0), at(40), 2, "recovered"), ("b", at(30), at(90), 1, "spent"), ("b", at(2030), at(2090), 1, "spent")}


def test_failing_lane_leaves_others(spark):
    hits = spark.createDataFrame([(1, 5, 1, 0.9), (1, 6, 2, 0.5), (2, 5, 1, 0.7)], "query_id bigint, id bigint, rank int, score double")

    def broken():
        raise ValueError("no index")

    late = hits.withColumn("rank", F.raise_error(F.lit("lost")).cast("int"))
    fused, report = lanes.run_lanes(spark, {"one": (lambda: hits, 1.0), "plan": (broken, 1.0), "run": (lambda: late, 1.0), "two": (lambda: hits.where("id = 5"), 0.5)})
    assert {(r["lane"], r["status"], r["n_hits"], r["n_queries"]) for r in report.collect()} == {("one", "OK", 3, 2), ("plan", "FAILED", 0, 0), ("run", "FAILED", 0, 0), ("two", "OK", 2, 2)}
    assert {(r["query_id"], r["id"], r["n_lanes"]): r["score"] for r in fused.collect()} == {(1, 5, 2): round(1.5 / 61, 9), (1, 6, 1): round(1 / 62, 9), (2, 5, 2): round(1.5 / 61, 9)}
    assert lanes.run_lanes(spark, {"plan": (broken, 1.0)})[0].collect() == []


def test_exact_and_lexical_lanes_find_planted(spark):
    """A document that holds a query whole leads its lanes."""
    asked = table(spark, SF, "benchmark").orderBy("item_id").limit(3)
    queries = lanes.lane_queries(asked, "item_id", "text")
    plain = table(spark, SF, "documents").select(F.col("doc_id").alias("id"), "text")
    docs = plain.unionByName(asked.select((F.col("item_id") + 100_000).alias("id"), F.concat(F.lit("before\n"), "text", F.lit("\nafter")).alias("text")))
    for hits in (lanes.exact_lane(queries, docs, 5), lanes.lexical_lane(queries, docs, 500), lanes.trigram_lane(queries, docs, 500)):
        found = {(r["query_id"], r["id"]) for r in hits.collect()}
        assert {(r["item_id"], r["item_id"] + 100_000) for r in asked.collect()} <= found


def test_port_reads_and_reports(spark, tmp_path):
    rows = [(1, "Title\nbody é"), (2, None), (3, " \n "), (4, "Title only"), (None, "x\ny")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "part-bad.parquet").write_bytes(b"no parquet")
    got = {(r["external_id"], r["title"], r["body"], r["reason"]) for r in port.read_port(spark, str(tmp_path / "t")).collect()}
    assert got == {("1", "Title", "body é", None), ("2", None, None, "NO_TEXT"), ("3", None, None, "NO_WORDS"), ("4", None, None, "NO_BODY"), (None, None, None, "NO_ID"), (None, None, None, "UNREADABLE_PART:part-bad.parquet:ArrowInvalid")}
    one = port.read_port(spark, str(tmp_path / "t")).where("external_id = '1'").first()
    assert one["content_sha256"] == hashlib.sha256("Title\nbody é".encode()).hexdigest()


def test_port_streams_new_parts(spark, tmp_path):
    source, out = tmp_path / "t", tmp_path / "out"
    for n in range(2):
        spark.createDataFrame([(n, "a\nb")], "doc_id bigint, text string").coalesce(1).write.parquet(str(source / f"{n}"))
        q = port.read_port(spark, str(source), stream=True).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["external_id"] for r in spark.read.parquet(str(out)).collect()) == ["0", "1"]


def test_lexical_lane_reads_texts_once(spark):
    """After their one read only the asked words of the texts are left, so the hits come from no text."""
    queries = lanes.lane_queries(spark.createDataFrame([(1, "yellow orange purple")], "item_id bigint, text string"), "item_id", "text")
    docs = spark.range(6).select("id", F.when(F.col("id") % 2 == 0, "Orange purple purple pink").otherwise("yellow").alias("text"))
    hits = lanes.lexical_lane(queries, docs, 5)
    assert "Range" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["rank"], round(r["score"], 6)) for r in hits.collect()) == [(0, 1, 0.666667), (2, 2, 0.666667), (4, 3, 0.666667)]

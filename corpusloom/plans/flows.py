"""Queries on retrieval lanes, workers, outages and the pluggable source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import lanes
from corpusloom.plans.registry import query
from corpusloom.sources import port
from corpusloom.storage import shared_dir
from corpusloom.streaming import outages, workers
from corpusloom.tables import table

# Lanes: the texts of ``benchmark`` are the queries, ``documents`` are searched

K = 20
NORMAL = r"trim(regexp_replace(lower({0}), '[ \t\n\r\x0b\f]+', ' ', 'g'))"
PLAIN = "translate(coalesce(text, ''), '‘’“”–—', '''''\"\"--')"

QUERY_SQL = rf"""
raw as (select item_id as query_id, {PLAIN} as t from benchmark),
q as (
  select query_id, {NORMAL.format("t")} as normal, list_sort(list_distinct(list_filter(string_split_regex(lower(t), '[^\p{{L}}]+'), lambda w: length(w) >= 5))) as words,
    list_filter(list_transform(string_split(t, chr(10)), lambda x: {NORMAL.format("x")}), lambda x: len(string_split(x, ' ')) >= 4) as lines, {NORMAL.format("split_part(t, chr(10), 1)")} as first_line
  from raw
)"""
LANES_SQL = rf"""{QUERY_SQL},
asked as (select query_id, unnest(list_distinct(lines)) as line from q),
held as (select doc_id as id, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: {NORMAL.format("x")}))) as line from documents),
exact0 as (select query_id, id, count(*)::double as score from held join asked using (line) group by 1, 2),
posts as (select id, word from (select doc_id as id, unnest(list_distinct(string_split_regex(lower(text), '[^\p{{L}}]+'))) as word from documents) where length(word) >= 5),
w as (select query_id, unnest(words) as word from q),
df as (select word, count(*) as df from posts where word in (select word from w) group by 1),
rated as (select w.query_id, w.word from w left join df using (word) qualify row_number() over (partition by query_id order by coalesce(df, 0), word) <= 8),
lexical0 as (
  select m.query_id, m.id, round(m.m::double / n.n, 9) as score from (select query_id, id, count(*) as m from posts join rated using (word) group by 1, 2) m join (select query_id, count(*) as n from rated group by 1) n using (query_id)
  where round(m.m::double / n.n, 9) >= 0.5
),
qw as (select query_id, list_filter(string_split_regex(first_line, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from q),
qg as (select query_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as g from qw where len(w) >= 3),
qu as (select query_id, len(g) as n, unnest(g) as gram from qg),
dw as (select doc_id as id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from documents),
du as (select id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) as gram from dw where len(w) >= 3),
trigram0 as (select * from (select query_id, id, round(count(*)::double / max(n), 9) as score from du join qu using (gram) group by 1, 2) where score >= 0.3),
v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
dense0 as (select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(b.e, a.e), 9) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id in (select item_id from benchmark)),
""" + ",\n".join(f"{x} as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from {x}0 qualify row_number() over (partition by query_id order by score desc, id) <= {K})" for x in ("exact", "lexical", "trigram", "dense"))
WEIGHTS = {"exact": 1.0, "lexical": 1.0, "trigram": 0.7, "dense": 0.5}
ALL_SQL = " union all ".join(f"select query_id, id, {w}::double / (60 + rank) as share from {x}" for x, w in WEIGHTS.items())


def searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Fused hits and the report of all lanes; a lane without its index fails by itself."""
    queries = lanes.lane_queries(table(spark, d, "benchmark"), "item_id", "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    def dense() -> DataFrame:
        asked = vectors.join(queries.select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        return lanes.dense_lane(asked, vectors, K)

    made = {
        "exact": lambda: lanes.exact_lane(queries, docs, K),
        "lexical": lambda: lanes.lexical_lane(queries, docs, K),
        "trigram": lambda: lanes.trigram_lane(queries, docs, K),
        "dense": dense,
    }
    remote = {"remote": (lambda: table(spark, d, "remote_index").select("query_id", "id", "rank", "score"), 1.0)}
    return lanes.run_lanes(spark, {x: (made[x], w) for x, w in WEIGHTS.items()} | remote)


@query("rt_lane_query", f"with {QUERY_SQL} select query_id, normal, array_to_string(words, ' ') as words, len(lines)::int as n_lines, first_line from q")
def rt_lane_query(spark: SparkSession, d: str) -> DataFrame:
    """Queries taken apart for the lanes."""
    q = lanes.lane_queries(table(spark, d, "benchmark"), "item_id", "text")
    return q.select("query_id", "normal", F.array_join("words", " ").alias("words"), F.size("lines").alias("n_lines"), "first_line")


@query("rt_pipeline", f"with {LANES_SQL} select query_id, id, round(sum(share), 9) as score, count(*) as n_lanes from ({ALL_SQL}) group by 1, 2")
def rt_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All lanes for all queries, fused by reciprocal ranks."""
    return searched(spark, d)[0]


@query(
    "rt_lane_report",
    f"with {LANES_SQL} " + " union all ".join(f"select '{x}' as lane, 'OK' as status, count(*) as n_hits, count(distinct query_id) as n_queries, null as error from {x}" for x in WEIGHTS) + " union all select 'remote', 'FAILED', 0, 0, 'AnalysisException'",
)
def rt_lane_report(spark: SparkSession, d: str) -> DataFrame:
    """What each lane did; the lane without its index is a failed row."""
    return searched(spark, d)[1]


# Workers


def work_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/worker-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream of its files.

    The path is a pattern, as the file source takes a plain path for a folder.
    """
    at = d.rstrip("/")
    return spark.readStream.schema(table(spark, d, name).schema).option("basePath", at).parquet(f"{at}/{name}.parque[t]")


def checked_value(claimed: DataFrame) -> DataFrame:
    """The work of the query: values of at most 50 are squared, others fail."""
    value = F.expr("try_cast(payload as double)")
    ok = F.coalesce(value <= 50, F.lit(False))
    return claimed.select("job_id", "queue", "job_key", ok.alias("ok"), F.when(~ok, "TOO_LARGE").alias("error"), F.when(ok, F.round(value * value, 4)).alias("output"))


@query("sm_worker_tick", "select event_type as queue, event_id::varchar as job_key, case when value <= 50 then 'done' else 'dead' end as state, case when value <= 50 then 1 else 3 end as attempts from events")
def sm_worker_tick(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests of a stream: all jobs end as done, or dead after three tries."""
    events = stream_of(spark, d, "events")
    kinds = {"queue": F.col("event_type"), "job_key": F.col("event_id").cast("string"), "payload": F.col("value").cast("string"), "ts": F.col("ts").cast("timestamp")}
    requests = events.select(*[c.alias(n) for n, c in kinds.items()])
    worker = workers.Worker(spark, work_folder(spark), checked_value, batch=1_000_000_000)
    running = worker.start(requests, availableNow=True)
    running.awaitTermination()
    last = running.lastProgress["batchId"] if running.lastProgress else -1
    worker.drain(spark.createDataFrame([], "queue string, job_key string, payload string, ts timestamp"), last + 1)
    return worker.closed_jobs().select("queue", "job_key", "state", "attempts")


EMBED_SQL = r"""
w as (select doc_id, lower(w) as w from (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) as w from documents)),
n as (select doc_id, count(*) as n_words, count(distinct w) as n_distinct from w group by 1)"""


@query("sm_embed_tick", f"with {EMBED_SQL} select d.doc_id::varchar as job_key, n.n_words is not null as embedded, 16 as dims, case when n.n_words is not null then 1.0::double end as length from documents d left join n on n.doc_id = d.doc_id")
def sm_embed_tick(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents by an embedding worker; a second pass over them asks nothing."""
    docs = table(spark, d, "documents")
    requests = docs.select(F.lit("hashed16").alias("queue"), F.col("doc_id").cast("string").alias("job_key"), F.col("text").alias("payload"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))

    def embed(claimed: DataFrame) -> DataFrame:
        return claimed.select("job_id", "queue", "job_key", workers.hashed_vector(F.col("payload")).alias("vector"))

    worker = workers.Embedder(spark, work_folder(spark), embed, batch=1_000_000_000, most=1)
    worker.tick(requests, 0)
    worker.tick(requests, 1)
    made = worker.vectors(2).select("job_key", "vector")
    done = docs.select(F.col("doc_id").cast("string").alias("job_key")).join(made, "job_key", "left")
    length = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6)
    return done.select("job_key", F.col("vector").isNotNull().alias("embedded"), F.coalesce(F.size("vector"), F.lit(16)).alias("dims"), length.alias("length"))


OUTAGE_S = 86_400
OUTAGE_SQL = f"""
c as (select user_id::varchar as source, ts, event_type <> 'error' as ok from events),
r as (select *, sum(ok::int) over (partition by source order by ts, ok desc) as run from c),
g as (select source, run - 1 as run, min(ts) as good from r where ok group by 1, 2),
f as (select *, min(ts) over (partition by source, run) as opened from r where not ok),
p as (select source, run, opened, count(*) as failures from f where ts < opened + interval '{OUTAGE_S} seconds' group by all),
s as (select p.*, g.good, opened + interval '{OUTAGE_S} seconds' as stop, (select max(ts) from c) as latest from p left join g on g.source = p.source and g.run = p.run)"""


@query("sm_outage_window", f"with {OUTAGE_SQL} select source, opened, case when good < stop then good when latest >= stop then stop end as closed, failures, case when good < stop then 'recovered' when latest >= stop then 'spent' else 'open' end as status from s")
def sm_outage_window(spark: SparkSession, d: str) -> DataFrame:
    """Outage windows of a day for every user's events."""
    calls = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    return outages.outage_windows(calls, OUTAGE_S)


# The pluggable source

PARSED = "case when text is null then 'NO_TEXT' when trim(text, E' \\n\\t\\r') = '' then 'NO_WORDS' when trim(case when contains(text, chr(10)) then substring(text, instr(text, chr(10)) + 1) else '' end, E' \\n\\t\\r') = '' then 'NO_BODY' end"


@query("src_port_protocol", f"with p as (select *, {PARSED} as reason from documents) select doc_id::varchar as external_id, case when reason is null then split_part(text, chr(10), 1) end as title, case when reason is null then length(text) - length(split_part(text, chr(10), 1)) - 1 end::int as body_chars, case when reason is null then sha256(text) end as content_sha256, reason from p")
def src_port_protocol(spark: SparkSession, d: str) -> DataFrame:
    """Documents listed, fetched and parsed by the port; what can't be parsed has a reason."""
    found = port.read_port(spark, f"{d.rstrip('/')}/documents.parquet")
    return found.select("external_id", "title", F.length("body").alias("body_chars"), "content_sha256", "reason")

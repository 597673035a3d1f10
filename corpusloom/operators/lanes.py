"""Retrieval in lanes: many queries at once, one result of ranked hits a lane, fused at the end.

A lane maps the queries to hits (query_id, id, rank). Each lane is written on its own; one that
fails, while it is planned or while it runs, is a row of the report and leaves the others as
they are. Counts of the report come from an observation of the same write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse
from corpusloom.functions.vectors import dot, norm, rrf
from corpusloom.storage import materialize

Lane = Callable[[], DataFrame]


def lane_queries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Queries taken apart: query_id, normal, words, lines, first_line.

    ``normal`` has typographic marks made plain and blanks collapsed; ``words`` are distinct, of
    five letters or more, and ``lines`` those of four words or more.
    """
    raw = F.translate(F.coalesce(F.col(text), F.lit("")), "‘’“”–—", "''\"\"--")
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(raw), r"[^\p{L}]+"), lambda w: F.length(w) >= 5)))
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: collapse(F.lower(x))), lambda x: F.size(F.split(x, " ")) >= 4)
    return rows.select(F.col(key).alias("query_id"), collapse(F.lower(raw)).alias("normal"), words.alias("words"), lines.alias("lines"), collapse(F.lower(F.substring_index(raw, "\n", 1))).alias("first_line"))


def top(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k hits of each query: query_id, id, rank, score."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "rank", F.col("score").cast("double").alias("score"))


def exact_lane(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Texts by the number of a query's lines that they hold as they are."""
    asked = queries.select("query_id", F.explode(F.array_distinct("lines")).alias("line"))
    lines = F.array_distinct(F.transform(F.split(F.lower("text"), "\n"), collapse))
    held = docs.select("id", F.explode(lines).alias("line"))
    return top(held.join(F.broadcast(asked), "line").groupBy("query_id", "id").agg(F.count("*").alias("score")), k, F.desc("score"))


def lexical_lane(queries: DataFrame, docs: DataFrame, k: int, rarest: int = 8, least: float = 0.5) -> DataFrame:
    """Texts that hold at least a share of a query's rarest words, by that share.

    Rarity is counted over all texts; words that only the query has are the rarest. Texts are
    read once: what is kept of them are the asked words that they hold.
    """
    asked = queries.select("query_id", F.explode("words").alias("word"))
    wanted = asked.select("word").distinct()
    held = docs.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where(F.length("word") >= 5)
    postings = materialize(held.join(F.broadcast(wanted), "word").select("id", "word"))
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    rated = asked.join(df, "word", "left").withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "word"))).where(F.col("rn") <= rarest)
    of = rated.groupBy("query_id").agg(F.count("*").alias("n"))
    matched = postings.join(F.broadcast(rated.select("query_id", "word")), "word").groupBy("query_id", "id").agg(F.count("*").alias("m"))
    hits = matched.join(of, "query_id").withColumn("score", F.round(F.col("m") / F.col("n"), 9)).where(F.col("score") >= least)
    return top(hits, k, F.desc("score"))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n words; texts of fewer words have none."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    none = F.array().cast("array<string>")

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(made)).otherwise(none)

    # In an array of one the words have a name, so that they are worked out once, not once a run.
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def trigram_lane(queries: DataFrame, docs: DataFrame, k: int, least: float = 0.3) -> DataFrame:
    """Texts by the share of the word trigrams of a query's first line that they hold."""
    asked = queries.select("query_id", shingles(F.col("first_line")).alias("g")).withColumn("n", F.size("g")).select("query_id", "n", F.explode("g").alias("gram"))
    held = docs.select("id", F.explode(shingles(F.col("text"))).alias("gram"))
    hits = held.join(F.broadcast(asked), "gram").groupBy("query_id", "id").agg(F.round(F.count("*") / F.max("n"), 9).alias("score")).where(F.col("score") >= least)
    return top(hits, k, F.desc("score"))


def dense_lane(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Vectors (id, v) by cosine with each query's vector (query_id, q), without its own.

    The queries are a stated set: blocks of vectors meet all of them, each with its length.
    """
    sized = vectors.select("id", "v", norm(F.col("v")).alias("v_norm"))
    pairs = sized.crossJoin(F.broadcast(asked.select("query_id", "q", norm(F.col("q")).alias("q_norm")))).where(F.col("id") != F.col("query_id"))
    scored = pairs.withColumn("score", F.round(dot(F.col("v"), F.col("q")) / (F.col("v_norm") * F.col("q_norm")), 9))
    return top(scored, k, F.desc("score"))


def run_lanes(spark: SparkSession, lanes: dict[str, tuple[Lane, float]], k: int = 60) -> tuple[DataFrame, DataFrame]:
    """Fused hits (query_id, id, score, n_lanes) and a report (lane, status, n_hits, n_queries, error)."""
    done, report = [], []
    for name, (lane, weight) in lanes.items():
        seen = Observation()
        try:
            found = lane().observe(seen, F.count("*").alias("n_hits"), F.count_if(F.col("rank") == 1).alias("n_queries"))
            done.append(materialize(found).select("query_id", "id", rrf(F.col("rank"), weight, k).alias("share")))
            report.append((name, "OK", seen.get["n_hits"], seen.get["n_queries"], None))
        except (PySparkException, ValueError, OSError) as e:
            report.append((name, "FAILED", 0, 0, type(e).__name__))
    rows = spark.createDataFrame(report, "lane string, status string, n_hits bigint, n_queries bigint, error string")
    if not done:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, n_lanes bigint"), rows
    hits = done[0]
    for d in done[1:]:
        hits = hits.unionByName(d)
    fused = hits.groupBy("query_id", "id").agg(F.round(F.sum("share"), 9).alias("score"), F.count("*").alias("n_lanes"))
    return fused, rows

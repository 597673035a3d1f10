"""Search lanes over chunked texts, their fusion and caps.

The lexical lane is an inverted index join: query words meet postings by an equi-join, and
coverage, idf share and order come from one aggregation a chunk. Lanes are ranked with a
top-k and fused by reciprocal ranks; nothing but the query itself passes the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import bm25_idf, dot, norm, rrf


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line of text that is not blank: key, ordinal (from 0), body."""
    t = docs.select(key, F.posexplode(F.split(text, "\n")).alias("ordinal", "body"))
    return t.where(F.trim("body") != "")


def postings(chunked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct words of each chunk: key, ordinal, word."""
    words = F.array_distinct(F.filter(F.split(F.lower("body"), r"[^\p{L}]+"), lambda x: F.length(x) >= 3))
    return chunked.select(key, "ordinal", F.explode(words).alias("word"))


def query_words(query: str) -> list[str]:
    """Distinct words of a query, in order."""
    return list(dict.fromkeys(w for w in re.split(r"[\W\d_]+", query.lower()) if len(w) >= 3))


def lexical_coverage(spark: SparkSession, chunked: DataFrame, query: str, least: float = 0.25, key: str = "doc_id") -> DataFrame:
    """Chunks by share of matched query words and of their idf.

    A chunk is kept if it holds at least ``least`` of the words, or of their idf. The idf of
    a word counts over all chunks.
    """
    words = query_words(query)
    wanted = spark.createDataFrame([(w,) for w in words], "word string")
    hits = postings(chunked, key).join(F.broadcast(wanted), "word")
    n = chunked.agg(F.count("*").alias("n"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    idf = wanted.join(df, "word", "left").crossJoin(F.broadcast(n)).select("word", bm25_idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf"))
    total = idf.agg(F.sum("idf").alias("all_idf"))
    per = hits.join(F.broadcast(idf), "word").groupBy(key, "ordinal").agg(F.count("*").alias("matched"), F.sum("idf").alias("idf"))
    per = per.crossJoin(F.broadcast(total)).select(
        key, "ordinal", "matched", (F.col("matched") / F.lit(len(words))).alias("coverage"), (F.col("idf") / F.col("all_idf")).alias("weighted_coverage")
    )
    return per.where((F.col("matched") >= F.ceil(F.lit(least * len(words)))) | (F.col("weighted_coverage") >= least))


def ranked(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows of highest score with rank from 1; ties to the smaller key."""
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def dense(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id") -> DataFrame:
    """The k vectors of highest cosine with a query vector, exactly."""
    q = F.array(*[F.lit(float(x)) for x in query])
    e = F.col("embedding")
    length = norm(e)
    scored = vectors.where(F.size(e) == len(query)).withColumn("score", F.when(length > 0, dot(e, q) / (length * norm(q))))
    return ranked(scored.where("score is not null").select(F.col(key).alias("id"), F.round("score", 9).alias("score")), "score", "id", k)


def fuse(lanes: Sequence[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal ranks of lanes (id, rank): id, score, n_lanes."""
    rows = [lane.select("id", rrf(F.col("rank"), weight, k).alias("share")) for lane, weight in lanes]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("id").agg(F.sum("share").alias("score"), F.count("*").alias("n_lanes"))


def cap_per_document(hits: DataFrame, document: str, order: Sequence[Column], most: int) -> DataFrame:
    """At most ``most`` hits a document, the first in the given order."""
    rn = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    return hits.withColumn("__rn", rn).where(F.col("__rn") <= most).drop("__rn")


def pins_first(fused: DataFrame, pins: DataFrame) -> DataFrame:
    """Fused rows with ``pinned``; sort by pinned, then score."""
    marked = fused.join(pins.select("id", F.lit(True).alias("pinned")), "id", "full")
    return marked.withColumns({"pinned": F.coalesce("pinned", F.lit(False)), "score": F.coalesce("score", F.lit(0.0))})

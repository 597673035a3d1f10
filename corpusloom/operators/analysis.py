"""Analysis over extracted values: pairwise verdicts, groups, coverage and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.graph import connected_components


def compare_values(a: Column, b: Column, gap: float = 0.01) -> Column:
    """Equal values corroborate, values within the gap of the larger are in tension, others contradict."""
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.when(a == b, "CORROBORATION").when((larger > 0) & (F.abs(a - b) <= gap * larger), "TENSION").otherwise("CONTRADICTION")


def compare_dates(a: Column, b: Column, exact: Column, named: Column) -> Column:
    """Verdict on two dates; ``exact``: both name a day; ``named``: both are of one named event.

    Dates of different precision are in tension; two days of a named event contradict each
    other, other days only if they are not in one month.
    """
    month = F.date_trunc("month", a) == F.date_trunc("month", b)
    return F.when(a == b, "CORROBORATION").when(~exact, "TENSION").when(~named & month, "TENSION").otherwise("CONTRADICTION")


def pairwise(seen: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """Verdict for each pair of observations of equal keys, the earlier first.

    Pairs meet on an equi-join of all keys; callers choose keys that keep groups small.
    """
    right = seen.select(*keys, F.col(seq).alias("b"), F.col(value).alias("other"))
    j = seen.withColumnRenamed(seq, "a").join(right, keys).where("a < b")
    return j.withColumn("verdict", compare_values(F.col(value), F.col("other")))


def groups(pairs: DataFrame) -> DataFrame:
    """Component of every id of ``pairs(a, b)``, named by its smallest id."""
    return connected_components(pairs)


def batches(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """Batch number from 1 within keys, ``size`` rows each."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("batch", F.ceil(rn / F.lit(float(size))).cast("int"))


def gaps(units: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of consecutive unit numbers as key, first, last, n."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(number))
    g = units.withColumn("__run", F.col(number) - rn)
    return g.groupBy(key, "__run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("__run")


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Recall at k, reciprocal rank and binary nDCG at k of every query of ``gold``.

    ``ranked`` has query, id, rank (from 1); ``gold`` has query, id. A query without results
    scores 0.
    """
    size = gold.groupBy("query").agg(F.count("*").alias("n"))
    hit = ranked.join(gold, ["query", "id"], "left_semi")
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))
    per = hit.groupBy("query").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    j = size.join(per, "query", "left")
    return j.select(
        "query",
        (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )

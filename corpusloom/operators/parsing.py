"""Trigram search, set-similarity pairs and chunking of statutes and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigrams_of(text: str) -> list[str]:
    """Distinct trigrams of a text padded with two blanks before and one after."""
    padded = f"  {text.lower()} "
    return list(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))


def trigrams(text: Column) -> Column:
    """The same as a column."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_search(df: DataFrame, key: str, text: str, wanted: list[str], least: float) -> DataFrame:
    """Rows that hold at least a share of the wanted trigrams, with ``similarity``."""
    q = df.sparkSession.createDataFrame([(g,) for g in wanted], "gram string")
    hits = df.select(key, F.explode(trigrams(F.col(text))).alias("gram")).join(F.broadcast(q), "gram")
    per = hits.groupBy(key).agg((F.count("*") / F.lit(len(wanted))).alias("similarity"))
    return per.where(F.col("similarity") >= least)


def similar_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of rows (id, w: set of words) of Jaccard similarity ``least`` or more.

    Pairs meet on the rare words of each side (prefix filter by document frequency), then
    the whole sets are compared.
    """
    words = rows.select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    ranked = words.join(df, "word").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("all"))
    keep = (F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).cast("int")
    posts = ranked.select("id", "n", F.explode(F.slice("all", F.lit(1), keep)).alias("p")).select("id", "n", "p.word")
    right = posts.select(F.col("id").alias("b"), F.col("n").alias("m"), "word")
    near = (F.col("n") >= F.col("m") * least) & (F.col("m") >= F.col("n") * least)
    pairs = posts.withColumnRenamed("id", "a").join(right, "word").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    x, y = rows.select(F.col("id").alias("a"), F.col("w").alias("x")), rows.select(F.col("id").alias("b"), F.col("w").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common / (F.size("x") + F.size("y") - common) >= least).select("a", "b")


# Headings of articles and of parts of decisions, in Turkish statutes and decisions.
ARTICLE = r"(?m)^[ \t]*((?:Ek |Geçici |Mükerrer )?(?:MADDE|Madde)[ \t]+[0-9]+(?:/[A-Z])?)[ \t]*[-–—.]*"
SECTIONS = ["DAVA", "CEVAP", "GEREKÇE", "HÜKÜM", "SONUÇ", "KARŞI OY"]


def split_articles(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Articles of a statute: key, ordinal, heading, body; text before the first is ordinal 0."""
    marked = F.regexp_replace(F.col(text), ARTICLE, "\u0001$1\u0002")
    parts = docs.select(key, F.posexplode(F.split(marked, "\u0001")).alias("ordinal", "part"))
    headed = F.col("part").contains("\u0002")
    heading = F.when(headed, F.substring_index("part", "\u0002", 1))
    body = F.when(headed, F.split_part("part", F.lit("\u0002"), F.lit(2))).otherwise(F.col("part"))
    return parts.select(key, "ordinal", heading.alias("heading"), F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("body")).where("heading is not null or body <> ''")


def split_decision(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sections of a decision by their labels at line starts: key, ordinal, label, body."""
    labels = "|".join(SECTIONS)
    marked = F.regexp_replace(F.col(text), rf"(?m)^[ \t]*({labels})[ \t]*:", "\u0001$1\u0002")
    parts = docs.select(key, F.posexplode(F.split(marked, "\u0001")).alias("ordinal", "part"))
    headed = F.col("part").contains("\u0002")
    label = F.when(headed, F.substring_index("part", "\u0002", 1)).otherwise("PREAMBLE")
    body = F.when(headed, F.split_part("part", F.lit("\u0002"), F.lit(2))).otherwise(F.col("part"))
    return parts.select(key, "ordinal", label.alias("label"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body")).where("body <> ''")

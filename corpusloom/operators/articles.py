"""Articles of statutes: splitting, search and lone headings, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import cp_slice

# How articles are headed in marked-up and in plain texts.
MARKED = r"(?:^|\n)\s*\*{0,2}(?:(?:EK|Ek|GEÇİCİ|Geçici|MÜKERRER|Mükerrer)\s+)?(?:MADDE|Madde)\s+[0-9]+"
PLAIN = "(?:MADDE|Madde)\\s+[0-9]+(?:/[A-Z])?\\s*[.­]?\\s*[-–]?"
MARKED_PARTS = r"^\s*\*{0,2}(?:(EK|Ek|GEÇİCİ|Geçici|MÜKERRER|Mükerrer)\s+)?(?:MADDE|Madde)\s+([0-9]+)"
PLAIN_PARTS = r"^(?:MADDE|Madde)\s+([0-9]+(?:/[A-Z])?)"
KINDS = {"EK": "Ek", "GEÇİCİ": "Geçici", "MÜKERRER": "Mükerrer"}


def pieces(docs: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """Texts cut before each heading: key, ordinal (from 1) and piece; the head is dropped."""
    cut = F.split(F.regexp_replace(F.col(text), f"({heading})", "\u0001$1"), "\u0001")
    return docs.select(key, F.posexplode(cut).alias("ordinal", "piece")).where("ordinal > 0")


def split_marked(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Articles of a marked-up statute: key, ordinal, article, title and content."""
    p = pieces(docs, key, text, MARKED).withColumn("content", F.regexp_replace("piece", r"^\s+|\s+$", ""))
    kind, number = F.regexp_extract("content", MARKED_PARTS, 1), F.regexp_extract("content", MARKED_PARTS, 2)
    named = F.coalesce(F.create_map(*[F.lit(x) for k in KINDS.items() for x in k])[kind], kind)
    second = F.trim(F.coalesce(F.get(F.split("content", "\n"), F.lit(1)), F.lit("")))
    title = F.when(second.startswith("**") & second.endswith("**"), F.trim(F.regexp_replace(second, r"^\*+|\*+$", ""))).otherwise("")
    return p.select(key, "ordinal", F.when(kind == "", number).otherwise(F.concat_ws(" ", named, number)).alias("article"), title.alias("title"), "content")


def split_plain(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Articles of a plain text, which may be headed within a line: key, ordinal, article, content."""
    p = pieces(docs, key, text, PLAIN).withColumn("content", F.regexp_replace("piece", r"^\s+|\s+$", ""))
    return p.select(key, "ordinal", F.regexp_extract("content", PLAIN_PARTS, 1).alias("article"), "content")


def offsets(text: Column, term: str) -> Column:
    """Where a term starts in a text, in order; hits do not overlap."""
    gaps = F.transform(F.split(text, re.escape(term)), lambda x: F.length(x))
    before = F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0)))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    walked = F.aggregate(before, first, lambda s, n: F.struct((s["at"] + n + len(term)).alias("at"), F.concat(s["all"], F.array(s["at"] + n)).alias("all")))
    return walked["all"]


def search(articles: DataFrame, key: str, terms: Sequence[str], without: Sequence[str] = (), every: bool = True, around: int = 100) -> DataFrame:
    """Articles that hold every term (or any), and none of ``without``, in any case.

    Gives key, ordinal, article, hits of all terms, n_terms held, the text around the earliest
    hit with dots where it is cut, and the rank within the key: more terms, more hits, earlier.
    """
    low = F.lower("content")
    rows = articles.withColumns({f"__at{i}": offsets(low, t.lower()) for i, t in enumerate(terms)})
    held = [F.size(f"__at{i}") > 0 for i in range(len(terms))]
    kept = reduce(and_ if every else or_, held)
    for t in without:
        kept = kept & ~low.contains(t.lower())

    def spans(i: int, size: int) -> Column:
        return F.transform(f"__at{i}", lambda x: F.struct(x.alias("start"), (x + size).alias("end")))

    hit = F.array_min(F.concat(*[spans(i, len(t)) for i, t in enumerate(terms)]))
    start, end = F.greatest(hit["start"] - around, F.lit(0)), F.least(hit["end"] + around, F.length("content"))
    dots = lambda cut: F.when(cut, "...").otherwise("")
    preview = F.concat(dots(start > 0), cp_slice(F.col("content"), start, end), dots(end < F.length("content")))
    hits = sum(F.size(f"__at{i}") for i in range(len(terms)))
    found = rows.where(kept).select(key, "ordinal", "article", hits.alias("hits"), sum(h.cast("int") for h in held).alias("n_terms"), preview.alias("preview"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_terms"), F.desc("hits"), "ordinal")))


def lone(articles: DataFrame, key: str) -> DataFrame:
    """One row a heading: its number of occurrences, and the text only where that is 1."""
    found = articles.groupBy(key, "article").agg(F.count("*").alias("n"), F.min("content").alias("one"))
    return found.select(key, "article", "n", F.when(F.col("n") == 1, F.col("one")).alias("content"))

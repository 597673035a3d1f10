"""Boolean text search from given terms, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import occurrences


def search(docs: DataFrame, terms: Iterable[tuple[str, str, int]], text: str = "text") -> DataFrame:
    """Documents that match, with ``score``: weighted occurrences of the wanted terms.

    ``terms`` are (AND, OR or NOT, term, weight), applied from left to right.
    """
    low = F.lower(text)
    hit: Column | None = None
    score: Column = F.lit(0)
    for operator, term, weight in terms:
        has = low.contains(term.lower())
        if operator == "NOT":
            hit = ~has if hit is None else hit & ~has
            continue
        hit = has if hit is None else hit | has if operator == "OR" else hit & has
        score = score + occurrences(low, term.lower()) * weight
    return docs.where(F.lit(False) if hit is None else hit).withColumn("score", score)

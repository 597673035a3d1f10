"""Column expressions on vectors and rankings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for unequal lengths and zero vectors."""
    fine = (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fine, dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    """The vector scaled to length one; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def bm25_idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)) with N at least df."""
    total = F.greatest(n, df)
    return F.log1p((total - df + 0.5) / (df + 0.5))


def rrf(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    """Reciprocal rank share of one lane; 0 where the lane has no rank."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))


def band(score: Column, near: float = 0.8, middle: float = 0.5) -> Column:
    """Similarity band by two floors."""
    return F.when(score >= near, "near").when(score >= middle, "middle").otherwise("far")

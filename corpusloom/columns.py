"""Columns picked by their exact names, whatever else a table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns ``names``; others that differ by case or hold dots do not disturb."""
    at = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    lower = {n.lower(): i for n, i in at.items()}
    safe = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return safe.select(*[F.col(f"_{at.get(n, lower.get(n.lower()))}").alias(n) for n in names])

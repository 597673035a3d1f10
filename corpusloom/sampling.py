"""Bounded samples that need no sort and little of the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, rows: int, columns: list[str], n: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df``, at most twice as many, alike in every run.

    Rows are taken by the hash of ``columns``; ``n`` is the number of rows, if known. Each
    task sends on its share of the sample only.
    """
    n = df.count() if n is None else n
    step = max(1, n // rows)
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(step)) == 0).limit(2 * rows)

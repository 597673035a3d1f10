"""Failures of single rows, kept as rows.

Parsing steps are column expressions that cannot raise (``try_`` functions, conditions); each
names a reason for the rows that it can't do. A row's result is a struct with either ``ok`` or
``err``, so one scan gives both outputs and one bad row stops nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from corpusloom.storage import shared_dir


def attempt(parsed: Column, problems: Sequence[tuple[str, Column, Column]]) -> Column:
    """Struct of ``ok`` (``parsed``) and ``err`` (reason, detail); exactly one is set.

    ``problems`` are (reason, condition, detail); the first condition that holds, or is null,
    decides.
    """
    reason, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, bad, what in reversed(problems):
        holds = F.coalesce(bad, F.lit(True))
        reason = F.when(holds, F.lit(name)).otherwise(reason)
        detail = F.when(holds, what.cast("string")).otherwise(detail)
    err = F.when(reason.isNotNull(), F.struct(reason.alias("reason"), detail.alias("detail")))
    return F.struct(F.when(reason.isNull(), parsed).alias("ok"), err.alias("err"))


def isolate(rows: DataFrame, parsed: Column, problems: Sequence[tuple[str, Column, Column]], keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` and ``result`` for every row."""
    return rows.select(*keep, attempt(parsed, problems).alias("result"))


def split(results: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows of ``results``, written once, side by side, in the shared folder.

    A rerun with the same name replaces both.
    """
    spark = results.sparkSession
    path = f"{shared_dir(spark)}/isolated-{name}"
    results.withColumn("failed", F.col("result.err").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(path)
    kinds = StructType([*results.schema.fields, StructField("failed", BooleanType())])
    both = spark.read.schema(kinds).parquet(path)
    keep = [c for c in results.columns if c != "result"]
    return both.where("not failed").select(*keep, "result.ok.*"), both.where("failed").select(*keep, "result.err.*")

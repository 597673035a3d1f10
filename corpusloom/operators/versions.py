"""Bitemporal versions: closing periods, versions in force, as-of and range joins."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.temporal import covers


def order_versions(orders: DataFrame) -> DataFrame:
    """Orders of a customer read as versions of a document."""
    return orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.to_date("o_orderdate").alias("valid_from"))


def close_previous(versions: DataFrame) -> DataFrame:
    """Closes open periods: valid_to becomes the next later start of the document (null: open).

    Versions that start on one day do not close each other, and a period that has an end
    already (column valid_to) keeps it.
    """
    later = Window.partitionBy("document_id").orderBy(F.unix_date("valid_from")).rangeBetween(1, Window.unboundedFollowing)
    to = F.min("valid_from").over(later)
    return versions.withColumn("valid_to", F.coalesce(F.col("valid_to"), to) if "valid_to" in versions.columns else to)


def in_force(versions: DataFrame, day: str) -> DataFrame:
    """Versions whose half-open period holds the day."""
    return versions.where(covers(F.col("valid_from"), F.col("valid_to"), F.lit(day).cast("date")))


def latest(df: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order; Spark limits groups before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def as_of_join(rows: DataFrame, versions: DataFrame, at: str) -> DataFrame:
    """All rows with the version of their document in force at ``at`` (null: none)."""
    v = versions.withColumnRenamed("document_id", "__document")
    on = (F.col("document_id") == F.col("__document")) & covers(F.col("valid_from"), F.col("valid_to"), F.col(at))
    return rows.join(v, on, "left").drop("__document")


def range_join(left: DataFrame, right: DataFrame, own: tuple[str, str], other: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open integer ranges that overlap.

    Ranges are dealt to bins of ``width``; a pair is made in the bin where its overlap
    begins, so none is made twice and no unbinned comparison is needed.
    """
    (a, b), (c, d) = own, other
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    x = left.where(F.col(a) < F.col(b)).withColumn("__bin", bins(a, b))
    y = right.where(F.col(c) < F.col(d)).withColumn("__bin", bins(c, d))
    j = x.join(y, "__bin").where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    return j.where(F.col("__bin") == F.floor(F.greatest(a, c) / width)).drop("__bin")


def for_tenant(df: DataFrame, column: str, tenant: Any) -> DataFrame:
    """Rows of one tenant only; without a tenant there are none."""
    return df.where(F.lit(False)) if tenant is None else df.where(F.col(column) == tenant)


def outcomes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Action for each incoming text: unchanged, reverted_content or new.

    ``incoming`` has document_id, content_sha256; ``stored`` also is_current.
    """
    known = stored.groupBy("document_id", "content_sha256").agg(F.max("is_current").alias("is_current"))
    j = incoming.join(known, ["document_id", "content_sha256"], "left")
    action = F.when(F.col("is_current").isNull(), "new").when(F.col("is_current"), "unchanged").otherwise("reverted_content")
    return j.withColumn("action", action).drop("is_current")

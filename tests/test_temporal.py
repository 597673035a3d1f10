"""Working days over the whole range of dates."""

import datetime as dt

from pyspark.sql import functions as F

from corpusloom.functions import temporal


def test_days_beyond_timestamps(spark):
    """Days whose microseconds pass a long have working days and recesses like any other."""
    near = [(dt.date(2024, 1, 1) + dt.timedelta(k) - dt.date(1970, 1, 1)).days for k in range(400)]
    # The calendar repeats after 400 years, which are 146097 days.
    far = 146_097 * 2_000
    days = spark.createDataFrame([(k,) for k in near], "k int").withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("k")))
    moved = days.withColumn("later", F.date_add("day", far))
    ahead = lambda c: F.datediff(temporal.next_workday(F.col(c)), F.col(c))
    got = moved.select("k", ahead("day").alias("a"), ahead("later").alias("b"), temporal.in_recess(F.col("day")).alias("c"), temporal.in_recess(F.col("later")).alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got) and {r["a"] for r in got} >= {0, 1, 2} and sum(r["c"] for r in got) == 43
    first = {r["k"]: r["a"] for r in got}
    assert first[near[0]] == 1 and first[near[0] + 5] == 2

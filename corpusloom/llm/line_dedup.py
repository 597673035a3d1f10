"""Line near-duplicates by an exact set-similarity join.

A line is the set of its lower-cased words, ordered by rarity in the corpus; prefix,
positional and length filters find candidates, whose sets are compared (``set_join``). A line
goes if an earlier line, by (id, hash of the text, line number), has a Jaccard similarity of
four fifths or more; the earlier line need not be kept itself. Lines with equal sets are
settled by an aggregation, so the join has each set once, at its earliest place.

Defined results: blank lines are never compared and stay; a line of any other length is
compared; null and empty texts stay as they are; a null id counts as earliest; rows equal in
id and text are one row and get one result; columns named n_lines and n_removed are replaced,
all others pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.set_join import SET, Params, doc_key, similar_sets, survey
from corpusloom.storage import checkpoint

#: What the registered query and the stage use.
ALL_LINES = Params()


def gone_lines(docs: DataFrame, p: Params) -> DataFrame:
    """Columns doc, t and gone: the numbers of the lines that go."""
    surveyed = survey(docs, p)
    near = similar_sets(docs, surveyed, p).withColumn("similar", F.lit(True))
    own = surveyed.where("doc is not null").select("doc", "t", F.explode(F.arrays_zip("number", "d1", "sig")).alias("x")).select("doc", "t", "x.*")
    place = F.struct("doc", F.shiftright("t", 32).alias("t"), "number")
    first = own.groupBy(*SET).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(*SET, "first")
    # A table of marks keeps the join below apart from the aggregation, so that a very common
    # line can be split over tasks.
    marks = checkpoint(first.join(near, SET, "full"))
    found = own.join(marks, SET).where(F.col("similar") | (place > F.col("first")))
    return found.groupBy("doc", "t").agg(F.collect_set("number").alias("gone"))


def dedup_lines(docs: DataFrame, p: Params = ALL_LINES) -> DataFrame:
    """All columns of ``docs`` with text without the lines that go, and n_lines, n_removed."""
    gone = gone_lines(docs, p).toDF("__doc", "__t", "__gone")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*columns, doc_key(p).alias("__doc"), F.xxhash64("text").alias("__t")).join(gone, ["__doc", "__t"], "left")
    # The one-element array binds the lines to a name, so that they are split once a text.
    left = F.transform(F.array(F.split("text", "\n")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "__gone"), lambda i: F.get(x, i)), "\n"))[0]
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_removed = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left).cast(docs.schema["text"].dataType)
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))

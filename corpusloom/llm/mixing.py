"""Mixing sources to target weights with exponential keys and token budgets.

All steps are DataFrame functions. Each document gets the key ``-ln(u) / weight`` with a
uniform ``u`` from its id, so that lower keys form a weighted sample without replacement.
A source's target is met by complete epochs of all its documents first, then by the
documents of lowest key whose sizes fit the rest of the budget. Prefix sums within a source
run over ranges of a range partitioning by source and key: totals of ranges first, then rows
within a range, so that a source of any size and any weights is spread over many tasks.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of
its own, last in order; null ids draw by their size; rows that are repeated get the same key,
are ordered by size and are taken one by one until the budget is met; a document of size 0 is
taken once an epoch; extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import checkpoint, materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Words of a text, without building them."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def uniform(id_col: str = "doc_id", seed: str = "mix", size: str = "size") -> Column:
    """A number in (0, 1) from an id (null: from the size), alike in every run and engine that has MD5."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.col(size).cast("string")))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def quality_weight(text: str = "text", size: str = "size") -> Column:
    """Weight in [0.25, 1] by how near the mean word length is to that of plain prose."""
    mean = F.length(F.coalesce(F.col(text), F.lit(""))).cast("double") / F.greatest(F.col(size), F.lit(1)).cast("double")
    return F.greatest(F.lit(0.25), F.lit(1.0) - F.abs(mean - F.lit(6.5)) / F.lit(20.0))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """Per source: source_size, n_rows and target, by weight up to ``most`` epochs.

    ``sized`` has source and size. The number of sources is that of a catalogue, and its
    ordering is a window over one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", pick.cast("long"))
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("source_size").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    from_here = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # A source is at its limit if, with all fuller ones at theirs, its share would pass it.
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("long") * (100 * most)
    left = (F.sum("source_size").over(everything) * percent).cast("long") - spent
    per = per.withColumns({"left": left, "open_weight": F.sum("weight").over(from_here).cast("long")})
    at_most = F.col("weight") * F.col("left") >= F.col("source_size") * (100 * most) * F.col("open_weight")
    per = per.withColumn("full", at_most)
    done = F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(everything), F.lit(0)).cast("long")
    open_weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything), F.lit(1)).cast("long")
    rest = (F.sum("source_size").over(everything) * percent).cast("long") - done * (100 * most)
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * rest).cast("double") / (open_weight * 100).cast("double"))
    return per.select("source", "source_size", "n_rows", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, weight, copies and taken.

    ``copies`` is how often the mix holds the document, ``taken`` the words of that.
    """
    columns = docs.columns
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    work = docs.select(row).select("row", F.col("row.source").alias("source"), F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    work = work.withColumn("size", word_count()).withColumn("quality", quality_weight()).drop("text")
    slim = checkpoint(work.select("source", "doc_id", "size", "quality"))
    plan = checkpoint(source_targets(slim, weights, percent, most))
    drawn = draw(slim, plan, seed)
    alike = drawn.groupBy("doc_id", "source", "size", "quality").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.count("*").alias("n"), F.sum("copies").alias("all"))
    # Rows alike in these are taken alike, but for those of one group a source at which its
    # budget ends: some of them are taken once more.
    alike = alike.select("*", F.floor(F.col("all") / F.col("n")).alias("copies")).withColumn("more", F.col("all") - F.col("copies") * F.col("n"))
    alike = checkpoint(alike)
    done = joined_rows(work, alike.where("more = 0"))
    if not alike.where("more > 0").isEmpty():
        done = done.drop("more").union(taken_once_more(checkpoint(joined_rows(work, alike.where("more > 0")))))
    else:
        done = done.drop("more")
    return done.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def joined_rows(work: DataFrame, alike: DataFrame) -> DataFrame:
    """Rows of ``work`` with the decision on those alike."""
    same = F.col("w.size") == F.col("d.size")
    for c in ("doc_id", "source", "quality"):
        same &= F.col(f"w.{c}").eqNullSafe(F.col(f"d.{c}"))
    joined = work.alias("w").join(alike.alias("d"), on=same)
    return joined.select("w.row", "w.size", "source_size", "target", "w.quality", F.col("copies").cast("long").alias("copies"), F.col("more").cast("long").alias("more"))


def taken_once_more(rows: DataFrame) -> DataFrame:
    """``rows`` with a copy more for the first ``more`` rows of each source, without ``more``.

    Rows are ordered by their hash; equal rows are numbered within the partitions that hold
    them, so that a row that repeats very often is numbered by many tasks.
    """
    rows = rows.withColumns({"source": F.col("row.source"), "hash": F.xxhash64("row"), "part": F.spark_partition_id()})
    counts = rows.groupBy("source", "hash", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("hash", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("hash").alias("h"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("source", "hash", "part").orderBy("copies"))
    numbered = rows.withColumn("nth", nth).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("hash") == F.col("h")) & (F.col("part") == F.col("p")))
    extra = F.when(F.col("before") + F.col("nth") <= F.col("more"), 1).otherwise(0)
    return numbered.select("row", "size", "source_size", "target", "quality", (F.col("copies") + extra).cast("long").alias("copies"))


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mix without its texts: doc_id, source, size, source_size, target, copies, taken."""
    slim = checkpoint(docs.select("source", "doc_id", "text").withColumn("size", word_count()).withColumn("quality", quality_weight()).drop("text"))
    return draw(slim, checkpoint(source_targets(slim, weights, percent, most)), seed)


def in_ranges(keyed: DataFrame) -> DataFrame:
    """``keyed``, written in ranges of source and key, with the number of the range in ``at``.

    Ranges are cut where the keys are, whatever their weights; ``row`` parts equal keys.
    """
    n_ranges = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = keyed.repartitionByRange(n_ranges, F.col("source").asc_nulls_last(), "key", "doc_id", "size", "quality", "row")
    return materialize(ranged.withColumn("at", F.spark_partition_id()))


def draw(slim: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows of ``slim`` (source, doc_id, size, quality) with source_size, target, copies, taken."""
    keyed = slim.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    keyed = keyed.select("s.*", "source_size", "n_rows", "target").withColumn("key", -F.log(uniform("doc_id", seed)) / F.col("quality"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - (epochs * F.col("source_size")).cast("double")
    keyed = keyed.withColumns({"epochs": epochs, "budget": rest, "row": F.monotonically_increasing_id()})
    keyed = in_ranges(keyed)
    totals = keyed.groupBy("source", "at").agg(F.sum("size").cast("long").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "at", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).cast("long").alias("before"))
    rows = keyed.alias("k").join(totals.alias("t"), F.col("k.source").eqNullSafe(F.col("t.source")) & (F.col("k.at") == F.col("t.at")))
    within = Window.partitionBy("k.source", "k.at").orderBy("key", "doc_id", "size", "quality", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("size").over(within)
    # The document that crosses the budget is taken if that ends nearer to it.
    fits = (F.col("size") > 0) & (upto.cast("double") - F.col("size").cast("double") / 2.0 <= F.col("budget"))
    rows = rows.select("k.source", "doc_id", "size", "quality", "source_size", "target", (F.col("epochs") + F.when(fits, 1).otherwise(0)).cast("long").alias("copies"))
    return rows.withColumn("taken", F.col("copies") * F.col("size"))

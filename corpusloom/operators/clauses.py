"""Clause trees of numbered texts, by windows over headings.

Lines that start with a marker are headings: a word for article or section and a number, or a
number followed by a full stop, a bracket or a dash, or a number of several parts before a
capital. Dates, amounts and quantities are not. The parent of a heading is the last one before
it of a lower level that no heading of that or a lower level has closed. For every level, one
running maximum holds its last heading; the open ones among them are the ancestors. No text is
taken apart a second time and no list grows with a document, so a text of any length costs one
sort of its headings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers have at most so many parts; a line with more is text.
LEVELS = 6
NUMBER = rf"\d{{1,3}}(?:\.\d{{1,3}}){{0,{LEVELS - 1}}}"
# Words that announce a numbered clause, and units that make a number a quantity.
WORDS = ("MADDE", "Madde", "Md", "ARTICLE", "Article", "Art", "SECTION", "Section", "Clause", "CLAUSE", "§")
UNITS = ("gün", "ay", "yıl", "yil", "saat", "hafta", "dakika", "tl", "try", "usd", "eur", "euro", "adet", "kat", "m2", "m²", "metrekare", "%", "days", "months", "years", "hours", "weeks")
NAMED = rf"^\s*(?:{'|'.join(WORDS)})\.?\s*({NUMBER})(?![\d\p{{L}}'’])\s*[.):\-–—]?\s*(.*)$"
BARE = rf"^\s*({NUMBER})(?:\.(?=\s|$|[\p{{L}}\"“'‘(])|\s*[)\-–—](?=\s|$|[\p{{L}}\"“'‘(]))\s*(.*)$"
PARTED = rf"^\s*(\d{{1,3}}(?:\.\d{{1,3}}){{1,{LEVELS - 1}}})\s+(?=[\p{{Lu}}\"“(])(.*)$"
DATE = r"^\s*\d{1,2}[./]\d{1,2}[./]\d{2,4}"
QUANTITY = rf"(?i)^(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
# One numbering alone: white space, the number before its full stop, and units in letters of any case.
WHITE = r"[\t\n\f\r ]"
STOPPED = rf"^{WHITE}*{NUMBER}\.(?:{WHITE}|\z|[\p{{L}}\"“'‘(])"
ANY_CASE = str.maketrans({"k": "[k\u212a]", "s": "[s\u017f]", "ü": "[üÜ]"})
AMOUNT = rf"(?i)^(?:{'|'.join(UNITS).translate(ANY_CASE)})(?![\p{{L}}\p{{N}}])"


def marker(line: Column) -> Column:
    """Struct of number and rest of a heading line; null for other lines."""
    bare = F.when(line.rlike(BARE), F.struct(F.regexp_extract(line, BARE, 1).alias("number"), F.trim(F.regexp_extract(line, BARE, 2)).alias("rest"))).when(
        line.rlike(PARTED), F.struct(F.regexp_extract(line, PARTED, 1).alias("number"), F.trim(F.regexp_extract(line, PARTED, 2)).alias("rest"))
    )
    plain = ~line.rlike(DATE) & ~bare["number"].rlike(r"\.\d{3}") & ~bare["rest"].rlike(QUANTITY)
    named = F.struct(F.regexp_extract(line, NAMED, 1).alias("number"), F.trim(F.regexp_extract(line, NAMED, 2)).alias("rest"))
    return F.when(line.rlike(NAMED), named).when(plain, bare)


def full_stop(line: Column) -> Column:
    """Struct of number and rest of a line that starts with a number and a full stop; null for other lines.

    For texts of one known numbering, where other markers, dates and addresses are text.
    """
    after = F.regexp_replace(line, rf"^{WHITE}*[0-9.]+{WHITE}*", "")
    number = F.regexp_extract(line, rf"^{WHITE}*([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(line.rlike(STOPPED) & ~after.rlike(AMOUNT), F.struct(number.alias("number"), trimmed(after).alias("rest")))


def trimmed(line: Column) -> Column:
    """``line`` without blanks of any width at its ends."""
    return F.regexp_replace(line, r"^\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z", "")


def is_caption(line: Column) -> Column:
    """A short line of capitals: a title or section name, not a sentence."""
    return line.rlike(r"(?s)\p{L}.*\p{L}") & ~line.rlike(r"\p{Ll}") & (F.length(trimmed(line)) <= 100)


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: Callable[[Column], Column] = marker) -> DataFrame:
    """A row a heading, as ``mark`` finds them: key, line (from 0), start, number, level, rest, caption (the line above).

    Offsets are code points, summed up from the sizes of lines; texts stay in the scan.
    """
    rows = docs.select(F.col(key).alias("key"), F.length(text).alias("total"), F.posexplode(F.split(text, "\n")).alias("line", "body"))
    order = Window.partitionBy("key").orderBy("line")
    start = F.coalesce(F.sum(F.col("size") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slim = rows.select("key", "total", "line", F.length("body").alias("size"), mark(F.col("body")).alias("m"), F.when(is_caption(F.col("body")), trimmed(F.col("body"))).alias("caption"), F.col("body").rlike(r"[^\p{Zs}]").alias("filled"))
    placed = slim.withColumn("start", start.cast("long")).where("filled")
    above = F.when(F.lag("m").over(order).isNull(), F.lag("caption").over(order))
    return placed.withColumn("above", above).where("m is not null").select(
        "key", "total", "line", "start", F.col("m.number").alias("number"), F.size(F.split("m.number", r"\.")).alias("level"), F.col("m.rest").alias("rest"), F.col("above").alias("caption")
    )


def tree(found: DataFrame) -> DataFrame:
    """``found`` with clause (from 1), parent, path, depth, stop, subtree_stop, title, section.

    ``stop`` ends a clause's own text, ``subtree_stop`` that of its last descendant. A caption
    above a numbering that starts again is a section and names the clauses below it; any other
    caption is the title of its clause.
    """
    order = Window.partitionBy("key").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    rows = found.withColumn("clause", F.row_number().over(order))
    last = {n: F.max(F.when(F.col("level") == n, F.struct("clause", "number"))).over(before) for n in range(1, LEVELS + 1)}
    coming = {n: F.min(F.when(F.col("level") == n, F.col("start"))).over(after) for n in range(1, LEVELS + 1)}
    top = F.when(F.col("level") == 1, F.col("number").cast("int"))
    rows = rows.withColumns(
        {f"last{n}": c for n, c in last.items()} | {f"next{n}": c for n, c in coming.items()} | {"next": F.lead("start").over(order), "top": top, "last_top": F.last(top, ignorenulls=True).over(before)}
    )
    closed = F.lit(0)
    chain = []
    for n in range(1, LEVELS + 1):
        at = F.coalesce(F.col(f"last{n}.clause"), F.lit(0))
        chain.append(F.when((F.col("level") > n) & (at > closed), F.col(f"last{n}")))
        closed = F.greatest(closed, at)
    rows = rows.withColumn("chain", F.filter(F.array(*chain), lambda x: x.isNotNull()))
    own = F.array(*[F.when(F.col("level") >= n, F.col(f"next{n}")) for n in range(1, LEVELS + 1)])
    restart = F.col("caption").isNotNull() & F.col("top").isNotNull() & ((F.col("top") == 1) | F.coalesce(F.col("top") <= F.col("last_top"), F.lit(False))) & (F.col("clause") > 1)
    title = F.when(F.col("caption").isNotNull() & ~restart & (F.col("clause") > 1), F.col("caption")).when(is_caption(F.col("rest")), F.col("rest"))
    rows = rows.withColumn("named", F.when(restart, F.col("caption")))
    return rows.select(
        "key", "clause", "line", "number", "level", F.get("chain", F.size("chain") - 1)["clause"].alias("parent"),
        F.array_join(F.concat(F.transform("chain", lambda x: x["number"]), F.array("number")), "/").alias("path"), (F.size("chain") + 1).alias("depth"),
        "start", F.coalesce(F.col("next"), F.col("total").cast("long")).alias("stop"), F.coalesce(F.array_min(own), F.col("total").cast("long")).alias("subtree_stop"),
        title.alias("title"), F.last("named", ignorenulls=True).over(order).alias("section"),
    )


def clause_tree(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: Callable[[Column], Column] = marker) -> DataFrame:
    """Clauses of all texts; those without headings, null or empty ones have none."""
    return tree(headings(docs.where(F.col(text).rlike(r"\d|§")), key, text, mark))

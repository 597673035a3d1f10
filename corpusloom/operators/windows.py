"""The part of a text that says most on a question, and sets of passages that cover it.

Quote windows: matched words are marked in the scan; only the lengths between them are shuffled,
and a running sum turns them into positions. A range frame around each position counts the
matches of the window that starts a third before it.

Coverage caps: passages are bit sets of the question's words. Of the passages beyond the cap,
those with equal sets are one, the first, as no other can ever be taken in; so a group holds the
cap and one row a distinct set, however many passages it has.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.grouping import map_groups

LETTER = r"\p{L}\p{M}\p{N}"


def match_positions(docs: DataFrame, questions: Sequence[tuple[int, Sequence[str]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Code point positions of a question's words: key, question, total, pos.

    Words match as a whole, in any case.
    """
    marked = [
        F.struct(F.lit(q).alias("question"), F.split(F.regexp_replace(text, rf"(?iu)(?<![{LETTER}])(?:{'|'.join(words)})(?![{LETTER}])", "\u0001$0\u0002"), "\u0001").alias("parts"))
        for q, words in questions
    ]
    rows = docs.select(F.col(key).alias("key"), F.length(text).cast("long").alias("total"), F.explode(F.array(*marked)).alias("m")).select("key", "total", "m.question", F.posexplode("m.parts").alias("part", "body"))
    slim = rows.select("key", "total", "question", "part", (F.length("body") - F.when(F.contains("body", F.lit("\u0002")), 1).otherwise(0)).alias("size"))
    before = Window.partitionBy("key", "question").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return slim.withColumn("pos", F.sum("size").over(before).cast("long")).where("part > 0").select("key", "question", "total", "pos")


def best_windows(positions: DataFrame, most: int) -> DataFrame:
    """The window of ``most`` code points with most matches: key, question, start, matches.

    Ties go to the earlier window. Windows start a third before a match, but never pass the
    ends of the text.
    """
    lead = most // 3
    own = Window.partitionBy("key", "question")
    around = own.orderBy("pos").rangeBetween(-lead, most - lead - 1)
    last = F.greatest(F.col("total") - most, F.lit(0))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - lead, last))
    head, tail = F.count_if(F.col("pos") < most).over(own), F.count_if(F.col("pos") >= last).over(own)
    matches = F.when(F.col("pos") - lead <= 0, head).when(F.col("pos") - lead >= last, tail).otherwise(F.count("*").over(around))
    scored = positions.select("key", "question", start.alias("start"), matches.alias("matches"))
    best = F.max(F.struct("matches", (-F.col("start")).alias("back")))
    return scored.groupBy("key", "question").agg(best.alias("b")).select("key", "question", (-F.col("b.back")).alias("start"), F.col("b.matches").alias("matches"))


def snapped(text: Column, start: Column, most: int) -> Column:
    """Struct of start, end and quote: the window without words it cuts, trimmed.

    A window without any whole word stays as it is.
    """
    raw = F.substring(text, start + 1, F.lit(most))
    cut_front = (start > 0) & F.substring(text, start, F.lit(1)).rlike(r"\S")
    front = F.when(cut_front, F.length(F.regexp_extract(raw, r"^\S*", 0))).otherwise(0)
    after = F.substring(text, start + most + 1, F.lit(1))
    cut_back = after.rlike(r"\S")
    back = F.when(cut_back, F.length(F.regexp_extract(raw, r"\S*\z", 0))).otherwise(0)
    inner = F.substring(raw, front + 1, F.greatest(F.lit(0), F.length(raw) - front - back))
    skipped = F.length(F.regexp_extract(inner, r"^\s*", 0))
    body = F.regexp_replace(inner, r"\A\s+|\s+\z", "")
    at = start + front + skipped
    whole = F.struct(start.cast("long").alias("start"), (start + F.length(raw)).cast("long").alias("end"), raw.alias("quote"))
    return F.when(body == "", whole).otherwise(F.struct(at.cast("long").alias("start"), (at + F.length(body)).cast("long").alias("end"), body.alias("quote")))


def quote_windows(docs: DataFrame, questions: Sequence[tuple[int, Sequence[str]]], most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text against every question: key, question, start, end, matches, quote.

    Texts within ``most`` are quoted whole; without a match the head is; null texts have none.
    """
    best = best_windows(match_positions(docs, questions, key, text), most)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.explode(F.array(*[F.lit(q) for q, _ in questions])).alias("question"))
    found = rows.join(best, ["key", "question"], "left")
    start = F.coalesce("start", F.lit(0)).cast("int")
    short = F.length("text") <= most
    part = F.when(short, F.struct(F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.col("text").alias("quote"))).otherwise(snapped(F.col("text"), start, most))
    return found.select("key", "question", part.alias("p"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches")).select("key", "question", "p.start", "p.end", "matches", "p.quote")


def words_among(text: Column, asked: Sequence[str]) -> Column:
    """The words of ``asked`` (runs of letters) that are whole runs of letters in ``text``, each once.

    No other word of the text is cut out. A letter may take two places of a Java string, so the
    lookbehind goes back two.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!\p{{L}}{{1,2}})({'|'.join(asked)})(?!\p{{L}})"), F.lit(1)))


def lexeme_bits(words: Column, question: Column) -> Column:
    """The question's words (63 at most) that ``words`` holds, as bits of a long.

    In an array of one ``words`` has a name, so that it is worked out once, not once a question's word.
    """

    def bits(held: Column) -> Column:
        each = F.transform(F.slice(question, 1, 63), lambda w, i: F.when(F.array_contains(held, w), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return F.get(F.transform(F.array(words), bits), F.lit(0))


def swap_for_coverage(kept: list[tuple[int, int, bool]], spare: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs (rank taken in, rank put out) for kept (rank, bits, pinned) and spare (rank, bits).

    The first spare with a word that no kept row has takes the place of the last kept row whose
    words others have too. A row put out is never needed again, as nothing it had is lost.
    """
    kept, swaps = list(kept), []
    for rank, bits in spare:
        union = 0
        for _, b, _ in kept:
            union |= b
        if not bits & ~union:
            continue
        # Bits that two kept rows have are the ones a row may lose.
        once = twice = 0
        for _, b, _ in kept:
            twice |= once & b
            once |= b
        at = next((i for i in range(len(kept) - 1, -1, -1) if not kept[i][2] and not kept[i][1] & ~twice), None)
        if at is None:
            break
        swaps.append((rank, kept[at][0]))
        kept[at] = (rank, bits, False)
    return swaps


def coverage_cap(rows: DataFrame, cap: int, group: str = "group_id") -> DataFrame:
    """``rows`` (group, rank from 1, bits, pinned) with ``kept`` and ``swapped``.

    The first ``cap`` ranks of each group are kept, but rows with words that none of them has
    replace the last ones that add nothing. Ranks are unique in a group. ``rows`` are met in
    the same form for the swaps and for the result, so that Spark reads and ranks them once.
    """
    kind = rows.schema[group].dataType.simpleString()
    # Ranks within the cap stay rows of their own; rows without words can only be among them.
    own = F.when(F.col("rank") <= cap, F.col("rank"))
    held = rows.where((F.col("rank") <= cap) | (F.col("bits") != 0)).groupBy(group, "bits", own.alias("own"))
    held = held.agg(F.min("rank").alias("rank"), F.bool_or(F.col("pinned") & (F.col("rank") <= cap)).alias("pinned")).select(group, "rank", "bits", "pinned")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, part in frame.sort_values([group, "rank"]).groupby(group, sort=False):
            held = [(r, b, bool(p)) for r, b, p in zip(part["rank"].tolist(), part["bits"].tolist(), part["pinned"].tolist(), strict=True)]
            for taken, put in swap_for_coverage([h for h in held if h[0] <= cap], [h[:2] for h in held if h[0] > cap]):
                out += [(g, taken, True), (g, put, False)]
        return pd.DataFrame(out, columns=[group, "rank", "taken"])

    swaps = map_groups(held, group, work, f"{group} {kind}, rank bigint, taken boolean")
    # A row that was taken in may be put out again by a later one.
    settled = swaps.groupBy(group, "rank").agg(F.min("taken").alias("taken"))
    done = rows.join(settled, [group, "rank"], "left")
    return done.withColumns({"kept": F.coalesce("taken", F.col("rank") <= cap), "swapped": F.col("taken").isNotNull()}).drop("taken")

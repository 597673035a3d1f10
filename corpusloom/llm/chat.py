"""Quotation linking for chat and mail threads, with DataFrame functions only.

Lines that start with ``>`` marks are quotations; the number of marks is their level. Runs
of lines of one level between blank lines are passages. Passages are normalised (lower case,
letters and digits only, single spaces) and hashed. A quoted passage belongs to the earliest
message of its conversation that holds the passage as its own words; a message answers the
latest message that it quotes at the first level (or, if none of those is known, at deeper
ones). Conversations come in reply order: by thread, then depth, then turn, without quotes.

Only messages with a ``>`` are taken apart line by line; the others are one expression over
the whole text.

Defined results: a message without quotations keeps its text; of one with quotations the own
lines stay as they are, without the line that announces a quotation ("On Monday, Ann wrote:")
and without blank lines at either end. Null or empty text has no passages; passages without a
letter or digit are not linked; a null conversation or turn is never linked; a message that
quotes nothing known starts a thread of its own; rows that repeat a conversation and turn
answer alike; only earlier turns are answered; extra columns are kept (those named n_quoted,
max_level, n_linked, reply_to, thread_turn or depth are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import checkpoint

MARKS = r"^((?:[ \t]*>)+)"
#: Line feeds with nothing but blanks between them part passages.
GAP = "\n[ \t]*\n\\s*"
#: A line that announces a quotation: a word for writing before a colon at its end.
ANNOUNCED = r"(?i)\b(?:wrote|writes|said|schrieb|écrit|escribió)\b.{0,80}:\s*$"
MADE = ("n_quoted", "max_level", "n_linked", "reply_to", "thread_turn", "depth")


def plain(text: Column) -> Column:
    """Text with line feeds only and without the two marks that are used inside."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\u0001\u0002", "  ")


def quotes(text: Column) -> Column:
    """Whether a text can hold quotations at all."""
    return F.coalesce(F.contains(text, F.lit(">")), F.lit(False))


def level(line: Column) -> Column:
    """Number of quote marks that a line starts with."""
    return F.when(F.ltrim(line).startswith(">"), F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[ \t]", ""))).otherwise(0)


def body(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, MARKS, ""))


def normal(text: Column) -> Column:
    """Lower case, runs of other than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def marked(text: Column) -> Column:
    """Lines of a text as (level, body, line)."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(level(x).alias("level"), body(x).alias("body"), x.alias("line")))


def runs(lines: Column) -> Column:
    """Array of (level, body) of marked lines: runs of one level, parted at blank lines."""

    def line(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        parted = (i > 0) & ((before["level"] != x["level"]) | (before["body"] == "") | (x["body"] == ""))
        return F.concat(F.when(parted, F.lit("\u0001")).otherwise(F.lit("")), x["level"].cast("string"), F.lit("\u0002"), x["body"])

    found = F.split(F.array_join(F.transform(lines, line), "\n"), "\u0001")
    made = F.transform(found, lambda x: F.struct(F.substring_index(x, "\u0002", 1).cast("int").alias("level"), F.regexp_replace(x, "(?m)^[0-9]+\u0002", "").alias("body")))
    return F.filter(made, lambda x: F.trim(x["body"]) != "")


def bound(value: Column, make) -> Column:
    """``make`` of a value that is worked out once: lambdas take it from an array of one."""
    return F.transform(F.array(value), make)[0]


def passages(text: str = "text") -> Column:
    """Array of (level, hash) of the passages that can be linked."""
    clean = plain(F.col(text))
    hashed = lambda at: lambda x: F.struct(at(x).alias("level"), F.when(x["n"] != "", F.sha2(x["n"], 256)).alias("hash"))
    deep = F.transform(bound(marked(clean), runs), lambda x: F.struct(x["level"].alias("level"), normal(x["body"]).alias("n")))
    whole = F.regexp_replace(F.lower(F.regexp_replace(clean, GAP, "\u0001")), "[^\\p{L}\\p{N}\u0001]+", " ")
    flat = F.transform(F.split(whole, "\u0001"), lambda x: F.struct(F.lit(0).alias("level"), F.trim(x).alias("n")))
    return F.filter(F.transform(F.when(quotes(F.col(text)), deep).otherwise(flat), hashed(lambda x: x["level"])), lambda x: x["hash"].isNotNull())


def reply_links(messages: DataFrame) -> DataFrame:
    """Columns conv_id, turn, reply_to, n_linked: which earlier turn each message answers."""
    spread = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(passages()).alias("p"))
    spread = spread.select("conv_id", "turn", "p.level", "p.hash")
    quoted = spread.where("level > 0").groupBy("conv_id", "turn", "hash").agg(F.min("level").alias("level"))
    origin = spread.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    linked = quoted.join(origin, ["conv_id", "hash"]).where("origin < turn")
    return linked.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin")).alias("reply_to"), F.count("*").alias("n_linked")
    )


def threads(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Columns conv_id, turn, thread_turn, depth for answering messages, by doubling steps."""
    state = checkpoint(links.select("conv_id", "turn", F.col("reply_to").alias("thread_turn"), F.lit(1).cast("long").alias("depth")))
    for _ in range(max_rounds):
        up = state.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("next"), F.col("depth").alias("more"))
        joined = state.join(up, ["conv_id", "thread_turn"], "left")
        moved = F.col("next").isNotNull().alias("moved")
        step = joined.select("conv_id", "turn", F.coalesce("next", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), moved)
        step = checkpoint(step)
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            return state
    raise RuntimeError(f"threads deeper than 2 to the power {max_rounds}")


def own_lines(lines: Column) -> Column:
    """The lines that are no quotation, as they stand, and do not announce one."""

    def own(x: Column, i: Column) -> Column:
        follows = F.when(F.get(lines, i + 1)["body"] == "", F.get(lines, i + 2)["level"]).otherwise(F.get(lines, i + 1)["level"])
        return (x["level"] == 0) & ~(F.coalesce(follows > 0, F.lit(False)) & F.regexp_like(x["line"], F.lit(ANNOUNCED)))

    text = F.array_join(F.transform(F.filter(lines, own), lambda x: x["line"]), "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\A(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+\z", "")


def build_conversations(messages: DataFrame) -> DataFrame:
    """Messages without quotations, with their place in the reply order.

    Adds text (own words only), n_quoted (quoted passages), max_level, n_linked, reply_to,
    thread_turn and depth; sort by conv_id, thread_turn, depth, turn to read conversations.
    """
    links = checkpoint(reply_links(messages.select("conv_id", "turn", "text")))
    placed = links.join(threads(links), ["conv_id", "turn"])
    rows = messages.drop(*[c for c in messages.columns if c in MADE])

    def taken_apart(lines: Column) -> Column:
        quoted = F.filter(runs(lines), lambda x: x["level"] > 0)
        return F.struct(own_lines(lines).alias("text"), F.size(quoted).cast("long").alias("n"), F.coalesce(F.array_max(F.transform(lines, lambda x: x["level"])), F.lit(0)).alias("level"))

    parts = F.when(quotes(F.col("text")), bound(marked(plain(F.col("text"))), taken_apart))
    rows = rows.withColumn("__parts", parts)
    some = F.coalesce(F.col("__parts.level") > 0, F.lit(False))
    rows = rows.withColumns(
        {"text": F.when(some, F.col("__parts.text")).otherwise(F.col("text")), "n_quoted": F.coalesce("__parts.n", F.lit(0)).cast("long"), "max_level": F.coalesce("__parts.level", F.lit(0))}
    ).drop("__parts")
    done = rows.join(placed, ["conv_id", "turn"], "left")
    return done.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "thread_turn": F.coalesce("thread_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long")})

"""Relations between texts: mentions of titles, resolved to the one document they mean.

A mention is a line of words; an entry is a title that one or more documents bear. Entries are
found through blocking keys (the first and the last words of a line), scored by several signals
and ranked. A mention is resolved if its best entry scores enough, leads the next one by a
margin and belongs to a single other document; all other mentions are kept with a reason.

Equal lines are scored once and equal titles are one entry, so copies make no pairs of their
own. Lines are told apart by two hashes of 64 bits, and only the texts of lines that meet an
entry go on to be scored, as sets of hashed words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of the signals in a score, which add up to one.
SHARES = {"overlap": 0.6, "length": 0.2, "head": 0.1, "tail": 0.1}
#: Entries of a block that a mention meets in one row.
BUNDLE_SIZE = 64
#: Stands for the words of a line.
ID = ["h1", "h2"]


def line_words(line: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 4) -> DataFrame:
    """Lines of at least ``least`` words: key, line (from 0), nth (among them, from 0), words."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), line_words(x).alias("words")))
    rows = docs.select(F.col(key).alias("key"), F.posexplode(F.filter(every, lambda x: F.size(x["words"]) >= least)).alias("nth", "x"))
    return rows.select("key", "x.line", "nth", "x.words")


def identified(rows: DataFrame, span: int = 3) -> DataFrame:
    """``rows`` with h1, h2 and blocks of ``words``, unless they have them."""
    if "blocks" in rows.columns:
        return rows
    return rows.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words"), "blocks": blocking_keys(F.col("words"), span)})


def entries(titles: DataFrame) -> DataFrame:
    """Distinct titles (key, words) as entries: words, n_bearers, least and greatest bearer."""
    return titles.groupBy("words").agg(F.count_distinct("key").alias("n_bearers"), F.min("key").alias("low"), F.max("key").alias("high"))


def blocking_keys(words: Column, span: int) -> Column:
    """The first and the last ``span`` words, marked by their end."""
    head, tail = F.slice(words, 1, span), F.slice(words, -span, span)
    return F.array(F.concat(F.lit("<"), F.array_join(head, " ")), F.concat(F.lit(">"), F.array_join(tail, " ")))


def shape(words: Column) -> dict[str, Column]:
    """What a score takes of a list of words: its hashed distinct words and its length."""
    return {"bag": F.transform(F.array_distinct(words), lambda w: F.xxhash64(w)), "n": F.size(words)}


def score(a: Column, b: Column, shared: Column) -> Column:
    """Similarity of two structs of blocks, bag and n: shared words, lengths, and equal ends.

    Binary fractions are rounded as they are, in the order of the terms, so that halves fall as in SQL.
    """
    signals = {
        "overlap": (shared, F.size(a["bag"]) + F.size(b["bag"]) - shared),
        "length": (F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])),
        "head": ((a["blocks"][0] == b["blocks"][0]).cast("double"), F.lit(1)),
        "tail": ((a["blocks"][1] == b["blocks"][1]).cast("double"), F.lit(1)),
    }
    return F.round(sum(F.lit(share) * signals[k][0] / signals[k][1] for k, share in SHARES.items()) * 1e6) / 1e6


def candidates(mentioned: DataFrame, named: DataFrame, span: int = 3, most: int = 3, texts: DataFrame | None = None) -> DataFrame:
    """For distinct ``words``, with their h1 and h2: ``found``, the best entries, best first.

    Three are enough to decide: the best, its rival, and one more if a mention's own title is
    among them. The entries of a block are dealt over bundles by their number; a mention meets
    whole bundles, over as many tasks, and takes the best of each, so pairs are scored in
    passing and never written. ``texts`` (h1, h2, words) may hold the lines once more, and
    others, where ``mentioned`` is dear to work out.
    """
    mentioned = identified(mentioned, span)
    right = identified(named, span).select(F.explode("blocks").alias("block"), *ID, "blocks", "words", "n_bearers", "low", "high")
    sizes = right.groupBy("block").agg(F.ceil(F.count("*") / BUNDLE_SIZE).cast("int").alias("n_bundles"))
    entry = F.struct(F.array_join("words", " ").alias("title"), *ID, "n_bearers", "low", "high", "blocks", *[c.alias(k) for k, c in shape(F.col("words")).items()])
    bundled = right.join(sizes, "block").groupBy("block", F.pmod("h1", "n_bundles").cast("int").alias("bundle")).agg(F.collect_list(entry).alias("entries"))
    met = mentioned.select(*ID, "blocks").distinct().select(*ID, F.explode("blocks").alias("block")).join(sizes, "block")
    met = met.select(*ID, "block", F.explode(F.sequence(F.lit(0), F.col("n_bundles") - 1)).alias("bundle"))
    # Lines travel as text, which takes a fourth of a list of words.
    lined = (mentioned if texts is None else texts).select(*ID, F.array_join("words", " ").alias("body")).join(met.select(*ID).distinct(), ID, "left_semi").dropDuplicates(ID)
    words = F.split("body", " ")
    own = lined.select(*ID, "body", F.struct(blocking_keys(words, span).alias("blocks"), *[c.alias(k) for k, c in shape(words).items()]).alias("own"))
    pairs = met.join(own, ID).join(bundled, ["block", "bundle"])
    shared = F.transform("entries", lambda e: F.struct(F.size(F.array_intersect(F.col("own")["bag"], e["bag"])).alias("shared"), e.alias("e")))
    scored = F.transform(shared, lambda x: F.struct((-score(F.col("own"), x["e"], x["shared"])).alias("order"), *[x["e"][c].alias(c) for c in ("title", *ID, "n_bearers", "low", "high")]))
    best = pairs.select(*ID, "body", F.slice(F.sort_array(scored), 1, most).alias("best"))
    # An entry that shares both ends is met twice.
    top = best.groupBy(*ID).agg(F.first("body").alias("body"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("best")))), 1, most).alias("top"))
    entries_of = F.transform("top", lambda x: F.struct(F.split(x["title"], " ").alias("title"), (-x["order"]).alias("score"), *[x[c].alias(c) for c in (*ID, "n_bearers", "low", "high")]))
    return top.select(*ID, F.split("body", " ").alias("words"), entries_of.alias("found"))


def resolve(mentioned: DataFrame, titles: DataFrame, span: int = 3, least: float = 0.8, margin: float = 0.05, texts: DataFrame | None = None) -> DataFrame:
    """Edges and unresolved mentions: key, line, to_key, status, reason, score.

    ``mentioned`` has key, line, words; ``titles`` has key and words, one row a document; for
    ``texts`` see ``candidates``. Reasons: SELF_REFERENCE (only the document's own title fits),
    LOW_SCORE, AMBIGUOUS (equal titles, or a rival within the margin). Lines that meet no entry
    mention nothing.
    """
    mentioned, titles = identified(mentioned, span), identified(titles, span)
    own = titles.select(F.col("key").alias("__own"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    slim = F.transform("found", lambda x: F.struct(*[x[c].alias(c) for c in ("score", *ID, "n_bearers", "low", "high")]))
    found = candidates(mentioned, entries(titles), span, texts=texts).select(*ID, slim.alias("found"))
    rows = mentioned.select("key", "line", *ID).join(found, ID).join(own, F.col("key") == F.col("__own"), "left")

    def others(x: Column) -> Column:
        """Bearers of an entry besides the mentioning document."""
        return x["n_bearers"] - F.when(F.coalesce((x["h1"] == F.col("__h1")) & (x["h2"] == F.col("__h2")), F.lit(False)), 1).otherwise(0)

    rows = rows.withColumn("left", F.filter("found", lambda x: others(x) > 0))
    first, second = F.get("left", F.lit(0)), F.get("left", F.lit(1))
    rival = F.coalesce(second["score"] > first["score"] - margin, F.lit(False))
    target = F.when(first["low"] == F.col("key"), first["high"]).otherwise(first["low"])
    reason = (
        F.when(F.size("left") == 0, "SELF_REFERENCE").when(first["score"] < least, "LOW_SCORE").when((others(first) > 1) | rival, "AMBIGUOUS")
    )
    done = rows.select("key", "line", target.alias("to_key"), reason.alias("reason"), first["score"].alias("score"))
    return done.select("key", "line", F.when(F.col("reason").isNull(), F.col("to_key")).alias("to_key"), F.when(F.col("reason").isNull(), "resolved").otherwise("unresolved").alias("status"), "reason", "score")


def edges(resolved: DataFrame) -> DataFrame:
    """Relations by pair of documents: key, to_key, n_lines, first_line, confidence."""
    return resolved.where("status = 'resolved'").groupBy("key", "to_key").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"), F.max("score").alias("confidence"))

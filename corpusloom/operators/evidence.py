"""Evidence checks: quotes, spans and hashes against the texts they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import materialize

#: Words inside a quote by which documents are looked up before the quote is compared.
PROBE = 4


def probe(tokens: Column, at: Column) -> Column:
    """Hash of the tokens that follow a place."""
    return F.xxhash64(*[F.get(tokens, at + k) for k in range(PROBE)])


def containing(docs: DataFrame, quotes: DataFrame, doc_id: str = "doc_id", quote_id: str = "item_id") -> DataFrame:
    """Documents that hold a quote letter by letter: doc_id, quote_id, start (code points).

    The second to fifth blank-separated tokens of a quote stand whole in any text that holds
    it, so their hash meets the hashes of a text's runs of four tokens in an equi-join; only
    texts that meet are compared with the whole quote. Quotes too short for that meet texts
    on their first characters, three at most, in an equi-join of its own.
    """
    tokens = F.split("text", " ")
    q = quotes.where("text is not null and text <> ''").select(quote_id, F.col("text").alias("quote"), tokens.alias("tokens"))
    enough = F.size("tokens") >= PROBE + 2
    long = q.where(enough).select(quote_id, "quote", probe(F.col("tokens"), F.lit(1)).alias("probe"))
    short = q.where(~enough).select(quote_id, "quote", F.substring("quote", 1, 3).alias("probe"))
    t = docs.where("text is not null").select(doc_id, "text")
    runs = t.select(doc_id, tokens.alias("tokens")).where(F.size("tokens") >= PROBE)
    starts = F.sequence(F.lit(0), F.size("tokens") - PROBE)
    probes = runs.select(doc_id, F.explode(F.array_distinct(F.transform(starts, lambda i: probe(F.col("tokens"), i)))).alias("probe"))
    columns = [doc_id, quote_id, (F.expr("instr(text, quote)") - 1).alias("start")]

    def compared(probes: DataFrame, asked: DataFrame) -> DataFrame:
        hits = probes.join(asked.select(quote_id, "probe"), "probe").select(doc_id, quote_id).distinct()
        return hits.join(asked.drop("probe"), quote_id).join(t, doc_id).where(F.col("text").contains(F.col("quote"))).select(*columns)

    found = compared(probes, long)
    if short.isEmpty():
        return found
    at = F.sequence(F.lit(1), F.length("text"))
    sizes = [r[0] for r in short.select(F.length("probe")).distinct().collect()]  # 1, 2 or 3
    cut = lambda n: F.transform(at, lambda i: F.substring(F.col("text"), i, F.lit(n)))
    parts = F.array_distinct(F.flatten(F.array(*map(cut, sizes))))
    grams = t.where("text <> ''").select(doc_id, F.explode(parts).alias("probe"))
    return found.union(compared(grams, short))


def validate(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``outcome``: the first check that a span of evidence fails, or OK.

    ``evidence`` has doc_id, start, end, quote, quote_sha256, content_sha256; ``texts`` has
    doc_id and text.
    """
    j = evidence.join(texts.select("doc_id", "text"), "doc_id", "left")
    part = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    in_range = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    outcome = (
        F.when(F.col("text").isNull(), "NO_TEXT")
        .when(~in_range, "OUT_OF_RANGE")
        .when(part != F.col("quote"), "QUOTE_DIFFERS")
        .when(F.sha2("quote", 256) != F.col("quote_sha256"), "QUOTE_HASH")
        .when(F.sha2("text", 256) != F.col("content_sha256"), "CONTENT_HASH")
        .otherwise("OK")
    )
    return j.withColumn("outcome", outcome).drop("text")


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_runs(words: Column, n: int = PROBE) -> Column:
    """All runs of n words, in order, repeats included; shorter texts are one run.

    In an array of one the words have a name, so that they are worked out once, not once a run.
    """

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    return F.filter(F.get(F.transform(F.array(words), runs), F.lit(0)), lambda x: x != "")


def run_rows(texts: DataFrame, n: int = PROBE) -> DataFrame:
    """The runs of ``words`` (see ``word_runs``), one a row, with the other columns; repeats included.

    Places are exploded, not runs: a run is put together from its words at its own row.
    """
    i = F.col("__at")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    places = texts.withColumn("__at", F.explode(F.when(F.size("words") > 0, starts)))
    run = F.concat_ws(" ", *[F.get("words", i + k) for k in range(n)])
    return places.select(*[c for c in texts.columns if c != "words"], run.alias("run"))


def quote_states(docs: DataFrame, quotes: DataFrame, least: float = 0.5, doc_id: str = "doc_id", quote_id: str = "item_id") -> DataFrame:
    """How each quote stands in the text that holds most of it.

    Gives quote_id, doc_id, state, share and altered_at. VERBATIM: letter by letter. FOLDED:
    with the same words. ALTERED: with at least ``least`` of its runs of words. MISSING: no text
    has that. ``altered_at`` is the first word (from 0) whose run the text lacks. Quote and text
    meet on runs of words; only the best text of each quote is read again. Ties go to the
    smaller id.
    """
    q = quotes.select(F.col(quote_id).alias("q"), F.col("text").alias("quote"), word_list(F.col("text")).alias("words")).withColumn("runs", word_runs(F.col("words")))
    asked = q.select("q", F.monotonically_increasing_id().alias("asked"), F.explode(F.array_distinct("runs")).alias("run"))
    held = run_rows(docs.select(F.col(doc_id).alias("d"), F.monotonically_increasing_id().alias("row"), word_list(F.col("text")).alias("words")))
    # A run counts once a text; only runs that a quote has are made distinct.
    met = held.join(asked, "run").distinct().groupBy("q", "d").agg(F.count("*").alias("n"))
    best = met.groupBy("q").agg(F.max(F.struct("n", (-F.col("d")).alias("back"))).alias("b")).select("q", (-F.col("b.back")).alias("d"), "b.n")
    # Written, so that Spark knows how few they are and does not shuffle all texts to meet them.
    best = materialize(best)
    texts = docs.select(F.col(doc_id).alias("d"), F.col("text").alias("body")).join(best.select("d").distinct(), "d", "left_semi")
    found = q.join(best, "q", "left").join(texts, "d", "left")
    share = F.coalesce("n", F.lit(0)) / F.size(F.array_distinct("runs"))
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    plain = padded(word_list(F.col("body")))
    state = (
        F.when(F.coalesce(F.col("body").contains(F.col("quote")), F.lit(False)), "VERBATIM")
        .when(F.coalesce(plain.contains(padded(F.col("words"))), F.lit(False)), "FOLDED")
        .when(share >= least, "ALTERED")
        .otherwise("MISSING")
    )
    lacking = F.get(F.transform(F.array(word_runs(word_list(F.col("body")))), lambda own: F.array_position(F.transform("runs", lambda x: F.array_contains(own, x)), F.lit(False)) - 1), F.lit(0))
    rows = found.select("q", "d", state.alias("state"), F.round(share, 6).alias("share"), lacking.alias("lacking"))
    return rows.select(F.col("q").alias(quote_id), F.when(F.col("state") != "MISSING", F.col("d")).alias(doc_id), "state", "share", F.when(F.col("state") == "ALTERED", F.col("lacking")).cast("long").alias("altered_at"))


def checked_claims(evidence: DataFrame) -> DataFrame:
    """Claims of validated evidence (claim, outcome, side): n, n_ok, passes, verdict.

    ``passes``: there is evidence and all of it holds. Only evidence that holds counts for the
    verdict; ``side`` is pro, contra or null.
    """
    ok = F.col("outcome") == "OK"
    pro, contra = F.count_if(ok & (F.col("side") == "pro")) > 0, F.count_if(ok & (F.col("side") == "contra")) > 0
    verdict = F.when(pro & contra, "DISPUTED").when(contra, "CONTRARY").when(pro, "SUPPORTED").otherwise("OPEN")
    n, n_ok = F.count("outcome"), F.count_if(ok)
    return evidence.groupBy("claim").agg(n.alias("n"), n_ok.alias("n_ok"), ((n > 0) & (n == n_ok)).alias("passes"), verdict.alias("verdict"))

"""Quotation linking against a plain version, and odd messages."""

import random
import re

from corpusloom.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_passages(text):
    """(level, normalised words) of each passage, line by line."""
    out, last = [], None
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        marks = re.match(r"(?:[ \t]*>)*", line)[0]
        level, words = marks.count(">"), line[len(marks) :].strip(" \t")
        if not words:
            last = None
            continue
        if last != level:
            out.append((level, []))
            last = level
        out[-1][1].append(words)
    named = [(lev, " ".join(re.sub(r"[\W_]+", " ", " ".join(w).lower()).split())) for lev, w in out]
    return [(lev, w) for lev, w in named if w]


def plain_links(rows):
    """reply_to by (conv_id, turn)."""
    origin, out = {}, {}
    for conv, turn, _, text in rows:
        for lev, words in plain_passages(text):
            if lev == 0 and conv is not None and turn is not None:
                origin[conv, words] = min(turn, origin.get((conv, words), turn))
    for conv, turn, _, text in rows:
        levels = {}
        for lev, words in plain_passages(text):
            if lev and origin.get((conv, words), turn) < turn:
                levels[words] = min(lev, levels.get(words, lev))
        first = [origin[conv, w] for w, lev in levels.items() if lev == 1]
        every = [origin[conv, w] for w in levels]
        if every:
            out[conv, turn] = max(first or every)
    return out


def test_links_equal_a_plain_version(spark):
    rnd = random.Random(3)
    rows = []
    for conv in range(25):
        said = []
        for turn in range(rnd.randrange(1, 14)):
            lines = []
            for _ in range(rnd.randrange(3)):
                if said:
                    marks = rnd.choice(["> ", ">> ", " > > ", ">"])
                    lines += [marks + x for x in rnd.choice(said).upper().split("\n")] + rnd.choice([[""], []])
            own = "\n".join(" ".join(rnd.choice(["yes", "no", "a", "b", "ünï", "x1"]) for _ in range(rnd.randrange(1, 4))) + rnd.choice(["", "!", " ..."]) for _ in range(rnd.randrange(1, 3)))
            said.append(own)
            rows.append((conv, turn, "u", "\n".join([*lines, own, *(["", "also " + own] if rnd.random() < 0.3 else [])])))
    want = plain_links(rows)
    got = chat.build_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["conv_id"], r["turn"]): r["reply_to"] for r in got if r["reply_to"] is not None} == want and len(want) > 60
    quoted = {(c, t): sum(lev > 0 for lev, _ in plain_passages(x)) for c, t, _, x in rows}
    assert {(r["conv_id"], r["turn"]): r["n_quoted"] for r in got} == quoted
    for r in got:
        up, depth = want.get((r["conv_id"], r["turn"])), 0
        last = r["turn"]
        while up is not None:
            depth, last, up = depth + 1, up, want.get((r["conv_id"], up))
        assert (r["thread_turn"], r["depth"]) == (last, depth)


def test_own_lines_stay_as_they_are(spark):
    code = "    if x:\n        y()\n\nDone."
    rows = [
        (1, 0, "u", "ok"),
        (1, 1, "u", f"> ok\n\n{code}"),
        (1, 2, "u", "On Monday, Ann wrote:\n> ok\nFine.\n\nHe wrote: yes\n\n\n"),
        (1, 3, "u", "a > b\n  and c"),
        (1, 4, "u", "> ok"),
        (1, 5, "u", ">\n> \n"),
        (1, 5, "u", ">\n> \n"),
        (1, 6, "u", "w " * 200_000 + "\n> OK!"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"parts": F.lit("kept"), "depth": F.lit("gone")})
    got = {r["turn"]: r for r in chat.build_conversations(df).collect()}
    assert [got[i]["text"] for i in range(6)] == ["ok", code, "Fine.\n\nHe wrote: yes", "a > b\n  and c", "", ""]
    assert [got[i]["reply_to"] for i in range(7)] == [None, 0, 0, None, 0, None, 0]
    assert [got[i]["max_level"] for i in range(6)] == [0, 1, 1, 0, 1, 1] and all(r["parts"] == "kept" for r in got.values())
    assert len(got[6]["text"]) == 400_000
    assert chat.build_conversations(df).count() == len(rows) and chat.build_conversations(df.limit(0)).count() == 0

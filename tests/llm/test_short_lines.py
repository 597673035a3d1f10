"""Short and unspaced lines are compared like all others."""

import corpus_pipeline
from corpusloom.llm import line_dedup, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "無" * 300


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)


def plain_texts(texts):
    seen, out = [], []
    for text in texts:
        kept = []
        for line in text.split("\n"):
            words = set(line.lower().split())
            if not words or not any(len(words & s) * 5 >= len(words | s) * 4 for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out.append("\n".join(kept))
    return out


SHORT = ["All rights reserved.\nthe one\n\nfoo", f"{LONG}\nall  RIGHTS reserved.\n}}\n \nnew line here", f"x y z\n{LONG}\n}}\n\none the", "y z x\nx y\nfoo\nfoo foo\n \nlast of all these", "of all these last\nx y z w\nx y z w v u\nx y z w v"]


def test_short_and_unspaced_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, SHORT))
    got = {r["doc_id"]: r["text"] for r in queries.op9_line_dedup(spark, "").collect()}
    assert [got[i] for i in range(len(SHORT))] == plain_texts(SHORT)
    p = line_dedup.Params(share=2, first_candidates=1, slots=8)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, SHORT), p).collect()}
    assert [got[i] for i in range(len(SHORT))] == plain_texts(SHORT)


def test_stage_compares_short_lines(spark):
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, frame(spark, SHORT), "").collect()}
    assert got == {i: t for i, t in enumerate(plain_texts(SHORT)) if t.strip(" ")}

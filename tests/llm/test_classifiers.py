"""The classifiers against plain versions that take no shortcut."""

import math
import random

import numpy as np
from corpusloom.llm import quality, toxicity
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string"


def texts_of(n, seed=1):
    rnd = random.Random(seed)
    good = "the of and to in house river garden walked slowly under old bridge with them".split()
    bad = "idiot moron scum hate you all worthless trash".split()
    out = []
    for i in range(n):
        words = [rnd.choice(good) for _ in range(rnd.randrange(5, 160))]
        if i % 3 == 0:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(bad) for _ in range(6)]
        out.append(" ".join(words))
    return out


def plain_score(model, text):
    """Score of one text: every window word by word, in double precision."""
    p, w = model.params, {k: v.astype(float) for k, v in model.weights.items()}
    inputs = toxicity.Inputs(model.vocabulary, p)
    words = toxicity.words_of(text)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        slots, _ = inputs.trigram_slots([word])
        chars = np.mean([w["char"][k] for k in slots], axis=0) if len(slots) else np.zeros(p.char_dim)
        return np.concatenate([w["word"][inputs.at.get(word, 1)], chars, np.mean([w["start"][k] for k in inputs.start_slots([word])[0]], axis=0)])

    best, start = -math.inf, 0
    while True:
        window = [vector(x) for x in words[start : start + p.window]]
        states = {}
        for side, order in (("f", window), ("b", window[::-1])):
            h, out = np.zeros(p.hidden), []
            for x in order:
                g = x @ w[f"in_{side}"] + w[f"b_{side}"]
                u = h @ w[f"rec_{side}"][:, : 2 * p.hidden]
                z, r = sig(g[: p.hidden] + u[: p.hidden]), sig(g[p.hidden : 2 * p.hidden] + u[p.hidden :])
                c = np.tanh(g[2 * p.hidden :] + (r * h) @ w[f"rec_{side}"][:, 2 * p.hidden :])
                h = (1 - z) * h + z * c
                out.append(h)
            states[side] = out if side == "f" else out[::-1]
        if window:
            both = np.array([np.concatenate(x) for x in zip(states["f"], states["b"], strict=True)])
            a = np.exp(both @ w["att"])
            pool = (a / a.sum()) @ both
        else:
            pool = np.zeros(2 * p.hidden)
        best = max(best, pool @ w["out"] + w["bias"][0])
        start += p.stride
        if start + p.window - p.stride >= len(words):
            break
    return 1 / (1 + math.exp(-(model.slope * best + model.offset)))


def test_toxicity_scores_equal_plain_windows(spark):
    texts = texts_of(150)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, toxicity.Params(train_windows=400, epochs=2, vocabulary=100))
    odd = [None, "", "idiot", "無" * 400, "the " * 39, "the " * 40, "the " * 41, "x y " * 40_000 + "idiot moron scum"]
    some = texts[:25] + odd
    rows = spark.createDataFrame(list(enumerate(some)), DOCS).withColumn("toxicity", F.lit("clash"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(rows, model).collect()}
    for i, text in enumerate(some):
        assert abs(got[i] - plain_score(model, text)) < 2e-3, (i, got[i])
    assert toxicity.score(rows.limit(0), model).count() == 0


def test_training_rows_are_bounded(spark):
    """Repeated ids bring one row, over-long texts none."""
    rows = [(1, "the idiot")] * 500 + [(2, "a garden")] * 500 + [(3, "w " * 200_000), (4, None)]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    seen = []
    keep, toxicity.train = toxicity.train, lambda rows, prior, p: seen.append(rows)
    try:
        toxicity.fit(spark.createDataFrame(rows, DOCS), labels)
    finally:
        toxicity.train = keep
    held = {i for i in (1, 2, 4) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    assert {(r.doc_id, r.toxic, r.text) for r in seen[0].itertuples()} == {(i, t, x) for i, t, x in ((1, 1, "the idiot"), (2, 0, "a garden"), (4, 0, "")) if i not in held} and len(seen[0]) == 3 - len(held)


def plain_posterior(patterns, rounds):
    """EM over documents one by one, with the same start and the same added counts."""
    votes = [quality.unpack(np.array([c]))[0].tolist() for c in patterns]
    post = [(sum(x == 1 for x in v) + 0.5) / (sum(x >= 0 for x in v) + 1.0) if any(x >= 0 for x in v) else 0.5 for v in votes]
    for _ in range(rounds):
        prior = (sum(post) + 1) / (len(post) + 2)
        chance = {}
        for k in range(quality.N_LABELLERS):
            for o in (-1, 0, 1):
                for label in (0, 1):
                    weight = [q if label else 1 - q for q in post]
                    chance[k, o, label] = (sum(w for w, v in zip(weight, votes) if v[k] == o) + 1) / (sum(weight) + 3)
        new = []
        for v in votes:
            a, b = prior, 1 - prior
            for k, o in enumerate(v):
                a, b = a * chance[k, o, 1], b * chance[k, o, 0]
            new.append(a / (a + b))
        post = new
    return post


def test_quality_equals_a_plain_version(spark):
    texts = texts_of(60) + ["", None, " ", "A" * 40, "!!! ??? ###", "a a a a a a a a a a a a a a a a a a a a a a a a", "word " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("score", F.lit("clash"))
    p = quality.Params(em_rounds=6)
    got = {r["doc_id"]: r for r in quality.classify(docs, p).collect()}
    codes = [quality.Document(t).pattern() for t in texts]
    assert [got[i]["votes"] for i in range(len(texts))] == codes
    assert np.allclose([got[i]["posterior"] for i in range(len(texts))], plain_posterior(codes, 6), atol=1e-6)
    fitted = [t for t in texts if len(t or "") <= p.sample_chars]
    soft = {c: got[i]["posterior"] for i, c in enumerate(codes)}
    order = sorted(range(len(fitted)), key=lambda i: texts.index(fitted[i]))
    weights = quality.fit_scorer([quality.Document(fitted[i]) for i in order], np.array([soft[quality.Document(fitted[i]).pattern()] for i in order]), p)
    for i, text in enumerate(texts):
        words = (text or "").split()
        total = sum(weights[k] for w in words for k in quality.features(w, p.slots)) / max(1, len(words))
        total += quality.repeats(words) * weights[quality.again_slot(p.slots)] + weights[-1]
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-total))) < 1e-5 and got[i]["keep"] == (got[i]["score"] >= 0.5)

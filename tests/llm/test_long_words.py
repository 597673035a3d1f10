"""Words of any length are read to their end."""

from collections import Counter

import numpy as np
from corpusloom.llm import toxicity

LONG = "無" * 300


def test_pieces_cover_long_words():
    for word in ("a" * 96, "ab" * 400, LONG, "é🙂x" * 90, "x" * 97, "🙂" * 24 + "z"):
        parts = toxicity.words_of(word)
        assert all(0 < len(p.encode()) <= 96 for p in parts) and parts[0] == word[: len(parts[0])]
        raw, made = word.encode(), [p.encode() for p in parts]
        grams = lambda b: Counter({b[i : i + 3] for i in range(len(b) - 2)})
        assert set(grams(raw)) == set().union(*map(grams, made)) and raw.endswith(made[-1])
    assert toxicity.words_of("Two " + "q" * 96) == ["two", "q" * 96]
    assert toxicity.words_of(None) == toxicity.words_of(" \n") == []


def test_the_end_of_a_long_word_counts():
    p = toxicity.Params(epochs=1)
    rng = np.random.default_rng(0)
    model = toxicity.Model(p, [], toxicity.Network(p, 0).w, 1.0, 0.0)
    tail = "".join(map(chr, rng.integers(97, 123, 400)))
    a, b = toxicity.Scorer(model).logits(["a" * 120 + tail, "a" * 520])
    assert a != b

"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on a whole text. Expectation
maximisation over the counts of vote patterns (at most 3 to the number of labellers, whatever
the corpus) estimates how accurate each labeller is and how many documents are good. The
posterior of its pattern is a document's soft label. A hashed linear scorer, fitted on the
soft labels of a bounded sample, then scores every document by its own words.

Defined results: a null, empty or white text is bad by rule of the length labeller and
scored by the bias alone; repeated rows are scored each; null ids are kept; extra columns
are ignored; a table of long texts alone is scored by the bias, which is then 0. With one
pattern only, the posterior is the prior of EM's start.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.arrowmap import add_columns, bound_batches
from corpusloom.sampling import hash_sample

# Frequent function words of the corpus languages.
FUNCTION_WORDS = set("the of and to in a is that it for on was as with be by der die und das ist von zu den mit sich de la le les et en du des un une que el los las y por con una se".split())


@dataclass(frozen=True)
class Params:
    """``sample_rows`` sets how many documents the scorer is fitted on (twice that at most, of
    ``sample_chars`` characters each at most)."""

    sample_rows: int = 4000
    sample_chars: int = 100_000
    slots: int = 1 << 16
    epochs: int = 12
    rate: float = 0.5
    ridge: float = 1e-5
    keep_at: float = 0.5
    em_rounds: int = 200


def repeats(words: list[str]) -> float:
    """Share of words that follow themselves."""
    return sum(map(eq, words, islice(words, 1, None))) / max(1, len(words))


def votes(words: list[str], few: Counter, again: float, text: str) -> list[int]:
    """One vote per labeller: 1 good, 0 bad, -1 none."""
    n = len(words)
    if not n:
        return [0, -1, -1, -1, -1, -1, -1, -1, -1]
    lines = [x for x in text.split("\n") if x.strip()]
    mean = sum(map(len, words)) / n
    function = sum(c for w, c in few.items() if w.lower() in FUNCTION_WORDS) / n
    plain = sum(c for w, c in few.items() if w.strip(".,;:!?'\"()").isalpha()) / n
    upper = sum(c for w, c in few.items() if len(w) > 1 and w.isupper()) / n
    odd = sum(c for w, c in few.items() if not any(map(str.isalnum, w)) or w[-1] in "#$%&*|<>{}") / n
    top = max(few.values()) / n
    repeated = 1 - len(set(lines)) / len(lines)
    ends = sum(x.rstrip()[-1:] in ".!?\"" for x in lines) / len(lines)
    vote = lambda good, bad: 1 if good else 0 if bad else -1
    return [
        vote(n >= 50, n < 8),
        vote(3.5 <= mean <= 8.5, mean < 2.5 or mean > 11),
        vote(function >= 0.12, n >= 20 and function < 0.03),
        vote(plain >= 0.93, plain < 0.7),
        vote(False, upper > 0.4),
        vote(odd < 0.01, odd > 0.1),
        vote(n >= 20 and top < 0.12, n >= 20 and top > 0.3 or repeated > 0.4),
        vote(ends >= 0.8, ends < 0.3),
        vote(n >= 20 and again < 0.02, again > 0.15),
    ]


N_LABELLERS = 9


class Document:
    """What labellers and the scorer read of a text, worked out once."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.split()
        self.count = Counter(self.words)
        self.again = repeats(self.words)

    def pattern(self) -> int:
        """The votes as a number in base 3."""
        code = 0
        for v in votes(self.words, self.count, self.again, self.text):
            code = code * 3 + v + 1
        return code


def unpack(codes: np.ndarray) -> np.ndarray:
    """Votes (patterns, labellers) of base-3 numbers."""
    return np.stack([codes // 3**k % 3 - 1 for k in range(N_LABELLERS - 1, -1, -1)], axis=1)


def fit_votes(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern, accuracy of each labeller by class, and the prior.

    Each labeller's vote given the class is one of three outcomes, abstention among them, so
    labellers that only ever vote one way are told apart too. Starts from the majority.
    """
    v = unpack(codes)
    cast = (v >= 0).sum(axis=1)
    post = np.where(cast > 0, ((v == 1).sum(axis=1) + 0.5) / (cast + 1.0), 0.5)
    for _ in range(rounds):
        prior = float((counts @ post + 1) / (counts.sum() + 2))
        like = []
        for q in (1 - post, post):
            w = counts * q
            like.append(np.stack([((w @ (v == o)) + 1.0) / (w.sum() + 3.0) for o in (-1, 0, 1)], axis=1))
        logs = [np.log(p[np.arange(N_LABELLERS)[None], v + 1]).sum(axis=1) for p in like]
        new = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    accuracy = np.stack([like[0][:, 1] / (like[0][:, 1] + like[0][:, 2]), like[1][:, 2] / (like[1][:, 1] + like[1][:, 2])], axis=1)
    return post, accuracy, prior


def features(word: str, slots: int) -> tuple[int, int, int]:
    """Slots of a word, its ending and its shape."""
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:4] + word[-4:])
    low = word.lower()
    return crc32(b"w" + low.encode()) % slots, crc32(b"e" + low[-3:].encode()) % slots, crc32(b"s" + shape.encode()) % slots


def again_slot(slots: int) -> int:
    return crc32(b"again") % slots


class Hasher:
    """Average hashed features of texts, with a memory for words."""

    def __init__(self, slots: int, most: int = 300_000):
        self.slots, self.most, self.seen = slots, most, {}

    def vector(self, doc: Document) -> tuple[np.ndarray, np.ndarray]:
        count = doc.count
        if len(self.seen) > self.most:
            self.seen.clear()
        for w in count:
            if w not in self.seen:
                self.seen[w] = features(w, self.slots)
        n = max(1, sum(count.values()))
        at = np.array([self.seen[w] for w in count], np.int64).reshape(-1, 3)
        value = np.repeat(np.fromiter(count.values(), np.float32, len(count))[:, None] / n, 3, axis=1)
        return np.append(at.ravel(), again_slot(self.slots)), np.append(value.ravel(), np.float32(doc.again))


def fit_scorer(docs: list[Document], soft: np.ndarray, p: Params = Params()) -> np.ndarray:
    """Weights of the hashed linear scorer, the bias last; AdaGrad on soft labels."""
    hasher, rng = Hasher(p.slots), np.random.default_rng(11)
    rows = [hasher.vector(d) for d in docs]
    w, seen = np.zeros(p.slots + 1), np.full(p.slots + 1, 1e-8)
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            g = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30))) - soft[i]
            slots, where = np.unique(at, return_inverse=True)
            grad = np.bincount(where, x) * g + p.ridge * w[slots]
            seen[slots] += grad * grad
            w[slots] -= p.rate * grad / np.sqrt(seen[slots])
            seen[-1] += g * g
            w[-1] -= p.rate * g / np.sqrt(seen[-1])
    return w


class Scorer:
    """Scores whole texts; the sum of a word's three weights is remembered."""

    def __init__(self, weights: np.ndarray, slots: int, most: int = 500_000):
        self.w, self.slots, self.most, self.seen = weights, slots, most, {}

    def __call__(self, doc: Document) -> float:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        n_words = max(1, len(doc.words))
        total = doc.again * n_words * self.w[again_slot(self.slots)]
        for word, n in doc.count.items():
            value = seen.get(word)
            if value is None:
                value = seen[word] = float(sum(self.w[i] for i in features(word, self.slots)))
            total += n * value
        return float(1 / (1 + np.exp(-np.clip(total / n_words + self.w[-1], -30, 30))))


def classify(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id_col, votes (pattern), posterior, score and keep."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, docs[text].alias("__text"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"votes": [Document(t).pattern() for t in frame["__text"]]})

    bound_batches(spark)
    seen = rows.select("__text").mapInPandas(vote, "votes int").groupBy("votes").count().toPandas().sort_values("votes")
    if not len(seen):
        return spark.createDataFrame([], f"`{id_col}` {kind}, votes int, posterior double, score double, keep boolean")
    post, _, _ = fit_votes(seen["votes"].to_numpy(), seen["count"].to_numpy(float), p.em_rounds)
    posterior = dict(zip(seen["votes"].tolist(), post.tolist(), strict=True))
    short = rows.where(F.coalesce(F.length("__text"), F.lit(0)) <= p.sample_chars)
    sample = hash_sample(short, p.sample_rows, [id_col, "__text"], int(seen["count"].sum())).toPandas()
    sample = sample.sort_values([id_col, "__text"], na_position="first")
    known = [Document(t) for t in sample["__text"]]
    soft = np.array([posterior[d.pattern()] for d in known])
    shared = spark.sparkContext.broadcast((fit_scorer(known, soft, p), posterior))

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        weights, known = shared.value
        scorer = Scorer(weights, p.slots)
        found = [(d.pattern(), scorer(d)) for d in map(Document, batch.column("__text").to_pylist())]
        return {"votes": [v for v, _ in found], "posterior": [known[v] for v, _ in found], "score": [x for _, x in found], "keep": [x >= p.keep_at for _, x in found]}

    return add_columns(rows, make, "votes int, posterior double, score double, keep boolean", drop=("__text",))

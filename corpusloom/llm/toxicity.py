"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters the network as its word embedding (a vocabulary of the training words, one
embedding for all others) beside the mean embeddings of its character trigrams and of its
first 4, 5, 6 and 7 bytes. Words of over 96 bytes enter as overlapping pieces. Two gated
recurrent layers read each window forwards and backwards, attention pools the states and a
logistic unit scores the window. A document's score calibrates its highest window score.
Training is plain numpy on the driver, over a bounded sample of labelled rows (``Params``);
scoring covers every overlapping window of every text on the executors.

Defined results: a null, empty or white text is scored as one empty window; a null id is
never held out and gives no label; repeated rows are scored each; labels that are null or
whose id is null are unused; of repeated labels of an id the largest counts. With fewer than two
classes among the training rows the score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import worker
from corpusloom.arrowmap import add_columns
from corpusloom.sampling import hash_sample


@dataclass(frozen=True)
class Params:
    """Bounds and sizes; the first four bound what the driver holds (rows: twice that at most,
    a row for each labelled id; texts of over ``train_chars`` characters are not trained on)."""

    toxic_rows: int = 1000
    clean_rows: int = 1500
    train_windows: int = 12_000
    train_chars: int = 100_000
    vocabulary: int = 20_000
    least_count: int = 4
    trigrams: int = 4096
    starts: int = 32_768
    word_dim: int = 8
    char_dim: int = 6
    start_dim: int = 6
    hidden: int = 6
    window: int = 40
    stride: int = 30
    epochs: int = 5
    batch: int = 256
    rate: float = 0.02
    seed: int = 7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


#: Bytes of a word that enter as one input, and by how many its pieces overlap.
PIECE, OVERLAP = 96, 16


def pieces(word: str) -> Iterator[str]:
    """A word of over PIECE bytes as overlapping pieces, cut between characters."""
    raw = word.encode()
    start = 0
    while len(raw) - start > PIECE:
        end = start + PIECE
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        yield raw[start:end].decode()
        start = end - OVERLAP
        while raw[start] & 0xC0 == 0x80:
            start -= 1
    yield raw[start:].decode()


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; long ones as their pieces, so that all of a text is read."""
    words = (text or "").lower().split()
    if all(len(w) <= PIECE // 4 for w in words):
        return words
    return [part for w in words for part in ((w,) if len(w) <= PIECE // 4 else pieces(w))]


class Inputs:
    """Turns words into rows of embedding inputs; remembers words already seen."""

    def __init__(self, vocabulary: list[str], p: Params):
        self.at = {w: i + 2 for i, w in enumerate(vocabulary)}
        self.trigrams, self.starts = p.trigrams, p.starts

    def start_slots(self, words: list[str]) -> np.ndarray:
        """Hashed slots (words, 4) of the first bytes of each word."""
        raw = [w.encode()[:7] for w in words]
        return np.array([[crc32(r[:k]) for k in (4, 5, 6, 7)] for r in raw], np.int64).reshape(-1, 4) % self.starts

    def trigram_slots(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashed trigram slots of all words end to end, and how many each word has."""
        raw = [b"^" + w.encode() + b"$" for w in words]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        h = (x[:-2] * np.uint32(961) + x[1:-1] * np.uint32(31) + x[2:]) * np.uint32(2654435761) >> np.uint32(8)
        ends = np.cumsum(n)
        inside = np.ones(len(x), bool)
        inside[ends - 1] = False
        inside[ends - 2] = False
        return (h[inside[:-2]] % np.uint32(self.trigrams)).astype(np.int64), n - 2

    def word_ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.at.get(w, 1) for w in words), np.int64, len(words))


class Network:
    """Weights and the passes of the network; everything in float32."""

    def __init__(self, p: Params, n_words: int):
        rng = np.random.default_rng(p.seed)
        h, d = p.hidden, p.word_dim + p.char_dim + p.start_dim
        small = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = p
        self.w = {"word": small(n_words + 2, p.word_dim), "char": small(p.trigrams, p.char_dim), "start": small(p.starts, p.start_dim), "att": small(2 * h), "out": small(2 * h), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w |= {f"in_{side}": small(d, 3 * h), f"rec_{side}": small(h, 3 * h), f"b_{side}": np.zeros(3 * h, np.float32)}

    def embed(self, inputs: Inputs, words: list[str]) -> np.ndarray:
        """Word vectors: word embedding, mean trigram embedding, mean embedding of starts."""
        slots, n = inputs.trigram_slots(words)
        rows = np.repeat(np.arange(len(words)), n)
        chars = np.zeros((len(words), self.p.char_dim), np.float32)
        for k in range(self.p.char_dim):
            chars[:, k] = np.bincount(rows, self.w["char"][slots, k], len(words))
        starts = self.w["start"][inputs.start_slots(words)].mean(axis=1)
        return np.concatenate([self.w["word"][inputs.word_ids(words)], chars / np.maximum(n, 1)[:, None].astype(np.float32), starts], axis=1)

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction; x (time, batch, 3 hidden) are projected inputs."""
        h = self.p.hidden
        rec = self.w[f"rec_{side}"]
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape[:2], h), np.float32)
        kept = []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            gates = sigmoid(x[t][:, : 2 * h] + state @ rec[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(x[t][:, 2 * h :] + (r * state) @ rec[:, 2 * h :])
            m = mask[t][:, None]
            new = state + m * z * (c - state)
            if keep:
                kept.append((t, state, z, r, c))
            state = new
            out[t] = state
        return out, kept

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights, pooled state and logit of each window."""
        a = np.where(mask, states @ self.w["att"], np.float32(-30.0))
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pool = np.einsum("tb,tbh->bh", a, states)
        return a, pool, pool @ self.w["out"] + self.w["bias"][0]

    def logits(self, proj: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Logits of windows of word rows (time, batch); row 0 of proj is padding."""
        mask = ids > 0
        states = np.concatenate([self.run(proj[s][ids], mask, s, False)[0] for s in "fb"], axis=2)
        return self.pooled(states, mask)[2]

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {s: vectors @ self.w[f"in_{s}"] + self.w[f"b_{s}"] for s in "fb"}

    def gradients(self, inputs: tuple, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over windows of word rows (time, batch)."""
        vectors, word_rows, slots, slot_rows, n, starts = inputs
        p, h = self.p, self.p.hidden
        mask = ids > 0
        proj = self.project(vectors)
        runs = {s: self.run(proj[s][ids], mask, s, True) for s in "fb"}
        states = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        a, pool, logit = self.pooled(states, mask)
        d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": d @ pool, "bias": d.sum(keepdims=True)}
        d_pool = d[:, None] * self.w["out"]
        d_a = np.einsum("bh,tbh->tb", d_pool, states)
        d_e = np.where(mask, a * (d_a - (a * d_a).sum(axis=0)), 0)
        g["att"] = np.einsum("tb,tbh->h", d_e, states)
        d_states = a[:, :, None] * d_pool + d_e[:, :, None] * self.w["att"]
        d_vec = np.zeros_like(vectors)
        for k, s in enumerate("fb"):
            rec = self.w[f"rec_{s}"]
            d_rec, d_next = np.zeros_like(rec), np.zeros((ids.shape[1], h), np.float32)
            d_proj = np.zeros_like(proj[s])
            for t, before, z, r, c in reversed(runs[s][1]):
                dh = d_states[t][:, k * h : (k + 1) * h] + d_next
                m = mask[t][:, None]
                dz, dc = dh * m * (c - before) * z * (1 - z), dh * m * z * (1 - c * c)
                d_in = dc @ rec[:, 2 * h :].T
                dr = d_in * before * r * (1 - r)
                d_gates = np.concatenate([dz, dr], axis=1)
                d_next = dh * (1 - m * z) + d_in * r + d_gates @ rec[:, : 2 * h].T
                d_rec[:, : 2 * h] += before.T @ d_gates
                d_rec[:, 2 * h :] += (r * before).T @ dc
                np.add.at(d_proj, ids[t], np.concatenate([d_gates, dc], axis=1))
            d_proj[0] = 0
            g[f"rec_{s}"], g[f"in_{s}"], g[f"b_{s}"] = d_rec, vectors.T @ d_proj, d_proj.sum(axis=0)
            d_vec += d_proj @ self.w[f"in_{s}"].T
        g["word"] = np.zeros_like(self.w["word"])
        np.add.at(g["word"], word_rows, d_vec[:, : p.word_dim])
        cut = p.word_dim + p.char_dim
        share = (d_vec[:, p.word_dim : cut] / np.maximum(n, 1)[:, None])[slot_rows]
        g["char"] = np.stack([np.bincount(slots, share[:, k], p.trigrams) for k in range(p.char_dim)], axis=1).astype(np.float32)
        spread = np.repeat(d_vec[1:, cut:] / 4, 4, axis=0)
        g["start"] = np.stack([np.bincount(starts.ravel(), spread[:, k], p.starts) for k in range(p.start_dim)], axis=1).astype(np.float32)
        return g


def window_ids(n: int, window: int, stride: int) -> np.ndarray:
    """Positions + 1 of all overlapping windows of n words, 0 for padding; one at least."""
    starts = np.arange(0, max(1, n - window + stride), stride)
    at = starts[:, None] + np.arange(window)
    return np.where(at < n, at + 1, 0)


@dataclass
class Model:
    """What scoring needs; a few MB at most, whatever the corpus."""

    params: Params
    vocabulary: list[str]
    weights: dict[str, np.ndarray]
    slope: float
    offset: float
    constant: float | None = None


def train(rows: pd.DataFrame, prior: float, p: Params = Params()) -> Model:
    """Fit on rows (text, toxic); ``prior`` is the share of label 1 among all training labels."""
    if rows["toxic"].nunique() < 2:
        return Model(p, [], {}, 0.0, 0.0, float(prior))
    rng = np.random.default_rng(p.seed)
    docs = [words_of(t) for t in rows["text"]]
    y = rows["toxic"].to_numpy(np.float32)
    count = Counter(w for d in docs for w in set(d))
    vocabulary = sorted((w for w, c in count.items() if c >= p.least_count), key=lambda w: (-count[w], w))[: p.vocabulary]
    inputs, net = Inputs(vocabulary, p), Network(p, len(vocabulary))
    wins = [window_ids(len(d), p.window, p.stride) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(w) for w in wins])
    part = np.concatenate([np.arange(len(w)) for w in wins])
    chosen = []
    for label in (0, 1):
        own = np.flatnonzero(y[owner] == label)
        chosen.append(rng.permutation(own)[: p.train_windows // 2])
    chosen = np.concatenate(chosen)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    step = 0
    for _ in range(p.epochs):
        chosen = rng.permutation(chosen)
        for i in range(0, len(chosen), p.batch):
            pick = chosen[i : i + p.batch]
            ids, batch_inputs = _rows_of(net, inputs, [docs[owner[k]] for k in pick], [wins[owner[k]][part[k]] for k in pick])
            g = net.gradients(batch_inputs, ids, y[owner[pick]], np.ones(len(pick), np.float32))
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.w[k] -= (p.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    top = score_logits(Model(p, vocabulary, net.w, 1.0, 0.0), [" ".join(d) for d in docs])
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    slope, offset = _calibrate(top, y, weight)
    return Model(p, vocabulary, net.w, slope, offset)


def _rows_of(net: Network, inputs: Inputs, docs: list[list[str]], wins: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
    at: dict[str, int] = {}
    ids = np.zeros((net.p.window, len(docs)), np.int64)
    for b, (d, w) in enumerate(zip(docs, wins, strict=True)):
        for t, k in enumerate(w.tolist()):
            if k:
                ids[t, b] = at.setdefault(d[k - 1], len(at) + 1)
    words = list(at)
    none = np.zeros((1, net.w["in_f"].shape[0]), np.float32)
    if not words:
        empty = np.zeros(0, np.int64)
        return ids, (none, np.zeros(1, np.int64), empty, empty, np.ones(1, np.int64), empty)
    slots, n = inputs.trigram_slots(words)
    vectors = np.concatenate([none, net.embed(inputs, words)])
    rows = np.concatenate([[0], inputs.word_ids(words)])
    return ids, (vectors, rows, slots, np.repeat(np.arange(1, len(words) + 1), n), np.concatenate([[1], n]), inputs.start_slots(words))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit by Newton steps, with a small ridge."""
    b = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1).astype(float)
    for _ in range(50):
        q = sigmoid(a @ b)
        grad = a.T @ (weight * (q - y)) + 1e-3 * b
        hess = (a * (weight * q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        b -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


#: Words that a worker remembers inputs for.
REMEMBERED = 100_000


class Scorer:
    """Scores texts with a model; word inputs stay in memory between batches."""

    def __init__(self, model: Model):
        self.model, p = model, model.params
        if model.constant is None:
            self.net = Network(p, len(model.vocabulary))
            self.net.w = model.weights
            self.inputs = Inputs(model.vocabulary, p)
            self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        h3 = 3 * self.model.params.hidden
        self.proj = {s: np.zeros((REMEMBERED + 1, h3), np.float32) for s in "fb"}

    def rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        new = set().union(*docs) - self.at.keys()
        proj = self.proj
        if len(self.at) + len(new) > REMEMBERED:
            self.forget()
            new, proj = set().union(*docs), self.proj
        if new:
            words = sorted(new)
            first = len(self.at) + 1
            self.at.update(zip(words, range(first, first + len(words)), strict=True))
            made = self.net.project(self.net.embed(self.inputs, words))
            for s in "fb":
                if first + len(words) > len(proj[s]):
                    proj[s] = np.concatenate([proj[s], np.zeros((first + len(words), proj[s].shape[1]), np.float32)])
                proj[s][first : first + len(words)] = made[s]
        get = self.at.__getitem__
        return [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Highest window logit of each text."""
        p = self.model.params
        docs = [words_of(t) for t in texts]
        known = self.rows(docs)
        wins, owner = [], []
        for i, ids in enumerate(known):
            at = window_ids(len(ids), p.window, p.stride)
            wins.append(np.where(at > 0, np.concatenate([[0], ids])[at], 0))
            owner.append(np.full(len(at), i))
        wins, owner = np.concatenate(wins), np.concatenate(owner)
        top = np.full(len(texts), -np.inf, np.float32)
        for i in range(0, len(wins), 4096):
            np.maximum.at(top, owner[i : i + 4096], self.net.logits(self.proj, np.ascontiguousarray(wins[i : i + 4096].T)))
        return top

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        return sigmoid(self.model.slope * self.logits(texts).astype(float) + self.model.offset)


def score_logits(model: Model, texts: list[str]) -> np.ndarray:
    scorer = Scorer(model)
    return np.concatenate([scorer.logits(texts[i : i + 64]) for i in range(0, len(texts), 64)])


def in_fold(id_col: str = "doc_id", folds: int = 5):
    """Whether a row is held out: crc32 of its id as text is 0 modulo ``folds``."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Train on a bounded sample, by hash, of labelled rows that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~in_fold()).select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    sample = hash_sample(known.where("toxic = 1"), p.toxic_rows, ["doc_id"], ones)
    sample = sample.union(hash_sample(known.where("toxic = 0"), p.clean_rows, ["doc_id"], n - ones))
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= p.train_chars).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Of the rows of a repeated id one is trained on.
    rows = short.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values("doc_id").reset_index(drop=True)
    return train(rows, ones / n if n else 0.0, p)


def slices(texts: list[str | None], chars: int = 400_000) -> Iterator[list[str | None]]:
    """Runs of texts with about ``chars`` characters together, at least a text each."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t or "")
        if total >= chars:
            yield held
            held, total = [], 0
    if held:
        yield held


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and ``name`` (double, 0 to 1), which replaces one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = int(np.random.default_rng().integers(1 << 62))

    def make(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        scorer = worker.held(("toxicity", mark), lambda: Scorer(shared.value))
        return {name: np.concatenate([np.zeros(0), *map(scorer.scores, slices(batch.column(text).to_pylist()))])}

    return add_columns(docs, make, f"`{name}` double")

"""Byte-level BPE encoding and decoding over whole texts.

Pieces (matches of the pattern) are merged apart from each other. New pieces of a batch
are sorted into length buckets, each one a padded numpy matrix of ids; in every round each
row merges its leftmost pair of minimum rank, looked up in an open-addressing hash table of
pairs, and is then compacted. Pieces beyond the longest bucket take a heap, which gives the
same ids in n log n steps.

Defined results: a null or empty text has no ids (the digests of zero bytes); repeated rows
are encoded each; extra columns of the input are ignored unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corpusloom import worker
from corpusloom.arrowmap import add_columns

#: Longest piece, in bytes, that goes into a matrix.
LONGEST = 256
#: Pieces of at most LONGEST bytes that a worker remembers, and their characters together; the
#: memory is emptied when full.
REMEMBERED, REMEMBERED_CHARS = 120_000, 2_000_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    return [found.get(i, b"") for i in range(max(found) + 1)]


class Codec:
    """Encoder and decoder for one vocabulary and one pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for t, i in self.rank.items():
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        size = 1 << max(4, int(len(keys) * 4).bit_length())
        self.mask = np.uint64(size - 1)
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.slot_key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.slot_rank = np.full(size, NONE, np.int32)
        todo, at, self.probes = np.arange(len(keys)), self._home(keys), 0
        while len(todo):
            self.probes += 1
            slots = at[todo]
            free = self.slot_key[slots] == np.iinfo(np.uint64).max
            _, first = np.unique(np.where(free, slots, size + np.arange(len(slots)).astype(np.uint64)), return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = free[first]
            self.slot_key[slots[won]] = keys[todo[won]]
            self.slot_rank[slots[won]] = np.array(merged, np.int32)[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
        self.seen: dict[str, bytes] = {}
        self.seen_chars = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where the pair is no token; any shape."""
        shape = left.shape
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        for _ in range(self.probes):
            slot = self.slot_key[at]
            hit = slot == keys[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            more = ~hit & (slot != np.iinfo(np.uint64).max)
            if not more.any():
                break
            todo, at = todo[more], (at[more] + np.uint64(1)) & self.mask
        return out.reshape(shape)

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as bytes; pieces of like length together."""
        n, width = len(pieces), max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.zeros((n, width), np.int32)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = np.where(inside[:, 1:], self.pair_ranks(ids[:, :-1], ids[:, 1:]), NONE)
        live = np.arange(n)
        final: list[bytes] = [b""] * n
        while len(live):
            best = ranks.argmin(axis=1)
            row = np.arange(len(live))
            low = ranks[row, best]
            done = low == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    final[live[i]] = ids[i, : lengths[i]].astype("<u4").tobytes()
                keep = ~done
                live, ids, ranks, lengths, best, low = live[keep], ids[keep], ranks[keep], lengths[keep], best[keep], low[keep]
                if not len(live):
                    break
                width = int(lengths.max())
                ids, ranks, row = ids[:, :width], ranks[:, :width], np.arange(len(live))
            ids[row, best] = low
            source = np.minimum(np.arange(width - 1) + (np.arange(width - 1) > best[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            width -= 1
            lengths = lengths - 1
            for at in (best - 1, best):
                ok = (at >= 0) & (at + 1 < lengths)
                ranks[row[ok], at[ok]] = self.pair_ranks(ids[row[ok], at[ok]], ids[row[ok], at[ok] + 1])
                end = (at >= 0) & (at + 1 >= lengths) & (at < width)
                ranks[row[end], at[end]] = NONE
        return final

    def merge_heap(self, piece: bytes) -> bytes:
        """The same ids for one long piece, with a heap of pairs."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        at: list[int] = ids.tolist()
        after, before = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
        heap = [(int(first[i]), int(i), at[i], at[i + 1]) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        tokens, rank = self.tokens, self.rank

        def push(i: int, j: int) -> None:
            r = rank.get(tokens[at[i]] + tokens[at[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, at[i], at[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if at[i] != a or j >= len(at) or at[j] != b:
                continue
            at[i], at[j] = r, -1
            after[i] = after[j]
            if after[i] < len(at):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in at if x >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Add the ids of new pieces to the worker's memory."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                self.seen[p] = int(whole).to_bytes(4, "little")
            elif len(raw) > LONGEST:
                self.seen[p] = self.merge_heap(raw)
            else:
                buckets.setdefault(len(raw) if len(raw) <= 16 else 16 + (len(raw) + 15) // 16 * 16, []).append((p, raw))
        for width, found in buckets.items():
            step = max(64, 131_072 // width)
            for i in range(0, len(found), step):
                part = found[i : i + step]
                self.seen.update(zip((p for p, _ in part), self.merge_matrix([raw for _, raw in part]), strict=True))
        self.seen_chars += sum(map(len, pieces))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        pieces = set().union(*split)
        new = {p for p in pieces if p not in self.seen}
        if len(self.seen) + len(new) > REMEMBERED or self.seen_chars + sum(map(len, new)) > REMEMBERED_CHARS:
            self.seen, self.seen_chars, new = {}, 0, pieces
        if new:
            self.learn(new)
        return [b"".join(map(self.seen.__getitem__, x)) for x in split]

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(shared) -> Codec:
    return worker.held(("bpe", shared.id), lambda: Codec(*shared.value))


class _Shared:
    """A broadcast with a key by which a worker keeps what it built from it."""

    def __init__(self, spark: SparkSession, tokens: list[bytes], pattern: str):
        self.cast = spark.sparkContext.broadcast((tokens, pattern))
        self.id = hash((len(tokens), hashlib.sha256(b"\0".join(tokens)).hexdigest(), pattern))

    @property
    def value(self):
        return self.cast.value


def slices(texts: list[str], chars: int = 400_000) -> Iterator[list[str]]:
    """Runs of texts with about ``chars`` characters together, at least a text each."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= chars:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` and n_tokens, ids_sha256, decoded_sha256, and ``ids`` binary if asked.

    The rank file is read on the driver and broadcast (a fixed vocabulary, not corpus data),
    so executors need no file of their own.
    """
    spark = docs.sparkSession
    shared = _Shared(spark, read_ranks(ranks_path), pattern)
    kept = docs.select(*keep, docs[text].alias("__text"))
    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        codec = _codec(shared)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for part in slices([t or "" for t in batch.column("__text").to_pylist()]):
            for ids in codec.encode_many(part):
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
        return out

    return add_columns(kept, make, added, drop=("__text",))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``text``: the bytes of ``ids``, read as UTF-8 (null: empty)."""
    shared = _Shared(encoded.sparkSession, read_ranks(ranks_path), pattern)

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        codec = _codec(shared)
        return {"text": [codec.decode_bytes(x).decode("utf-8", "replace") if x is not None else "" for x in batch.column("__ids").to_pylist()]}

    return add_columns(encoded.select(*keep, encoded[ids].alias("__ids")), make, "text string", drop=("__ids",))

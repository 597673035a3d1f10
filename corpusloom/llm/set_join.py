"""Exact set-similarity join over the lines of texts, or over texts as sets of shingles.

An item (a line, or a text) is a set of units (words, or runs of words), held as their hashes
(58 bits of a 64-bit hash; units that share one count as equal). Units are ordered by rarity:
a table of fixed size counts those of the whole corpus by hash slot, and ties go by hash,
which is one total order for all sets. Two sets of Jaccard similarity t or more share a unit
among the first ``n - ceil(t n) + 1`` of each, so only those enter posting lists. Within a
list the length filter (size classes), the positional filter and a parity signature (each
unit flips one of 64 bits, of one of 256 for long sets; sets that differ in d units differ in
d bits at most) leave few pairs, which are verified on the sets. A set goes if one at an
earlier place is similar, whether that one stays or not; places are ordered by (id, hash of
the text, item number).

Equal sets are one, at the earliest place. Units that occur once in the corpus are not
posted. Lists that a bounded sample of documents shows to be long are dealt out as pairs of
salted shares, which moves work but changes no result. From each list a set sends on a few
candidates; sets whose candidates all fail are compared, in a second pass and within the
tasks of their lists, with all others there. So no link is lost and no group is expanded into
all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.arrowmap import bound_batches, give_back
from corpusloom.llm.membership import bit_set, maybe_in
from corpusloom.llm.words import mixed, runs, spans
from corpusloom.storage import checkpoint, materialize
from corpusloom.worker import release


@dataclass(frozen=True)
class Params:
    """Similarity is ``num / den``; ``slots`` is the fixed size of the rarity table.

    ``shingle`` 0 takes lines as sets of words, a number whole texts as sets of runs of so many
    words (a shorter text is one run); whole texts also get a sketch of ``sketch_bits``, which
    thins out pairs before their sets are read. The others move work only: ``share`` is the
    length above which lists are dealt out, ``sample_rows`` bounds the documents by which those
    are foreseen, a set first sends ``first_candidates`` of a list, or ``long_candidates`` if it
    has over ``long_words`` units, for which the signature says less; ``bucket_bytes`` is about
    what a task holds of lists.
    """

    num: int = 4
    den: int = 5
    shingle: int = 0
    sketch_bits: int = 2048
    slots: int = 1 << 21
    share: int = 20_000
    sample_rows: int = 1000
    first_candidates: int = 4
    long_candidates: int = 16
    long_words: int = 64
    bucket_bytes: int = 16_000_000


ONE = np.uint64(1)
#: No set holds this key: the rarity of a word is under 63.
NO_WORD = np.uint64(2**64 - 1)
#: Rarity of a word that occurs once.
ONCE = 2
POSTS = "bucket int, list array<int>, d1 array<bigint>, sig array<bigint>, doc array<bigint>, sub array<bigint>, size array<int>, at array<int>, wide array<bigint>, words array<bigint>"
SET, X, Y = ["d1", "sig"], ["x_d1", "x_sig"], ["y_d1", "y_sig"]


def doc_key(p: Params) -> Column:
    """The id as a long; null ids come first among lines and last among texts."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1 if p.shingle else -(2**63)))


def placed(docs: DataFrame, p: Params) -> DataFrame:
    """Columns doc, t (hash of the text) and text; null texts have no lines."""
    bound_batches(docs.sparkSession)
    return docs.where(F.lit(True) if p.shingle else F.col("text").isNotNull()).select(doc_key(p).alias("doc"), F.xxhash64("text").alias("t"), "text")


class Items(NamedTuple):
    """Items of some rows that follow each other, from row ``start`` on: how many each row
    has, how many units each item has, and the units' hashes end to end."""

    start: int
    of_row: np.ndarray
    count: np.ndarray
    hashes: np.ndarray


def items(column: pa.Array, p: Params, most_bytes: int = 1 << 20) -> Iterator[Items]:
    """Items of a column of texts."""
    for run in runs(column, most_bytes):
        if not p.shingle:
            yield Items(run.start, run.lines_of_row, run.words_of_line, run.hashes)
            continue
        upto = np.concatenate([[0], np.cumsum(run.words_of_line)])[np.concatenate([[0], np.cumsum(run.lines_of_row)])]
        count, hashes = shingles(run.hashes, np.diff(upto), p.shingle)
        yield Items(run.start, np.ones(len(count), np.int64), count, hashes)


def shingles(words: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many runs of ``width`` words each text of ``n`` words has, and their hashes; a
    shorter text is one run."""
    factor = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(width)], np.uint64)
    count = np.maximum(1, n - width + 1)
    out = np.zeros(int(count.sum()), np.uint64)
    first, at = np.cumsum(count) - count, np.cumsum(n) - n
    long = n >= width
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    whole = np.zeros(len(words), np.uint64)
    for k in range(width):
        whole += padded[k : k + len(words)] * factor[k]
    nth = np.arange(len(words)) - np.repeat(at, n)
    out[np.repeat(long, count)] = whole[np.repeat(long, n) & (nth <= np.repeat(n - width, n))]
    for i in np.flatnonzero(~long):
        out[first[i]] = (words[at[i] : at[i] + n[i]] * factor[: n[i]]).sum(dtype=np.uint64) + np.uint64(n[i])
    return count, mixed(out)


class Sets:
    """Distinct words of lines: ``size`` and ``line`` (its number in the run) of each set,
    their keys end to end in rarity order, and each key's ``rank`` and ``owner``."""

    def __init__(self, hashes: np.ndarray, count: np.ndarray, rarity: np.ndarray | None = None):
        keys = hashes >> np.uint64(6)
        if rarity is not None:
            keys |= rarity[(hashes & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)
        first = np.cumsum(count) - count
        lines, sizes, flat, ranks = [], [], [], []
        width = 0
        while (count > width).any():
            wider = max(4, width + (width + 3) // 4 * 2)
            some = np.flatnonzero((count > width) & (count <= wider))
            for i in range(0, len(some), max(1, 400_000 // wider)):
                part = some[i : i + max(1, 400_000 // wider)]
                spot = first[part][:, None] + np.arange(wider)
                table = np.where(np.arange(wider) < count[part][:, None], keys[np.minimum(spot, len(keys) - 1)], NO_WORD)
                table.sort(axis=1)
                fresh = table != NO_WORD
                fresh[:, 1:] &= table[:, 1:] != table[:, :-1]
                lines.append(part)
                sizes.append(fresh.sum(axis=1))
                flat.append(table[fresh])
                ranks.append((np.cumsum(fresh, axis=1) - 1)[fresh])
            width = wider
        none = np.zeros(0, np.int64)
        self.line, self.size = np.concatenate([none, *lines]), np.concatenate([none, *sizes])
        self.keys, self.rank = np.concatenate([none.view(np.uint64), *flat]), np.concatenate([none, *ranks])
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.starts = np.cumsum(self.size) - self.size

    def words(self) -> np.ndarray:
        """Keys without their rarity."""
        return self.keys & np.uint64((1 << 58) - 1)

    def identities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digest and parity signature of each set, and its signature's four parts."""
        h = mixed(self.words() + np.uint64(0x632BE59BD9B4E019))
        if not len(h):
            return h.view(np.int64), h.view(np.int64), np.zeros((0, 4), np.int64)
        spot = mixed(h) & np.uint64(255)
        bit = ONE << (spot & np.uint64(63))
        parts = np.stack([np.bitwise_xor.reduceat(np.where(spot >> np.uint64(6) == w, bit, np.uint64(0)), self.starts) for w in range(4)], axis=1)
        return np.add.reduceat(h, self.starts).view(np.int64), np.bitwise_xor.reduce(parts, axis=1).view(np.int64), parts.view(np.int64)

    def fingerprints(self) -> np.ndarray:
        """SimHash of each set: a bit is 1 if set in over half the hashes of its words."""
        h = mixed(self.words() + np.uint64(0x2545F4914F6CDD1D))
        ones = np.zeros((len(self.size), 64), np.int32)
        for i in range(0, len(h), 1 << 15):
            bits = np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts, _ = spans(self.owner[i : i + (1 << 15)])
            ones[self.owner[i + starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        return np.packbits(2 * ones > self.size[:, None], axis=1, bitorder="little").view(np.int64).ravel()

    def sketches(self, bits: int) -> np.ndarray:
        """Parity sketch of each set, rows of longs: a word flips one of ``bits``."""
        spot = (mixed(self.words() + np.uint64(0xD6E8FEB86659FD93)) & np.uint64(bits - 1)).astype(np.int64)
        out = np.zeros((len(self.size), bits // 64), np.int64)
        for a in range(0, len(self.size), 256):
            b = min(a + 256, len(self.size))
            s, e = self.starts[a], self.starts[b - 1] + self.size[b - 1]
            odd = np.bincount((self.owner[s:e] - a) * bits + spot[s:e], minlength=(b - a) * bits).astype(np.uint8) & 1
            out[a:b] = np.packbits(odd.reshape(-1, bits), axis=1, bitorder="little").view(np.int64)
        return out


def lists_of(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow column of lists."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


def survey(docs: DataFrame, p: Params) -> DataFrame:
    """One reading of all texts: rows of unit counts by slot (``at``, ``n``), and rows of doc,
    t and number, d1, sig (arrays) with the sets of a document's items; for whole texts also
    their size, fingerprint and sketch. Of a bounded sample of documents (``sample_rows``, twice
    that at most) the text comes along."""
    block = 1 << 13
    drawn = F.pmod(F.xxhash64("doc", "t"), F.lit(max(1, docs.count() // p.sample_rows))) == 0
    schema = "at int, n binary, doc bigint, t bigint, number array<int>, d1 array<bigint>, sig array<bigint>, size int, fp bigint, sketch array<bigint>, sample string"
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(k: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(k, kind) for c, kind in zip(names, types, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(p.slots, np.int32)
        for batch in batches:
            drawn = batch.column("drawn").to_pylist()
            for run in items(batch.column("text"), p):
                np.add.at(total, (run.hashes & np.uint64(p.slots - 1)).astype(np.int64), 1)
                sets = Sets(run.hashes, run.count)
                d1, sig, _ = sets.identities()
                back = np.argsort(sets.line, kind="stable")
                starts = np.cumsum(run.of_row) - run.of_row
                row = np.searchsorted(starts, sets.line[back], "right") - 1
                ends = pa.array(np.cumsum(np.concatenate([[0], np.bincount(row, minlength=len(starts))])).astype(np.int32))
                columns = {"number": (sets.line[back] - starts[row]).astype(np.int32), "d1": d1[back], "sig": sig[back]}
                made = {c: pa.ListArray.from_arrays(ends, pa.array(v)) for c, v in columns.items()}
                if p.shingle:
                    sketch = sets.sketches(p.sketch_bits)[back]
                    made |= {"size": pa.array(sets.size[back].astype(np.int32)), "fp": pa.array(sets.fingerprints()[back])}
                    made["sketch"] = pa.ListArray.from_arrays(pa.array(np.arange(len(sketch) + 1, dtype=np.int32) * sketch.shape[1]), pa.array(sketch.ravel()))
                k = len(starts)
                made["sample"] = pa.array([batch.column("text")[i].as_py() if drawn[i] else None for i in range(run.start, run.start + k)], pa.string())
                yield rows(k, made | {c: batch.column(c).slice(run.start, k) for c in ("doc", "t")})
        small = np.minimum(total, 65_535).astype("<u2")
        for i in range(0, p.slots, block):
            if small[i : i + block].any():
                yield rows(1, {"at": pa.array([i], pa.int32()), "n": pa.array([small[i : i + block].tobytes()], pa.binary())})
        give_back()

    return materialize(placed(docs, p).withColumn("drawn", drawn).mapInArrow(read, schema))


def rarity(surveyed: DataFrame, p: Params) -> tuple[np.ndarray, int]:
    """Rarity class (0 to 62) by hash slot, a table of fixed size; and the number of words."""

    def merge(frame: pd.DataFrame, kind: str) -> pd.DataFrame:
        total = sum(np.frombuffer(b, kind).astype(np.int64) for b in frame["n"])
        return pd.DataFrame({"at": frame["at"].iloc[:1], "n": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    counts = np.zeros(p.slots, np.int64)
    found = surveyed.where("at is not null").select("at", "n").withColumn("few", F.floor(F.spark_partition_id() / 256))
    found = found.groupBy("at", "few").applyInPandas(lambda f: merge(f, "<u2"), "at int, n binary")
    for at, n in found.groupBy("at").applyInPandas(lambda f: merge(f, "<u4"), "at int, n binary").collect():
        counts[at : at + len(n) // 4] = np.frombuffer(n, "<u4")
    return np.minimum(2 * np.log2(1 + counts), 62).astype(np.uint8), int(counts.sum())


def postings(run: Items, batch: pa.RecordBatch, rare: np.ndarray, p: Params) -> tuple[Sets, dict[str, np.ndarray], np.ndarray]:
    """Sets of a run's items, the columns of their prefix postings, and each posting's set.

    Of equal sets in the run the one at the earliest place is posted.
    """
    sets = Sets(run.hashes, run.count, rare)
    d1, sig, parts = sets.identities()
    doc, sub = (x[sets.line] for x in places(batch, run.start, run.of_row))
    order = np.lexsort((sub, doc, d1))
    s, t = order[1:], order[:-1]
    first = np.ones(len(order), bool)
    first[s] = (d1[s] != d1[t]) | (sig[s] != sig[t]) | (sets.size[s] != sets.size[t])
    prefix = np.where(first, sets.size - -(-sets.size * p.num // p.den) + 1, 0)
    post = np.flatnonzero((sets.rank < prefix[sets.owner]) & (sets.keys >> np.uint64(58) > ONCE))
    owner = sets.owner[post]
    made = {"key": mixed(sets.keys[post] ^ np.uint64(0x5851F42D4C957F2D)), "d1": d1[owner], "sig": sig[owner], "doc": doc[owner], "sub": sub[owner], "size": sets.size[owner].astype(np.int32), "at": sets.rank[post].astype(np.int32), "wide": parts[owner, :3]}
    return sets, made, owner


def places(batch: pa.RecordBatch, start: int, lines_of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each line of a run: doc, and 32 bits of the text's hash before the line number."""
    row = np.repeat(np.arange(len(lines_of_row)), lines_of_row)
    number = np.arange(len(row)) - np.repeat(np.cumsum(lines_of_row) - lines_of_row, lines_of_row)
    doc, t = (batch.column(c).slice(start, len(lines_of_row)).to_numpy(zero_copy_only=False) for c in ("doc", "t"))
    return doc[row], (t[row] >> 32 << 32) + number


def long_lists(surveyed: DataFrame, rare: np.ndarray, p: Params) -> dict[int, int]:
    """Shares of lists that a bounded sample of documents shows to be long."""
    cast = surveyed.sparkSession.sparkContext.broadcast(rare)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in items(batch.column("sample"), p):
                found, seen = np.unique(postings(run, batch, cast.value, p)[1]["key"].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen)], ["key", "seen"])

    drawn = surveyed.where("sample is not null").select("doc", "t", "sample")
    rows, all_rows = drawn.count(), surveyed.where("doc is not null").count()
    if not rows:
        return {}
    found = drawn.mapInArrow(keys, "key bigint, seen bigint").groupBy("key").agg(F.sum("seen").alias("seen"))
    found = found.withColumn("n", F.ceil(F.col("seen") * all_rows / rows)).where((F.col("n") > p.share) & (F.col("seen") > 4))
    # Lists above a share of all rows in a sample of that size are bounded in number.
    return {r["key"] & (2**64 - 1): -(-r["n"] // p.share) for r in found.collect()}


def posted(docs: DataFrame, rare: np.ndarray, shares: dict[int, int], buckets: int, p: Params, only: DataFrame | None = None) -> DataFrame:
    """Rows of POSTS: postings by list bucket.

    ``only`` (one long column, bucket and list) names lists that are wanted; a filter leaves
    those and some others, and their postings bring the words along.
    """
    wanted = None if only is None else bit_set(only)
    shared = docs.sparkSession.sparkContext.broadcast((rare, shares, wanted))
    names = [c.split()[0] for c in POSTS.split(", ")]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rare, shares, wanted = shared.value
        for batch in batches:
            for run in items(batch.column("text"), p):
                sets, x, owner = postings(run, batch, rare, p)
                key = x.pop("key")
                if shares:
                    key, row = dealt(key, x["d1"], shares)
                    owner, x = owner[row], {k: v[row] for k, v in x.items()}
                bucket = (key >> np.uint64(32)).astype(np.int64) % buckets
                x["list"] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                if wanted is not None:
                    held = np.flatnonzero(maybe_in(spot(bucket, x["list"]), wanted))
                    bucket, owner, x = bucket[held], owner[held], {k: v[held] for k, v in x.items()}
                if not len(bucket):
                    continue
                order = np.argsort(bucket, kind="stable")
                bucket, owner, x = bucket[order], owner[order], {k: v[order] for k, v in x.items()}
                a, b = spans(bucket)
                ends = pa.array(np.append(a, len(bucket)).astype(np.int32))
                wide = x.pop("wide")
                columns = {k: pa.ListArray.from_arrays(ends, pa.array(v)) for k, v in x.items()}
                long = x["size"] > p.long_words
                columns["wide"] = lists_of([wide[s:e][long[s:e]].ravel() for s, e in zip(a, b, strict=True)], pa.int64())
                if wanted is None:
                    columns["words"] = pa.nulls(len(a), pa.list_(pa.int64()))
                else:
                    words = sets.words().view(np.int64)
                    columns["words"] = lists_of([np.concatenate([words[sets.starts[o] : sets.starts[o] + sets.size[o]] for o in owner[s:e]]) for s, e in zip(a, b, strict=True)], pa.int64())
                columns["bucket"] = pa.array(bucket[a].astype(np.int32))
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)
        give_back()

    return placed(docs, p).mapInArrow(post, POSTS)


def dealt(key: np.ndarray, d1: np.ndarray, shares: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys once for each pair of shares that a posting's own share is in, and their postings."""
    long = np.array(sorted(shares), np.uint64)
    at = np.minimum(np.searchsorted(long, key), len(long) - 1)
    n = np.where(long[at] == key, np.array([shares[k] for k in long.tolist()], np.int64)[at], 1)
    row = np.repeat(np.arange(len(key)), n)
    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    own = (mixed(d1.view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)[row]
    pair = (np.minimum(own, other) * 65_537 + np.maximum(own, other) + 1).astype(np.uint64)
    return np.where(n[row] > 1, mixed(key[row] + pair), key[row]), row


def spot(bucket: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Bucket and list as one long."""
    return (bucket.astype(np.int64) << 32) + lists.astype(np.int64)


class Lists:
    """Postings of one bucket, each set of a list once, by list, size class and place."""

    def __init__(self, table: pa.Table, p: Params):
        self.p = p
        x = {c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("list", "d1", "sig", "doc", "sub", "size", "at")}
        n = len(x["list"])
        x["wide"] = np.zeros((n, 3), np.int64)
        x["wide"][x["size"] > p.long_words] = table.column("wide").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        words = table.column("words").combine_chunks()
        self.words = words.flatten().to_numpy(zero_copy_only=False) if words.null_count < len(words) else None
        x["from"] = np.cumsum(x["size"], dtype=np.int64) - x["size"]
        # By place; places become numbers, equal places get one number.
        order = np.lexsort((x["sub"], x["doc"]))
        x = {c: v[order] for c, v in x.items()}
        new = np.ones(n, bool)
        new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["sub"][1:] != x["sub"][:-1])
        x["place"] = np.cumsum(new) - 1
        order = np.argsort((x["list"].astype(np.int64) << 32) + (x["d1"] & 0xFFFFFFFF), kind="stable")
        s, t = order[1:], order[:-1]
        keep = np.ones(n, bool)
        keep[1:] = np.any([x[c][s] != x[c][t] for c in ("list", "d1", "sig", "size")], axis=0)
        base = math.log(p.den / p.num * 1.001)
        kind = (np.log(np.maximum(x["size"], 1)) / base).astype(np.int64) + 1
        order = np.sort(order[keep])
        order = order[np.argsort((x["list"][order].astype(np.int64) << 32) + kind[order], kind="stable")]
        self.x = {c: v[order] for c, v in x.items()}
        kind = kind[order]
        starts, ends = spans(self.x["list"])
        group = np.repeat(np.arange(len(starts)), ends - starts) * 1024 + kind
        span = n + 1
        sorted_at = group * span + self.x["place"]
        # What each row is compared with: earlier rows of its own size class and of those beside.
        low = [np.searchsorted(sorted_at, (group + d) * span) for d in (-1, 0, 1)]
        high = [np.searchsorted(sorted_at, (group + d) * span + self.x["place"]) for d in (-1, 0, 1)]
        self.row = np.tile(np.arange(len(group)), 3)
        self.low, self.high = np.concatenate(low), np.concatenate(high)

    def candidates(self, most: np.ndarray | None = None, of: np.ndarray | None = None, judge=None) -> tuple[np.ndarray, np.ndarray]:
        """Rows (later, earlier) that pass the filters, up to ``most`` for each later row.

        ``of`` marks the later rows that are asked for. With ``judge`` (pairs to boolean) only
        pairs that it holds true are kept, and a row is done with its first.
        """
        jobs = np.flatnonzero((self.high > self.low) & (of[self.row] if of is not None else True))
        found = np.zeros(len(self.x["list"]), np.int64)
        xs, ys, lo, block = [], [], 0, 16
        while len(jobs):
            step = max(1, 1_000_000 // block)
            for i in range(0, len(jobs), step):
                some = jobs[i : i + step]
                n = np.minimum(block, self.high[some] - self.low[some] - lo)
                later = np.repeat(self.row[some], n)
                earlier = np.arange(len(later)) + np.repeat(self.low[some] + lo - (np.cumsum(n) - n), n)
                later, earlier = self.passing(later, earlier)
                if judge is not None and len(later):
                    true = judge(later, earlier)
                    later, earlier = later[true], earlier[true]
                if most is not None and len(later):
                    order = np.argsort(later, kind="stable")
                    later, earlier = later[order], earlier[order]
                    a, b = spans(later)
                    nth = np.arange(len(later)) - np.repeat(a, b - a) + found[later]
                    found[later[a]] += b - a
                    few = nth < most[later]
                    later, earlier = later[few], earlier[few]
                xs.append(later)
                ys.append(earlier)
            lo += block
            block = min(4 * block, 65_536)
            jobs = jobs[self.high[jobs] - self.low[jobs] > lo]
            if most is not None:
                jobs = jobs[found[self.row[jobs]] < most[self.row[jobs]]]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *xs]), np.concatenate([none, *ys])

    def passing(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that pass the length, signature and positional filters.

        |A n B| must reach num / (num + den) of |A| + |B|.
        """
        p, x = self.p, self.x
        a, b = x["size"][i], x["size"][j]
        need = -(-(a + b) * p.num // (p.num + p.den))
        allowed = a + b - 2 * need
        fold = (x["sig"][i] ^ x["sig"][j]).view(np.uint64)
        ok = np.flatnonzero((np.bitwise_count(fold) <= allowed) & (np.minimum(a, b) >= need))
        i, j, a, b, need, allowed, fold = (v[ok] for v in (i, j, a, b, need, allowed, fold))
        u, v = x["at"][i], x["at"][j]
        ok = np.minimum(a - u, b - v) + np.minimum(u, v) >= need
        both = np.flatnonzero(ok & (np.minimum(a, b) > p.long_words))
        parts = (x["wide"][i[both]] ^ x["wide"][j[both]]).view(np.uint64)
        last = fold[both] ^ np.bitwise_xor.reduce(parts, axis=1)
        ok[both] = np.bitwise_count(parts).sum(axis=1, dtype=np.int64) + np.bitwise_count(last) <= allowed[both]
        return i[ok], j[ok]

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets of each pair are similar, by their words."""
        x, p = self.x, self.p
        out = np.zeros(len(i), bool)
        total = np.cumsum(x["size"][i] + x["size"][j])
        for part in np.split(np.arange(len(i)), np.searchsorted(total, np.arange(2_000_000, total[-1], 2_000_000))) if len(i) else []:
            if not len(part):
                continue
            rows = np.stack([i[part], j[part]], axis=1).ravel()
            size = x["size"][rows]
            at = np.arange(size.sum()) + np.repeat(x["from"][rows] - (np.cumsum(size) - size), size)
            pair = np.repeat(np.arange(len(rows)) // 2, size)
            word = self.words[at]
            order = np.lexsort((word, pair))
            pair, word = pair[order], word[order]
            common = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (word[1:] == word[:-1])], minlength=len(part))
            out[part] = common * (p.num + p.den) >= (size[::2] + size[1::2]) * p.num
        return out


def candidates(posts: DataFrame, p: Params) -> DataFrame:
    """Pairs of sets (x later, y earlier) that pass the filters of some list; ``more`` tells
    that x may have others in the list (bucket, list)."""
    names = ["x_d1", "x_sig", "y_d1", "y_sig", "more", "bucket", "list"]

    def work(table: pa.Table) -> pa.Table:
        lists = Lists(table, p)
        most = np.where(lists.x["size"] > p.long_words, p.long_candidates, p.first_candidates)
        i, j = lists.candidates(most)
        more = (np.bincount(i, minlength=len(most)) >= most)[i]
        at = np.where(more, lists.x["list"][i], 0)
        # A pair stays once, and once for each list in which its set may have more.
        columns = [lists.x["d1"][i], lists.x["sig"][i], lists.x["d1"][j], lists.x["sig"][j], at]
        order = np.lexsort((at, lists.x["d1"][j], lists.x["d1"][i]))
        keep = np.ones(len(order), bool)
        keep[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
        order = order[keep]
        del lists
        give_back()
        made = [c[order] for c in columns[:4]] + [more[order], np.full(len(order), table.column("bucket")[0].as_py(), np.int32), at[order].astype(np.int32)]
        return pa.Table.from_arrays([pa.array(c) for c in made], names)

    return posts.groupBy("bucket").applyInArrow(work, "x_d1 bigint, x_sig bigint, y_d1 bigint, y_sig bigint, more boolean, bucket int, list int")


def again(posts: DataFrame, rest: DataFrame, p: Params) -> DataFrame:
    """Sets of ``rest`` (bucket, list, d1, sig) that some earlier set of their list is similar to."""
    schema = "d1 bigint, sig bigint"

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros((0, 2), np.int64)
        if left.num_rows and right.num_rows:
            lists = Lists(left, p)
            own = pd.MultiIndex.from_arrays([lists.x[c] for c in ("list", "d1", "sig")])
            want = own.isin(pd.MultiIndex.from_arrays([right.column(c).to_numpy() for c in ("list", "d1", "sig")]))
            i, _ = lists.candidates(np.ones(len(own), np.int64), want, lists.similar)
            found = np.stack([lists.x["d1"][i], lists.x["sig"][i]], axis=1)
        return pa.Table.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], SET)

    return posts.groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInArrow(work, schema).distinct()


def words_of(docs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Columns d1, sig and words of the sets whose d1 is in ``sets``, and of some others."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(sets))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for run in items(batch.column("text"), p):
                found = Sets(run.hashes, run.count)
                d1, sig, _ = found.identities()
                hit = np.flatnonzero(maybe_in(d1, shared.value))
                hit = hit[np.unique(np.stack([d1[hit], sig[hit]], axis=1), axis=0, return_index=True)[1]] if len(hit) else hit
                mine = np.zeros(len(d1), bool)
                mine[hit] = True
                hit = np.flatnonzero(mine)
                ends = np.cumsum(np.concatenate([[0], found.size[hit]])).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.words()[mine[found.owner]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(d1[hit]), pa.array(sig[hit]), words], [*SET, "words"])
        give_back()

    return placed(docs, p).mapInArrow(read, "d1 bigint, sig bigint, words array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, p: Params, sets: DataFrame | None = None) -> DataFrame:
    """Later sets of ``pairs`` with ``similar``: whether one of their candidates is.

    With ``sets`` (d1, sig, size, sketch) pairs whose sketches differ too much go first.
    """
    pairs = checkpoint(pairs.select(*X, *Y).distinct())
    left = pairs
    if sets is not None:
        drawn = sets.select(*SET, "size", "sketch")
        left = pairs.join(drawn.toDF(*X, "x_size", "x_sketch"), X).join(drawn.toDF(*Y, "y_size", "y_sketch"), Y)
        # Sets of similarity num / den differ in total * (den - num) / (num + den) units at most.
        allowed = F.floor((F.col("x_size") + F.col("y_size")) * (p.den - p.num) / F.lit(p.num + p.den))
        differ = F.aggregate(F.zip_with("x_sketch", "y_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
        left = checkpoint(left.where(differ <= allowed).select(*X, *Y))
    keys = left.select(F.explode(F.array("x_d1", "y_d1")).alias("d1")).distinct()
    words = materialize(words_of(docs, keys, p)).dropDuplicates(SET)
    both = left.join(words.toDF(*X, "x_words"), X).join(words.toDF(*Y, "y_words"), Y)
    common = F.size(F.array_intersect("x_words", "y_words"))
    similar = common * (p.num + p.den) >= (F.size("x_words") + F.size("y_words")) * p.num
    found = both.where(similar).select(*X).distinct().withColumn("found", F.lit(True))
    return pairs.select(*X).distinct().join(found, X, "left").select(*X, F.coalesce("found", F.lit(False)).alias("similar"))


def similar_sets(docs: DataFrame, surveyed: DataFrame, p: Params, sets: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """Sets (d1, sig) with a similar set, not equal, at an earlier place.

    ``sets`` has their sketches, for whole texts; ``more`` brings further pairs (x later,
    y earlier) that are worth verifying first.
    """
    spark = docs.sparkSession
    rare, n_units = rarity(surveyed, p)
    shares = long_lists(surveyed, rare, p)
    # About a fourth of all units is posted, with 50 bytes each.
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), n_units * 50 // 4 // p.bucket_bytes)
    pairs = materialize(candidates(posted(docs, rare, shares, buckets, p), p))
    first = pairs.select(*X, *Y)
    judged = checkpoint(verified(first if more is None else first.union(more.select(*X, *Y)), docs, p, sets))
    done = judged.where("similar").select(*X).toDF(*SET)
    rest = pairs.where("more").join(judged.where("not similar").select(*X), X).select("bucket", "list", *X).toDF("bucket", "list", *SET).distinct()
    rest = checkpoint(rest)
    if rest.isEmpty():
        return done
    key = (F.shiftleft(F.col("bucket").cast("bigint"), 32) + F.col("list")).alias("key")
    left = posted(docs, rare, shares, buckets, p, rest.select(key).distinct())
    return done.union(checkpoint(again(left, rest, p))).distinct()

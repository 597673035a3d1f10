"""SimHash near-duplicates by a binary trie self-join.

Each fingerprint enters one trie for every way to pick ``exact`` of ``blocks`` bit blocks,
so that two fingerprints within the Hamming budget agree on all picked blocks of one trie
at least. The picked bits are the root of a sub-trie and the shuffle key. Below a root,
node pairs are traversed together from the top bit, differing bits are added up and a pair
is dropped once the budget is exceeded; small node pairs are compared leaf by leaf.

Roots with many leaves are dealt out as pairs of salted shares, so none meets in one task,
and each task sends on a spanning forest of the links it found instead of all of them.

Defined results: a text that is null, empty or white space has fingerprint zero and links
like any other; rows with a null id take no part in ``component_id`` of others (theirs is
null); repeated ids and texts are allowed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.arrowmap import add_columns
from corpusloom.graph import connected_components, local_roots
from corpusloom.grouping import map_groups, spans
from corpusloom.storage import checkpoint

#: Leaves under one root that a single task takes; above, salted shares.
ROOT_LEAVES = 4096
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 512


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the shingle hashes."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spots = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in spots), np.uint64, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """Columns id_col and ``fp`` (the fingerprint as a signed long)."""

    def make(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        found = np.array([fingerprint(t, words) for t in batch.column("__text").to_pylist()], np.uint64)
        return {"fp": found.view(np.int64)}

    return add_columns(docs.select(id_col, docs[text].alias("__text")), make, "fp bigint", drop=("__text",))


def trie_links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits, for runs of sorted fingerprints under one root each."""
    lo1, hi1, lo2, hi2 = starts, ends, starts, ends
    err = np.zeros(len(starts), np.int8)
    for depth in range(65):
        n1, n2 = hi1 - lo1, hi2 - lo2
        small = (n1 * n2 <= LEAF_PAIRS) | (depth == 64)
        if small.any():
            yield from leaf_pairs(fps, lo1[small], hi1[small], lo2[small], hi2[small], budget)
        lo1, hi1, lo2, hi2, err = (x[~small] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            return
        bit = (fps >> np.uint64(63 - depth)) & np.uint64(1)
        upto = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        m1, m2 = hi1 - (upto[hi1] - upto[lo1]), hi2 - (upto[hi2] - upto[lo2])
        apart = lo1 != lo2
        children = [(lo1, m1, lo2, m2, err), (m1, hi1, m2, hi2, err), (lo1, m1, m2, hi2, err + 1)]
        children.append(tuple(x[apart] for x in (m1, hi1, lo2, m2, err + 1)))
        lo1, hi1, lo2, hi2, err = (np.concatenate(x) for x in zip(*children, strict=True))
        keep = (err <= budget) & (hi1 > lo1) & (hi2 > lo2)
        lo1, hi1, lo2, hi2, err = (x[keep] for x in (lo1, hi1, lo2, hi2, err))


def leaf_pairs(fps: np.ndarray, lo1, hi1, lo2, hi2, budget: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all leaves of each node pair, about ``most`` comparisons at a time."""
    counts = (hi1 - lo1) * (hi2 - lo2)
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        c = counts[at:upto]
        node = np.repeat(np.arange(at, upto), c)
        k = np.arange(len(node)) - np.repeat(np.cumsum(c) - c, c)
        width = (hi2 - lo2)[node]
        i, j = lo1[node] + k // width, lo2[node] + k % width
        ok = (i < j) | (lo1[node] != lo2[node])
        i, j = i[ok], j[ok]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
        if near.any():
            yield i[near], j[near]
        at = upto


def link_fingerprints(distinct: DataFrame, budget: int = 4, blocks: int = 6) -> DataFrame:
    """Edges ``a, b`` (ids) that connect all fingerprints within ``budget`` bits.

    ``distinct`` has ``id`` and ``fp``, each fingerprint once. ``blocks`` less the budget
    blocks are free of differences for some choice, which makes the trie roots.
    """
    exact = blocks - budget
    if exact < 1:
        raise ValueError("more blocks than the error budget are needed")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1) for b in pick) for pick in combinations(range(blocks), exact)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    roots = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)]))
    leaves = distinct.select("id", "fp", roots.alias("root"))
    large = leaves.groupBy("root").count().where(F.col("count") > ROOT_LEAVES)
    shares = large.select("root", F.ceil(F.col("count") / ROOT_LEAVES * 2).cast("int").alias("n"))
    marked = leaves.join(shares, "root", "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.xxhash64(F.col("root"), F.least(o, own), F.greatest(o, own)))
    dealt = marked.select("id", "fp", F.explode(F.when(F.col("n").isNull(), F.array("root")).otherwise(pairs)).alias("root"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(u=frame["fp"].to_numpy(np.int64).view(np.uint64)).sort_values(["root", "u"], kind="stable")
        starts, ends = spans(frame["root"].to_numpy())
        more = ends - starts > 1
        fps, ids = frame["u"].to_numpy(), frame["id"].to_numpy()
        found = []
        for i, j in trie_links(fps, starts[more], ends[more], budget):
            x, root = local_roots(ids[i], ids[j])
            found.append(pd.DataFrame({"a": x, "b": root})[x != root])
        return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return map_groups(dealt, "root", work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, budget: int = 4, words: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns id_col, ``fingerprint`` (16 hex digits), ``component_id`` and ``n_rows``.

    ``component_id`` is the smallest id reachable over links of at most ``budget``
    differing bits, a row's own id included.
    """
    marked = checkpoint(fingerprints(docs, id_col, text, words))
    distinct = checkpoint(marked.groupBy("fp").agg(F.min(id_col).alias("id"), F.count("*").alias("n_rows")))
    links = link_fingerprints(distinct.where("id is not null").select("id", "fp"), budget)
    found = connected_components(links)
    groups = distinct.join(found, "id", "left").select("fp", "n_rows", F.coalesce("component", "id").alias("component_id"))
    joined = marked.join(groups, "fp")
    own = F.when(F.col(id_col).isNull(), F.lit(None)).otherwise(F.col("component_id"))
    return joined.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own.alias("component_id"), "n_rows")

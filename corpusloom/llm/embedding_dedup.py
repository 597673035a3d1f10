"""Embedding near-duplicates with a pivot-permutation index.

Each vector is described by its nearest reference points (pivots) in order. Two vectors are
candidates if they share at least ``shared`` of their first ``depth`` pivots. As such a pair
also shares one of the ``depth - shared + 1`` rarest of them, only those enter the inverted
pivot lists; within a list shared pivots are counted on bit sets, each pair is handled at
its rarest common pivot alone, and survivors are verified by cosine in double precision.

Equal vectors of a label are collapsed first and counted back. Long lists are dealt out as
pairs of salted shares; tasks send on link counts and spanning forests instead of all links.

The number of pivots grows with the table, up to a bound, and the depth with that number, so
that lists stay short and near vectors keep sharing pivots: of pairs at a cosine of exactly
0.93, 99 in 100 are found at any size. It is an index, so a pair whose first pivots differ
too much is missed; none is ever added.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
vectors with a null label, link with nothing, nor do vectors of different length with each
other; repeated ids count as vectors of their own; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.graph import connected_components, local_roots
from corpusloom.grouping import map_groups, spans
from corpusloom.sampling import hash_sample
from corpusloom.storage import checkpoint

#: Vectors of one inverted list in a single share.
SHARE = 2048


def valid_vector(embedding: str = "embedding") -> Column:
    """Whether a vector has only finite components and is not zero."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def pivot_count(rows: int, least: int = 128, most: int = 1024, each: int = 400) -> int:
    """Pivots for so many vectors: a power of two."""
    return int(min(most, max(least, 1 << max(0, int(rows) // each).bit_length() - 1))) if rows >= each else least


def pivot_depth(n_pivots: int, shared: int) -> int:
    """How many nearest pivots describe a vector: more among many pivots."""
    return 2 * shared + 2 + 3 * max(0, n_pivots.bit_length() - 8)


def choose_pivots(df: DataFrame, n_pivots: int) -> dict[int, np.ndarray]:
    """Unit vectors by vector length, from a bounded sample (four a pivot, by hash).

    They are as far apart as can be.
    """
    rows = hash_sample(df.select("embedding"), 4 * n_pivots, ["embedding"]).toPandas()
    out = {}
    found = sorted((np.asarray(v, np.float64) for v in rows["embedding"]), key=lambda v: (len(v), v.tolist()))
    for length in sorted({len(v) for v in found}):
        x = unit_rows([v for v in found if len(v) == length])
        chosen, nearest = [0], x @ x[0]
        while len(chosen) < min(n_pivots, len(x)):
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, x @ x[chosen[-1]])
        out[length] = x[chosen]
    return out


def pivots_of(length: int, chosen: dict[int, np.ndarray], depth: int) -> np.ndarray:
    """Pivots for a vector length; lengths that the sample does not show, or hardly, get fixed ones."""
    if length in chosen and len(chosen[length]) > 4 * depth:
        return chosen[length]
    return unit_rows(np.random.default_rng(length).standard_normal((128, length)))


def unit_rows(vectors) -> np.ndarray:
    """Vectors scaled to length one in double precision."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def padded_rows(vectors) -> np.ndarray:
    """``unit_rows`` of vectors of any length, with zeros behind short ones."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = np.zeros((len(lengths), lengths.max(initial=0)))
    for length in np.unique(lengths):
        out[lengths == length, :length] = unit_rows([v for v in vectors if len(v) == length])
    return out


def pivot_ranks(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` pivots of each row, nearest first, ties to the smaller pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :depth]


def bits_of(ranks: np.ndarray, n: int) -> np.ndarray:
    """Sets of pivots as rows of 64-bit words."""
    out = np.zeros((len(ranks), (n + 63) // 64), np.uint64)
    for k in range(ranks.shape[1]):
        col = ranks[:, k]
        np.bitwise_or.at(out, (np.arange(len(col)), col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
    return out


def link_vectors(reps: DataFrame, threshold: float = 0.93, n_pivots: int | None = None, shared: int = 5) -> DataFrame:
    """Columns id, copies_linked and root for every vector with a link found in a task.

    ``reps`` has id, label, embedding and copies; one row a distinct vector and label.
    """
    spark = reps.sparkSession
    if reps.isEmpty():
        return spark.createDataFrame([], "id bigint, linked bigint, root bigint")
    n = n_pivots or pivot_count(reps.count())
    depth = pivot_depth(n, shared)
    chosen = choose_pivots(reps, n)
    n = max(n, 128)
    posted = depth - shared + 1
    cast = spark.sparkContext.broadcast(chosen)

    def describe(batches):
        for frame in batches:
            lengths = frame["embedding"].map(len).to_numpy()
            found: list = [None] * len(frame)
            for length in np.unique(lengths):
                pivots = pivots_of(int(length), cast.value, depth)
                for i in np.split(np.flatnonzero(lengths == length), range(1000, len(frame), 1000)):
                    if len(i):
                        for k, r in zip(i, pivot_ranks(unit_rows(frame["embedding"].iloc[i]), pivots, depth), strict=True):
                            found[k] = r.tolist()
            yield frame.assign(pivots=found)

    described = reps.mapInPandas(describe, "id bigint, label string, embedding array<double>, copies bigint, pivots array<int>")
    described = checkpoint(described)
    counts = {r["p"]: r["count"] for r in described.select(F.explode("pivots").alias("p")).groupBy("p").count().collect()}
    # Pivots are renumbered by rarity (at most n_pivots counts come to the driver).
    place = np.empty(n, np.int32)
    place[sorted(range(n), key=lambda p: (counts.get(p, 0), p))] = np.arange(n, dtype=np.int32)

    def renumber(batches):
        for frame in batches:
            yield frame.assign(pivots=list(np.sort(place[np.stack(frame["pivots"].to_list())], axis=1))) if len(frame) else frame

    described = described.mapInPandas(renumber, described.schema)
    posts = described.withColumn("pivot", F.explode(F.slice("pivots", 1, posted)))
    sizes = posts.groupBy("label", "pivot").count().select("label", "pivot", F.ceil(F.col("count") / SHARE).cast("int").alias("n"))
    posts = posts.join(sizes, ["label", "pivot"])
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    others = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
    posts = posts.withColumn("own", own).withColumn("other", F.explode(others))
    key = F.xxhash64("label", "pivot", F.least("own", "other"), F.greatest("own", "other"))
    # A pair within one share is handled where the share meets itself.
    posts = posts.select("id", "copies", "embedding", "pivots", "pivot", "own", (F.col("own") == F.col("other")).alias("alone"), key.alias("key"))
    blank = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "linked", "root")})

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "own", "id"], kind="stable")
        x, ids, copies = padded_rows(frame["embedding"]), frame["id"].to_numpy(), frame["copies"].to_numpy()
        ranks = np.stack(frame["pivots"].to_list())
        every, first = bits_of(ranks, n), bits_of(ranks[:, :posted], n)
        own, alone, pivot = frame["own"].to_numpy(), frame["alone"].to_numpy(), frame["pivot"].to_numpy()
        out = []
        for s, e in zip(*spans(frame["key"].to_numpy()), strict=True):
            if e - s < 2:
                continue
            cut = e if alone[s] else s + int(np.searchsorted(own[s:e], own[s], "right"))
            left, right = (np.arange(s, e), np.arange(s, e)) if alone[s] else (np.arange(s, cut), np.arange(cut, e))
            below = [np.uint64((1 << min(64, max(0, int(pivot[s]) - 64 * w))) - 1) for w in range(every.shape[1])]
            for i in range(0, len(left), 512):
                l = left[i : i + 512]
                common = sum(np.bitwise_count(every[l, w][:, None] & every[right, w][None]).astype(np.int16) for w in range(every.shape[1]))
                near = common >= shared
                for w, low in enumerate(below):
                    near &= (first[l, w][:, None] & first[right, w][None] & low) == 0
                if alone[s]:
                    near &= l[:, None] < right[None]
                a, b = np.nonzero(near)
                a, b = l[a], right[b]
                for k in range(0, len(a), 200_000):
                    p, q = a[k : k + 200_000], b[k : k + 200_000]
                    hit = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                    p, q = p[hit], q[hit]
                    if len(p):
                        _, root = local_roots(ids[p], ids[q])
                        uniq = np.unique(np.concatenate([ids[p], ids[q]]))
                        linked = np.zeros(len(uniq), np.int64)
                        np.add.at(linked, np.searchsorted(uniq, ids[p]), copies[q])
                        np.add.at(linked, np.searchsorted(uniq, ids[q]), copies[p])
                        out.append(pd.DataFrame({"id": uniq, "linked": linked, "root": root}))
        return pd.concat(out).groupby(["id", "root"], as_index=False)["linked"].sum()[["id", "linked", "root"]] if out else blank

    return map_groups(posts, "key", work, "id bigint, linked bigint, root bigint")


def near_duplicates(df: DataFrame, threshold: float = 0.93, n_pivots: int | None = None, shared: int = 5) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    fine = valid_vector() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # Only vectors of one label and one length are compared.
    label = F.concat_ws(" ", F.size("embedding").cast("string"), F.col("label").cast("string"))
    rows = df.select("vec_id", F.when(F.col("label").isNotNull(), label).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(fine)
    reps = checkpoint(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).select("id", "label", "embedding", "copies"))
    links = checkpoint(link_vectors(reps, threshold, n_pivots, shared))
    groups = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    totals = links.groupBy("id").agg(F.sum("linked").alias("linked"))
    done = reps.join(totals, "id", "left").join(groups, "id", "left")
    done = done.select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.join(done, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

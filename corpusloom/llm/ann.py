"""Approximate nearest neighbours over balanced posting lists.

A tree of median cuts on a bounded sample gives lists of equal share and their centroids.
Every distinct vector enters its nearest list and, near a boundary, up to ``replicas`` lists
whose centroid is within ``boundary`` times the nearest distance. Queries search the
centroids through an in-memory neighbour graph, keep the lists within ``ratio`` times the
distance of the nearest, and compare with all vectors of those lists in double precision.

Lists that still grow large are dealt out as shares. Equal vectors are one entry that names
its smallest ids, as many as a result can use, so copies cost nothing and ties stay exact.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part; vectors of different length are no neighbours of each other, and each length has lists
of its own; equal distances go to the smaller id; rows that repeat an id are one candidate at
its least distance, and one query, which asks with each of its vectors; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.embedding_dedup import valid_vector
from corpusloom.sampling import hash_sample
from corpusloom.storage import checkpoint


@dataclass(frozen=True)
class Params:
    """``sample`` and ``most_lists`` bound what the driver fits and broadcasts."""

    k: int = 10
    list_size: int = 200
    most_lists: int = 4096
    sample: int = 20_000
    replicas: int = 3
    boundary: float = 1.08
    ratio: float = 1.13
    degree: int = 24
    together: int = 16
    share: int = 20_000


def balanced_centroids(x: np.ndarray, n_lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of equal parts of ``x``: halves along the direction of two means."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < n_lists and max(map(len, parts)) > 1:
        parts.sort(key=len)
        part = parts.pop()
        y = x[part]
        a, b = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(4):
            near = ((y - a) ** 2).sum(axis=1) < ((y - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = y[near].mean(axis=0), y[~near].mean(axis=0)
        order = np.argsort(y @ (a - b), kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return np.stack([x[p].mean(axis=0) for p in parts])


class CentroidGraph:
    """Neighbour graph over the centroids with best-first search."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.c = centroids
        d = self.distances(centroids)
        near = np.argsort(d, axis=1, kind="stable")[:, 1 : degree + 1]
        # A ring through all centroids keeps every part of the graph reachable.
        ring = np.roll(np.arange(len(centroids)), -1)
        linked = [set(near[i].tolist()) | {int(ring[i])} for i in range(len(centroids))]
        for i in range(len(centroids)):
            for j in near[i].tolist():
                linked[j].add(i)
        self.next = [np.array(sorted(s - {i}), np.int64) for i, s in enumerate(linked)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        sq = (x * x).sum(axis=1)[:, None] + (self.c * self.c).sum(axis=1)[None] - 2 * x @ self.c.T
        return np.sqrt(np.maximum(sq, 0))

    def search(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Lists within ``ratio`` of the nearest distance.

        The walk starts from some centroids spread over the tree and goes on from the nearest
        open one until that is too far.
        """
        start = np.arange(0, len(self.c), max(1, int(len(self.c) ** 0.5)))
        seen = np.zeros(len(self.c), bool)
        seen[start] = True
        todo = list(zip(np.sqrt(((self.c[start] - q) ** 2).sum(axis=1)).tolist(), start.tolist(), strict=True))
        found, best = list(todo), min(todo)[0]
        heapq.heapify(todo)
        while todo:
            d, i = heapq.heappop(todo)
            if d > best * ratio:
                break
            new = self.next[i][~seen[self.next[i]]]
            seen[new] = True
            for e, j in zip(np.sqrt(((self.c[new] - q) ** 2).sum(axis=1)).tolist(), new.tolist(), strict=True):
                heapq.heappush(todo, (e, j))
                found.append((e, j))
                best = min(best, e)
        return np.array([j for e, j in found if e <= best * ratio], np.int64)


class Index:
    """Centroid graphs by vector length; each length has list numbers of its own."""

    def __init__(self, sample: list[np.ndarray], n: int, p: Params):
        self.graphs: dict[int, tuple[int, CentroidGraph]] = {}
        self.spare, at = p.together, p.together
        for length in sorted({len(v) for v in sample}):
            x = np.stack(sorted((v for v in sample if len(v) == length), key=lambda v: v.tolist()))
            share = n * len(x) // len(sample)
            n_lists = int(np.clip(share // p.list_size, 1, min(p.most_lists, max(1, len(x) // 4))))
            self.graphs[length] = (at, CentroidGraph(balanced_centroids(x, n_lists), p.degree))
            # Bundles of lists never mix lengths.
            at += -(-n_lists // p.together) * p.together
        self.spare = at

    def alone(self, length: int, p: Params) -> list[int]:
        """The one list of a length that the sample does not show."""
        return [self.spare + length * p.together]

    def post(self, vectors: list[np.ndarray], p: Params) -> list[list[int]]:
        """Lists that hold each vector."""
        out: list[list[int]] = [[] for _ in vectors]
        lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            if length not in self.graphs:
                for i in rows:
                    out[i] = self.alone(length, p)
                continue
            first, graph = self.graphs[length]
            for k in range(0, len(rows), 2000):
                part = rows[k : k + 2000]
                d = graph.distances(np.stack([vectors[i] for i in part]))
                near = np.argsort(d, axis=1, kind="stable")[:, : p.replicas]
                far = np.take_along_axis(d, near, 1)
                for i, a, b in zip(part, near, far, strict=True):
                    out[i] = (first + a[b <= b[0] * p.boundary]).tolist()
        return out

    def route(self, q: np.ndarray, p: Params) -> list[int]:
        """Lists that a query looks into."""
        if len(q) not in self.graphs:
            return self.alone(len(q), p)
        first, graph = self.graphs[len(q)]
        return (first + graph.search(q, p.ratio)).tolist()


def nearest(v: np.ndarray, ids: list, q: np.ndarray, wanted: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The ``k`` nearest ids of the wanted rows of ``v``, ties to the smaller id; each id once."""
    rows = np.flatnonzero(wanted)
    if not len(rows):
        return []
    exact = np.sqrt(((v[rows] - q) ** 2).sum(axis=1))
    order = np.argsort(exact, kind="stable")
    # Rows as near as the k-th of the nearest ids, all ties included.
    upto, seen = 0, set()
    while upto < len(order) and len(seen) < k:
        seen.update(ids[rows[order[upto]]])
        upto += 1
    upto = int(np.searchsorted(exact[order], exact[order[upto - 1]], "right"))
    best: dict[int, float] = {}
    for i in order[:upto]:
        for x in ids[rows[i]]:
            best.setdefault(int(x), float(exact[i]))
    return heapq.nsmallest(k, ((d, x) for x, d in best.items()))


def search(vectors: DataFrame, queries: DataFrame, p: Params = Params()) -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each row of ``queries`` (both vec_id, embedding).

    Columns query_id, rank (from 1), vec_id, score (Euclidean distance); a query's own id is
    no candidate.
    """
    spark = vectors.sparkSession
    usable = valid_vector() & F.col("vec_id").isNotNull()
    rows = vectors.where(usable).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    order = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= p.k + 1)
    reps = checkpoint(least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = checkpoint(queries.where(usable).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct())
    n = reps.count()
    if not n or asked.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = hash_sample(reps.select("embedding"), p.sample, ["embedding"], n).toPandas()
    if not len(sample):
        sample = reps.select("embedding").limit(1).toPandas()
    index = spark.sparkContext.broadcast(Index([np.asarray(v, np.float64) for v in sample["embedding"]], n, p))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame[["embedding", "ids"]].assign(lists=index.value.post([np.asarray(v, np.float64) for v in frame["embedding"]], p))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame[["embedding", "qid"]].assign(lists=[index.value.route(np.asarray(v, np.float64), p) for v in frame["embedding"]])

    posted = reps.mapInPandas(post, "embedding array<double>, ids array<bigint>, lists array<bigint>")
    # A query id with several vectors asks with each, so queries are told apart by a number.
    distinct = checkpoint(asked.select("embedding").distinct().withColumn("qid", F.monotonically_increasing_id()))
    routed = distinct.mapInPandas(route, "embedding array<double>, qid bigint, lists array<bigint>")
    # Neighbouring list numbers come from one branch of the tree and share a task.
    bundle = lambda c: F.array_distinct(F.transform(c, lambda i: F.floor(i / p.together)))
    posts = posted.withColumn("bundle", F.explode(bundle(F.col("lists"))))
    asks = routed.withColumn("bundle", F.explode(bundle(F.col("lists"))))
    sizes = posts.groupBy("bundle").count().select("bundle", F.ceil(F.col("count") / p.share).cast("int").alias("n"))
    sizes = checkpoint(sizes)
    share = F.pmod(F.xxhash64("embedding"), F.col("n")).cast("int")
    posts = posts.join(sizes, "bundle").select("embedding", "ids", "lists", "bundle", share.alias("share"))
    ways = sizes.toDF("bundle", "ways")
    asks = asks.join(ways, "bundle").select("embedding", "qid", "lists", "bundle", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("share"))
    k = p.k

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"qid": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            v, q = np.stack(left["embedding"].to_list()), np.stack(right["embedding"].to_list())
            known = np.unique(np.concatenate([*left["lists"], *right["lists"]]))
            member, wanted = np.zeros((len(v), len(known)), np.float32), np.zeros((len(q), len(known)), np.float32)
            for table, lists in ((member, left["lists"]), (wanted, right["lists"])):
                table[np.repeat(np.arange(len(lists)), list(map(len, lists))), np.searchsorted(known, np.concatenate(list(lists)))] = 1
            ids, sq = left["ids"].to_list(), (v * v).sum(axis=1)
            for i in range(0, len(q), 64):
                part = q[i : i + 64]
                rough = sq[None] - 2 * part @ v.T
                rough[wanted[i : i + 64] @ member.T == 0] = np.inf
                # Rough distances only cut off what is surely farther than k + 1 nearer ids.
                slack = 1e-9 * (sq.max() + (part * part).sum(axis=1))
                for r in range(len(part)):
                    open_rows, rows, pairs = int(np.isfinite(rough[r]).sum()), k + 1, []
                    while open_rows:
                        cut = np.partition(rough[r], min(rows, open_rows) - 1)[min(rows, open_rows) - 1]
                        pairs = nearest(v, ids, part[r], rough[r] <= cut + slack[r], k + 1)
                        if len(pairs) > k or rows >= open_rows:
                            break
                        rows *= 4
                    out["qid"] += [right["qid"].iloc[i + r]] * len(pairs)
                    out["vec_id"] += [x for _, x in pairs]
                    out["score"] += [d for d, _ in pairs]
        return pd.DataFrame(out).astype({"qid": "int64", "vec_id": "int64", "score": "float64"})

    hits = posts.groupBy("bundle", "share").cogroup(asks.groupBy("bundle", "share")).applyInPandas(compare, "qid bigint, vec_id bigint, score double")
    named = asked.join(distinct, "embedding").select("query_id", "qid")
    # An entry met in several bundles, or by several vectors of a query id, counts once.
    own = hits.join(named, "qid").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return own.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Centroid clustering of integer vectors with annulus search.

Vectors are scaled to integers, so that distances, sums and ties are exact and every run and
every partitioning gives the same clusters. Centroids are sorted by norm. A vector's exact
distance to one centroid, its seed, bounds its distance to the nearest one from above; only
centroids whose norm differs from the vector's by at most that bound can be as near (reverse
triangle inequality). They are one run of the sorted norms, found by two binary searches, and
are compared exactly. The run is widened by the rounding of the norms, so that centroids on its
border, ties among them, stay inside; ties go to the smaller number.

The table is scaled and written once, with the cluster of the first assignment as each vector's
seed; every round then reads it once, sends at most one row of sums a centroid and task through
the shuffle, and brings k rows to the driver. No round depends on rows of another one.

Defined results: vectors that are null, of another length, or hold null or non-finite components
are left out; repeated rows and ids each count; null ids are hashed as ``null``; equal hashes are
ordered by the vectors themselves; fewer vectors than centroids make fewer centroids, none give
an empty table; scaled components are held within 2^60, and distances and sums beyond a long are
given as the largest long; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.arrowmap import bound_batches, give_back
from corpusloom.columns import pick
from corpusloom.storage import materialize

#: Components up to here have distances that fit 64-bit integers in up to 64 dimensions.
SAFE = 1 << 27
LIMIT = 1 << 60
LARGEST = (1 << 63) - 1
#: Relative error of norms computed in double precision, with room to spare.
ROUNDING = 1e-9


def scaled(vectors: DataFrame, dims: int, scale: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns vec_id and v: the kept vectors as integers floor(scale * x)."""
    rows = pick(vectors, id_col, vector).toDF("vec_id", "x")
    kept = rows.withColumn("x", F.transform("x", lambda e: e.cast("double"))).where((F.size("x") == dims) & F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))))
    most = float(LIMIT)
    whole = F.transform("x", lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(most)), F.lit(-most))).cast("long"))
    return kept.select("vec_id", whole.alias("v"))


def first_centroids(points: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of smallest SHA-256 of ``salt:id``; a top-k, so k rows reach the driver."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(r["v"]) for r in points.select("v", name.alias("h")).orderBy("h", "v").limit(k).collect()]


class Annulus:
    """Centroids sorted by norm, for exact nearest-centroid search."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = [list(map(int, c)) for c in centroids]
        self.c = np.array(self.exact, np.int64)
        self.safe = bool(np.abs(self.c).max() <= SAFE)
        norms = np.sqrt((self.c.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def distance(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact squared distance of each row to one centroid each; Python integers beyond SAFE."""
        if v.dtype == object:
            return ((v - self.c[at].astype(object)) ** 2).sum(1)
        return ((v - self.c[at]) ** 2).sum(1)

    def nearest(self, v: np.ndarray, seed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each row; without seeds the nearest norm is one."""
        if not (self.safe and np.abs(v).max(initial=0) <= SAFE):
            v = v.astype(object)
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        if seed is None:
            right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
            right = np.minimum(right, len(self.norms) - 1)
            left = np.maximum(right - 1, 0)
            seed = self.order[np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)]
        best, at = self.distance(v, seed), seed.astype(np.int64)
        bound = np.sqrt(best.astype(np.float64))
        slack = (norm + self.norms[-1]) * ROUNDING
        low = np.searchsorted(self.norms, norm - bound - slack, "left")
        high = np.searchsorted(self.norms, norm + bound + slack, "right")
        for place, c in enumerate(self.order):
            rows = np.flatnonzero((low <= place) & (place < high) & (seed != c))
            if not len(rows):
                continue
            d = self.distance(v[rows], np.full(len(rows), c))
            won = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
            best[rows[won]], at[rows[won]] = d[won], c
        return at, best


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def seeded(points: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """``points`` with the cluster of a first assignment in ``seed``."""
    index = Annulus(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = index.nearest(_matrix(batch, dims), None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "seed"])
        give_back()

    bound_batches(points.sparkSession)
    return points.mapInArrow(run, StructType([*points.schema.fields, StructField("seed", IntegerType())]))


def sums(points: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and component sums of each cluster; a task sends one row a cluster at most."""
    index = Annulus(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(index.c)
        total: list = [0] * len(index.c)
        for batch in batches:
            v = _matrix(batch, dims)
            at, _ = index.nearest(v, batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64))
            exact = v if np.abs(v).max(initial=0) <= SAFE else v.astype(object)
            for c in np.unique(at):
                rows = exact[at == c]
                n[c] += len(rows)
                total[c] = total[c] + rows.sum(0).astype(object)
        some = [c for c in range(len(n)) if n[c]]
        if some:
            kind = pa.list_(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([n[c] for c in some], pa.int64()), pa.array([_decimals(total[c]) for c in some], kind)], ["cluster", "n", "total"])
        give_back()

    parts = points.mapInArrow(run, "cluster int, n bigint, total array<decimal(38,0)>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
    return {r["cluster"]: (r["n"], [int(x) for x in r["total"]]) for r in added.collect()}


def _decimals(values) -> list:
    return [Decimal(int(x)) for x in values]


def assigned(points: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """Columns vec_id, cluster and distance (squared, at most the largest long)."""
    index = Annulus(centroids)
    kind = points.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = index.nearest(_matrix(batch, dims), batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64))
            far = pa.array([min(int(x), LARGEST) for x in d] if d.dtype == object else d, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at.astype(np.int32)), far], ["vec_id", "cluster", "distance"])
        give_back()

    return points.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """Columns vec_id, cluster, distance of the kept vectors, and the final centroids.

    k is a parameter of the model and the centroids (k times dims numbers) go to all tasks.
    """
    points = scaled(vectors, dims, scale)
    centroids = first_centroids(points, k, salt)
    if not centroids:
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False)), []
    points = materialize(seeded(points, centroids, dims))
    for _ in range(rounds):
        for c, (n, total) in sums(points, centroids, dims).items():
            centroids[c] = [x // n for x in total]
    return assigned(points, centroids, dims), centroids


def cluster_report(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2") -> DataFrame:
    """The clusters with inertias and the digest of each vector's centroid.

    The per-cluster table that is broadcast has at most k rows.
    """
    found, centroids = cluster(vectors, k, rounds, dims, scale, salt)
    spark = vectors.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    digest = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    found = materialize(found)
    held = lambda x: F.least(x, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole = per.agg(F.sum("own").alias("all"))
    per = per.join(F.broadcast(digest), "cluster").join(F.broadcast(whole)).select("cluster", held(F.col("own")).alias("cluster_inertia"), held(F.col("all")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Centroid clustering of integer vectors, nearest centroids found by equal-average equal-variance search.

With S the sum of a vector's n components and W = n * (sum of squares) - S * S (n * n times its variance), the squared
distance of x and c is at least ((S_x - S_c)**2 + (sqrt(W_x) - sqrt(W_c))**2) / n. Centroids are sorted by S. Each vector
starts at its own S and looks outwards, always at the nearer side: once the first term alone is beyond the best distance
found, so is that of all centroids further out; a centroid that the second term rejects is passed over. Only the others
have their distance worked out, in integers, and it alone decides. Roots are rounded towards rejecting less.

A round is one pass over the vectors: each task sums its vectors per cluster, Spark adds the sums, and one row per cluster
and component reaches the driver. Centroids go to the tasks with the job; rounds keep nothing else.

Defined results: a vector that is null, has another number of components, a null or non-finite one, or one whose integer
doesn't fit 64 bits is left out; repeated rows count each time; a null id is the last to start a centroid; rows of equal
id are told apart by their components; fewer vectors than centroids start one each; no vectors give no rows. A distance or
sum of distances beyond 64 bits is null. Only the id and the vector columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgate.llm.tables import stage

#: Integers below this by the number of components have squares of sums and of distances that fit 64 bits.
PLAIN = 1 << 30
#: Integers must be below this to fit 64 bits.
LONG = float(1 << 63)


def integers(vectors: DataFrame, size: int, scale: int, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that have `size` finite components."""
    scaled = F.transform(F.col(vector), lambda c: F.lit(float(scale)) * c.cast("double"))
    kept = vectors.select(F.col(vec_id).alias("vec_id"), scaled.alias("_x")).filter(
        (F.size("_x") == size) & F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LONG))
    )
    return kept.select("vec_id", F.transform("_x", lambda c: F.floor(c)).alias("x"))


def starting(x: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of smallest sha256 of `salt` and id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [list(r.x) for r in x.orderBy(key.asc_nulls_last(), "x").limit(k).collect()]


class Search:
    """Nearest centroids of many vectors at a time."""

    def __init__(self, centroids: list[list[int]]) -> None:
        exact = np.array(centroids, object)
        self.order = np.array(sorted(range(len(exact)), key=lambda i: (sum(centroids[i]), i)))
        self.sums, self.roots, self.centroids = self._figures(exact[self.order])

    @staticmethod
    def _figures(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums, roots of W as doubles, and the vectors: plain 64-bit numbers where nothing can pass them."""
        if x.size and max(int(x.max()), -int(x.min())) >= PLAIN // x.shape[1]:
            x = x.astype(object)  # Python's integers have no limit
        else:
            x = x.astype(np.int64)
        sums = x.sum(axis=1)
        w = x.shape[1] * (x * x).sum(axis=1) - sums * sums
        return sums, np.sqrt(w.astype(np.float64)), x

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row: its centroid's number (the smallest one of equal distance), the squared distance, and in all how
        many distances were worked out."""
        sums, roots, x = self._figures(vectors)
        kind = np.result_type(x, self.centroids)
        x, centroids, c_sums = x.astype(kind), self.centroids.astype(kind), self.sums.astype(kind)
        sums, n, k = sums.astype(kind), x.shape[1], len(centroids)
        rows = len(x)
        best = np.full(rows, -1, kind)  # no distance yet
        chosen = np.full(rows, k)
        right = np.searchsorted(c_sums, sums) if k else np.zeros(rows, int)
        left = right - 1
        tried, active = 0, np.arange(rows)
        while len(active):
            lo, hi = left[active], right[active]
            off_left = np.abs(sums[active] - c_sums[np.maximum(lo, 0)])
            off_right = np.abs(c_sums[np.minimum(hi, k - 1)] - sums[active])
            to_left = (lo >= 0) & ((hi >= k) | (off_left <= off_right))
            at = np.where(to_left, lo, hi)
            off = np.where(to_left, off_left, off_right)
            inside = (lo >= 0) | (hi < k)
            none_yet = best[active] < 0
            # The nearer side is beyond the best distance: so is all that is left. An equal one may still win by number.
            inside &= none_yet | (off * off <= n * best[active])
            active, at, off, to_left, none_yet = active[inside], at[inside], off[inside], to_left[inside], none_yet[inside]
            if not len(active):
                break
            left[active] -= to_left
            right[active] += ~to_left
            spread = np.abs(roots[active] - self.roots[at])
            spread = np.maximum(spread - 1e-9 * (roots[active] + self.roots[at]) - 1e-6, 0)
            mean_part = off.astype(np.float64)
            bound = (mean_part * mean_part + spread * spread) * (1 - 1e-9)
            near = none_yet | (bound <= n * best[active].astype(np.float64))
            some, at = active[near], at[near]
            tried += len(some)
            apart = x[some] - centroids[at]
            distance = (apart * apart).sum(axis=1)
            number = self.order[at]
            have = best[some]
            wins = (have < 0) | (distance < have) | ((distance == have) & (number < chosen[some]))
            best[some[wins]] = distance[wins]
            chosen[some[wins]] = number[wins]
        return chosen, best, tried


def _rows(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The vectors of a batch, a row each."""
    lists = batch.column(batch.schema.get_field_index("x"))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


def _sums(x: DataFrame, centroids: list[list[int]], size: int) -> dict[int, tuple[int, list[int]]]:
    """For each cluster with vectors: their number and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        total = np.zeros((len(centroids), size + 1), object)
        for batch in filter(len, batches):
            vectors = _rows(batch, size)
            chosen, _, _ = search.nearest(vectors)
            # Halves keep sums of 2**31 integers of 64 bits within 64 bits.
            low, high = vectors & 0xFFFFFFFF, vectors >> 32
            for c in np.unique(chosen):
                own = chosen == c
                total[c, :size] += low[own].sum(axis=0).astype(object) + (high[own].sum(axis=0).astype(object) << 32)
                total[c, size] += int(own.sum())
        clusters, places = np.nonzero(total[:, size] > 0)[0], np.arange(size + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(clusters, size + 1), pa.int32()), pa.array(np.tile(places, len(clusters)), pa.int32()),
             pa.array([str(v) for c in clusters for v in total[c]], pa.string())],
            ["cluster", "place", "amount"],
        )

    parts = x.select("x").mapInArrow(run, "cluster int, place int, amount string")
    amounts = parts.groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    found: dict[int, list[int]] = {}
    for row in amounts.collect():  # a row for each cluster and component
        found.setdefault(row.cluster, [0] * (size + 1))[row.place] = int(row.amount)
    return {c: (v[size], v[:size]) for c, v in found.items()}


def fit(x: DataFrame, centroids: list[list[int]], rounds: int, size: int) -> list[list[int]]:
    """The centroids after some rounds of assigning all vectors and taking floors of means; those without vectors stay."""
    for _ in range(rounds):
        if not centroids:
            break
        sums = _sums(x, centroids, size)
        centroids = [[s // sums[c][0] for s in sums[c][1]] if c in sums else old for c, old in enumerate(centroids)]
    return centroids


def assigned(x: DataFrame, centroids: list[list[int]], size: int) -> DataFrame:
    """(vec_id, cluster, distance): each vector's nearest centroid, and the squared distance as a decimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids) if centroids else None  # without centroids there are no rows
        for batch in filter(len, batches):
            chosen, distance, _ = search.nearest(_rows(batch, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("vec_id")), pa.array(chosen, pa.int32()),
                 pa.array([str(d) for d in distance.tolist()], pa.string())],
                ["vec_id", "cluster", "distance"],
            )

    kind = dict(x.dtypes)["vec_id"]
    rows = x.mapInArrow(run, f"vec_id {kind}, cluster int, distance string")
    return rows.withColumn("distance", F.col("distance").try_cast("decimal(38,0)"))


def clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:",
    vector: str = "embedding", vec_id: str = "vec_id",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    x = integers(vectors, size, scale, vector, vec_id)
    centroids = fit(x, starting(x, k, salt), rounds, size)
    found = stage(assigned(x, centroids, size), "assigned")
    per_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()  # at most k rows
    everything = sum(r.total for r in per_cluster)
    facts = [
        (r.cluster, r.total, everything, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest())
        for r in per_cluster
    ]
    shape = "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string"
    known = found.sparkSession.createDataFrame(facts, shape)
    rows = found.join(F.broadcast(known), "cluster")
    longs = [F.col(c).try_cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")]
    return rows.select("vec_id", "cluster", *longs, "centroid_sha256")

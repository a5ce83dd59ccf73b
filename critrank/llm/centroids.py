"""Centroid clustering of integer vectors by equal-average equal-variance search.

Centroids are sorted by the sum of their components (their mean times the
dimension).  A vector starts at its own sum and scans outward, nearer sum first.
With d components, sums S and spreads D = sqrt(d * sum(x^2) - S^2),

    d * |x - c|^2  >=  (S_x - S_c)^2 + (D_x - D_c)^2.

Once the first term alone exceeds d times the best squared distance, no centroid
further out can win and the scan ends (exact in integers); a centroid whose two
terms exceed it is passed over (in doubles, rounded towards keeping it).  What is
left is measured in integers, so ties go to the smaller centroid number exactly.

Start: the ``k`` vectors with the smallest lowercase-hex sha256 of ``<seed>:<id>``,
in ascending hash order.  Each round assigns every vector and moves every centroid
that has any to the componentwise floor(sum / count).  See ``lloyd`` for the scans.

Defined results: rows whose vector is null, has another number of components, or
holds null, NaN or infinite ones are left out; scaled components beyond +-2^24 count
as +-2^24; repeated rows and ids count as often as they occur (equal hashes: by
components); a null id comes after all hashes; fewer vectors than ``k`` give as many
centroids; an empty table gives an empty result; an inertia beyond 64 bits is null;
extra columns make no difference.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lloyd

K, ROUNDS, SCALE, DIM, SEED = 40, 5, 256, 64, 2


def spread(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """sqrt(d * sum(x^2) - sum(x)^2): d times the standard deviation of the components."""
    return np.sqrt((x.shape[1] * (x * x).sum(axis=1) - sums * sums).astype(np.float64))


class MeanOrder:
    """Centroids in order of their component sum."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.centroids, self.sums = centroids[self.number], sums[self.number]
        self.spread = spread(self.centroids, self.sums)
        self.measured = 0  # distances computed, for tests and tuning

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid."""
        n, dim = x.shape
        k, far = len(self.sums), np.iinfo(np.int64).max
        best = np.full(n, far // dim)  # larger than any distance, and dim * best fits
        which = np.full(n, k)
        sums = x.sum(axis=1)
        own = spread(x, sums)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        rows = np.arange(n)
        while len(rows):
            below = np.where(low[rows] >= 0, sums[rows] - self.sums[low[rows]], far)
            above = np.where(high[rows] < k, self.sums[np.minimum(high[rows], k - 1)] - sums[rows], far)
            down = below <= above
            gap = np.where(down, below, above)
            on = gap < far
            on[on] = gap[on] * gap[on] <= dim * best[rows[on]]
            rows, down, gap = rows[on], down[on], gap[on]
            at = np.where(down, low[rows], high[rows])
            low[rows[down]] -= 1
            high[rows[~down]] += 1
            apart = np.abs(own[rows] - self.spread[at])
            apart = np.maximum(apart - 1e-12 * (own[rows] + self.spread[at]), 0)
            bound = (gap.astype(np.float64) ** 2 + apart * apart) * (1 - 1e-12)
            close = bound <= dim * best[rows]
            near, at = rows[close], at[close]
            off = x[near] - self.centroids[at]
            d = (off * off).sum(axis=1)
            self.measured += len(near)
            number = self.number[at]
            better = (d < best[near]) | (d == best[near]) & (number < which[near])
            best[near[better]], which[near[better]] = d[better], number[better]
        return which, best


def start(table: DataFrame, id_col: str, k: int, seed: int, dim: int) -> np.ndarray:
    """The first centroids: (k, dim) integers."""
    named = (table.withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256))
             .withColumn("_key", F.conv(F.substring("_hash", 1, 15), 16, 10).cast("bigint")))
    order = [F.col("_key").asc_nulls_last(), F.col("_hash").asc_nulls_last(), F.col("v").asc()]
    first = lloyd.smallest(named.select("_key", "_hash", "v"), "_key", order, k).collect()  # k rows
    return np.array([r["v"] for r in first], np.int64).reshape(-1, dim)


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
            scale: int = SCALE, dim: int = DIM, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every usable vector, the final centroids)."""
    table = lloyd.integer_vectors(df, [id_col], vector, scale, dim, "cluster-vectors")
    books = [start(table, id_col, k, seed, dim)]
    if not len(books[0]):
        return table.select(id_col, F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), books[0]
    for _ in range(rounds):
        books = lloyd.moved(table, books, MeanOrder)
    rows = lloyd.assigned(table, [id_col], books, MeanOrder, "clusters")
    return rows.select(id_col, F.col("entries")[0].alias("cluster"), F.col("error").alias("distance")), books[0]


def digest(df: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = cluster(df.select("vec_id", "embedding"))
    sums = rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    of = dict(sums.collect())  # a row for each centroid
    whole = None if None in of.values() or sum(of.values()) >= 1 << 63 else sum(of.values())
    facts = df.sparkSession.createDataFrame(
        [(c, of.get(c), whole, hashlib.sha256(lloyd.decimal_text([v]).encode()).hexdigest())
         for c, v in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

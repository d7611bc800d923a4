"""Operator 11: centroid clustering by equal-average equal-variance search.

Components become floor(256 * x).  The first centroids are the vectors with the
smallest SHA-256 of `<seed>:<id>`; every round assigns all vectors and replaces
each centroid that has vectors by their componentwise floor(sum / count).

Search of the nearest centroid: centroids lie sorted by component sum (their
mean times the width).  From the vector's own mean the scan goes outward, to
the nearer side first.  With n components, S the component sum and
W = sqrt(n) * |x - mean|,

    n * |x - c|^2  >=  (Sx - Sc)^2 + (Wx - Wc)^2 .

The first term alone ends the scan (equal average), both together reject a
centroid without computing its distance (equal variance).  Bounds are floating
point with a slack that only weakens them; distances themselves are 64-bit
whole numbers, so nearest centroids and ties (smaller number) are exact.

On Spark: quantised vectors are stored once; a round is one pass without a
shuffle of vectors: every task sends one row of sums per centroid, so a hot
cluster costs no more than a small one.  What reaches the driver and travels to
the tasks is the centroid table, `clusters` x `dim` numbers at any input size.

Cases: null vectors, other widths, null or non-finite components, and components
of which |floor(256 * x)| exceeds `limit(dim)` (2^27 at 64: beyond it squared
distances leave 64 bits) take no part; rows with a null id are clustered but
never start a centroid; repeated rows count as often as they come; equal hashes go by
components; fewer vectors than clusters start fewer centroids; an empty table
gives no rows; other columns are ignored; an inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

CLUSTERS = 40
ROUNDS = 5
DIM = 64
SEED = "2"
SCALE = 256
SLACK = 1e-3           # of the floating-point bounds, in units of a component


def limit(dim: int) -> int:
    """Largest |component| whose squared distances surely fit 64 bits."""
    return 1 << (62 - (dim - 1).bit_length()) // 2 - 1


def quantised(vectors: DataFrame, id_col: str, vec: str, dim: int) -> DataFrame:
    """(id, q): whole-number components of the vectors that take part."""
    v = F.col(vec).cast("array<double>")
    return (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .filter(F.coalesce((F.size("v") == dim), F.lit(False))).filter(_inside("v", dim))
            .select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("q")))


def _inside(v: str, dim: int) -> Column:
    # |x| is compared before the product, so huge values cannot overflow the cast
    return F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(limit(dim) / SCALE)), F.lit(False)))


class Scan:
    """Centroids sorted by component sum, searched outward from a vector's own."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.number = np.lexsort((np.arange(len(sums)), sums))
        self.c, self.sum, self.dev = centroids[self.number], sums[self.number].astype(np.float64), spread(centroids[self.number])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid number, squared distance, distances computed) of every row."""
        n, dim = x.shape
        k = len(self.c)
        total, dev = x.sum(axis=1).astype(np.float64), spread(x)
        hi = np.searchsorted(self.sum, total)
        lo = hi - 1
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        computed = np.zeros(n, np.int64)
        open_ = np.arange(n)
        while len(open_):
            left, right = lo[open_], hi[open_]
            down = np.where(left >= 0, total[open_] - self.sum[np.maximum(left, 0)], np.inf)
            up = np.where(right < k, self.sum[np.minimum(right, k - 1)] - total[open_], np.inf)
            below = down <= up
            gap = np.maximum(np.where(below, down, up) - SLACK, 0.0) ** 2
            most = best[open_] * float(dim) * (1 + 1e-9)
            go = gap <= most                       # the means only move further away from here
            go &= np.isfinite(gap)
            open_, below, gap, most = open_[go], below[go], gap[go], most[go]
            at = np.where(below, left[go], right[go])
            lo[open_[below]] -= 1
            hi[open_[~below]] += 1
            near = gap + np.maximum(np.abs(dev[open_] - self.dev[at]) - SLACK, 0.0) ** 2 <= most
            row, at = open_[near], at[near]
            diff = x[row] - self.c[at]
            d = np.einsum("ij,ij->i", diff, diff)
            num = self.number[at]
            won = (d < best[row]) | ((d == best[row]) & (num < who[row]))
            best[row[won]], who[row[won]] = d[won], num[won]
            computed[row] += 1
        return who, best, computed


def spread(x: np.ndarray) -> np.ndarray:
    f = x.astype(np.float64)
    f -= f.mean(axis=1)[:, None]
    return np.sqrt(x.shape[1] * (f * f).sum(axis=1))


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(col.to_numpy()).astype(np.int64).reshape(-1, dim)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, dim = Scan(centroids), centroids.shape[1]
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["q"], dim)
                who, _, _ = scan.nearest(x)
                order = np.argsort(who, kind="stable")
                have, first = np.unique(who[order], return_index=True)
                total[have] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(who, minlength=len(centroids))
        used = np.flatnonzero(count)
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], "total": list(total[used])})
    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    part = vectors.select("q").mapInPandas(_sums(centroids), "cluster int, n long, total array<long>")
    rows = (part.select("cluster", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos")
            .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect())
    out = centroids.copy()
    for r in rows:                  # at most one row per number of the table
        out[r["cluster"], r["pos"]] = int(r["x"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance, computed): the nearest centroid of every vector."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scan(centroids)
        for pdf in batches:
            if len(pdf):
                who, d, computed = scan.nearest(_matrix(pdf["q"], centroids.shape[1]))
                yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "cluster": who.astype(np.int32), "distance": d, "computed": computed})
    return vectors.select("id", "q").mapInPandas(run, "id long, cluster int, distance long, computed long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dim: int = DIM, seed: str = SEED) -> DataFrame:
    """The id column, cluster, distance (squared), computed (distances the search did
    not avoid in the last assignment), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_col, vec, dim), "quantised")
    # SHA-256 orders the starting vectors; `clusters` rows reach the driver
    first = (rows.filter(F.col("id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "q")
             .orderBy("h", "q").limit(clusters).collect())
    if not first:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, computed long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    centroids = np.array([r["q"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    last = stored(assigned(rows, centroids), "assigned")
    wide = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    own = {r["cluster"]: int(r["own"]) for r in wide}
    fits = lambda n: n if n < 1 << 63 else None
    table = spark.createDataFrame([(j, fits(own.get(j, 0)), fits(sum(own.values())),
                                    hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
                                   for j, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (last.join(F.broadcast(table), "cluster")          # one row per centroid
            .select(F.col("id").alias(id_col), "cluster", "distance", "computed", "cluster_inertia", "inertia", "centroid_sha256"))

"""Exact comparison inside clusters, in bounded blocks.

A cluster's rows are dealt by hash into blocks of about `rows` rows and `units`
payload units; each pair of blocks is one task group (a tile), so a cluster of
any size spreads over many tasks and no task holds more than two blocks.
Clusters of one block share task groups (bins).  A tile returns, for each row
with a link, the weight of its partners and the smallest id it reaches inside
the tile: linear in the rows, never a list of pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links (a, b) among 0..n-1."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def tiled(members: DataFrame, payloads: DataFrame, link: Callable, rows: int = 1024, units: int = 1_000_000) -> DataFrame:
    """members: cluster long, id long, weight long, unit long (payload size); payloads:
    id long, payload binary, one row per id, joined once the rows are dealt.
    `link(left payloads, right payloads or None)` gives the boolean link matrix
    (None: among the left).  Returns (id, n, root): one row per tile and
    linked id, n the weight of its partners there, root the smallest id reached there."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.sum("unit").alias("_u"))
    size = size.select("cluster", F.greatest(F.ceil(F.col("_n") / rows), F.ceil(F.col("_u") / units)).cast("int").alias("_b"), "_n")
    total = size.filter("_b = 1").agg(F.sum("_n")).first()[0] or 0
    bins = max(1, -(-total // rows))
    dealt = members.join(size, "cluster").withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_b")).cast("int"))
    small = dealt.filter("_b = 1").select(F.lit(-1).cast("long").alias("t"), F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("int").alias("lo"),
                                          F.lit(-1).alias("hi"), F.lit(0).alias("side"), "cluster", "id", "weight")
    large = (dealt.filter("_b > 1").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
             .select(F.col("cluster").alias("t"), F.least("_i", "_j").alias("lo"), F.greatest("_i", "_j").alias("hi"),
                     (F.col("_i") > F.col("_j")).cast("int").alias("side"), "cluster", "id", "weight"))

    def one(ids, weight, payload, side):
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        if len(right):
            a, b = np.nonzero(link([payload[k] for k in left], [payload[k] for k in right]))
            a, b = left[a], right[b]
        else:
            a, b = np.nonzero(np.triu(link([payload[k] for k in left], None), 1))
            a, b = left[a], left[b]
        if not len(a):
            return None
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, a, weight[b])
        np.add.at(n, b, weight[a])
        linked = np.flatnonzero(n)
        return pd.DataFrame({"id": ids[linked], "n": n[linked], "root": ids[roots(len(ids), a, b)[linked]]})

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        pdf = pdf.sort_values(["cluster", "id"], kind="stable")
        ids, weight = pdf["id"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)
        side, cluster, payload = pdf["side"].to_numpy(), pdf["cluster"].to_numpy(np.int64), pdf["payload"].tolist()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cluster)) + 1, [len(ids)]])
        for s, e in zip(cuts[:-1], cuts[1:]):
            both = len(np.unique(side[s:e])) == 2
            if e - s < 2 or (lo != hi and hi >= 0 and not both):
                continue                     # a tile of two blocks needs both
            part = one(ids[s:e], weight[s:e], payload[s:e], side[s:e])
            if part is not None:
                out.append(part)
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")

    placed = small.unionByName(large).join(payloads.select("id", "payload"), "id")
    return placed.groupBy("t", "lo", "hi").applyInPandas(tile, "id long, n long, root long")


def merged(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n) summed over the tiles, and the links (a, b) that span the components."""
    return (links.groupBy("id").agg(F.sum("n").alias("n")),
            links.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
